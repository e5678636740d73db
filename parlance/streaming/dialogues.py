"""Stateless dialogue operators over streams: the same expressions, on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.operators import attribution, reliability


def read_pairs(spark: SparkSession, folder: str, schema: str = "id long, dialogue string, summary string") -> DataFrame:
    """New JSON-lines files of a folder as a stream of (id, dialogue, summary)."""
    return spark.readStream.schema(schema).json(folder)


def checked(stream: DataFrame) -> DataFrame:
    """Repaired and assessed pairs; no state, so no watermark."""
    repaired = attribution.repair(stream, "dialogue", "summary")
    return reliability.assess(repaired, "dialogue", "repaired")


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Appends Parquet files; the checkpoint makes the sink exactly-once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
