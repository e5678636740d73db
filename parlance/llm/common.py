"""What the operators of this subpackage share: tables, the shared folder, text helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be
    unset, one of our own; elsewhere a folder of one machine would be no shared one, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
    return context.getCheckpointDir()


def written(spark: SparkSession, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cuts the lineage: df written as Parquet into the shared folder and read again.

    A lost executor then costs a re-read, not a re-run, and Spark knows the table's true size
    when it chooses between a broadcast and a shuffled join. Removed when the process ends, or with
    ``released``. batch_rows: rows of an Arrow batch while it is written, where rows are long.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch_rows:
            spark.conf.set(key, str(min(batch_rows, int(before) if int(before) > 0 else batch_rows)))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """df with a number of each row, written once: whoever reads it later, over whatever file splits,
    finds the same number beside the same row."""
    return written(spark, df.withColumn(column, F.monotonically_increasing_id()), name)


@contextlib.contextmanager
def released(keep: int = 1) -> Iterator[None]:
    """Removes the tables that are written within, but for the last ``keep``."""
    first = len(_written)
    yield
    stop = len(_written) - keep
    for spark, path in _written[first:stop]:
        _remove(spark, path)
    del _written[first:stop]


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning applies
            return


def crc_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(taken: list[str], stem: str) -> str:
    """A column name that none of taken equals, letter case aside."""
    lower = {x.lower() for x in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def text_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text (a longer text is a slice alone), so that what
    a task holds does not follow the length of its rows. The same batch gives the same slices."""
    sizes = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def quoted(name: str) -> str:
    """A column's name as one part of a path, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def carried(columns: list[str], but: str) -> Column:
    """A struct of these columns without one, which travels beside it."""
    return F.struct(*[F.col(quoted(c)) for c in columns if c != but], F.lit(0).alias(fresh(columns, "_none")))


def restored(columns: list[str], text_col: str) -> list[Column]:
    """The columns again, from ``row`` (see carried) and ``text``."""
    return [F.col("text").alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in columns]
