"""The training-data pipeline: five stages over documents, each an operator of parlance.llm.

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and returns the columns of
documents; the last adds ``copy`` (``copy_`` if there is one), the number of a repeated row. Between stages the rows are written
as Parquet and read again, so a stage always starts from a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from parlance.llm.common import released, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go. Learns outside the held-out fold."""
    return language_id.keep_identified(spark, docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines frequent within their source go; n_chars follows the text."""
    return line_dedup.drop_boilerplate(spark, docs, length_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays."""
    return jaccard_join.drop_similar(spark, docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.apply_mix(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix),
]

#: Cross-parsing has no SQL form; stages and run() are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's own tables go when its result is written, and its input
    when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    with released():
        for name, stage in STAGES:
            with released():
                docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
