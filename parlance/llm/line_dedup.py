"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host, the pages that contain a line are divided by all pages of the host. A line above the
boilerplate ratio is dropped from all pages of that host. A line of one page alone repeats nothing
there, whatever its share of a small host, and stays.

A line is what stands between line feeds; it is compared without white space at its ends, as a
128-bit hash. Blank lines are never dropped. A page counts once for a line however often it repeats
it. Boilerplate lines per host are few: each fills more than ``ratio`` of the host's pages, so a
host has at most (mean lines of a page / ratio) of them, however many pages it has.

Cases: a null text stays null and counts as a page without lines; an empty text stays empty. A null
host is a host of its own. Repeated rows are pages of their own. An empty table gives an empty
result. All columns are kept as they are, whatever their names, but for the text (and, if named,
the column of its length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import fresh, quoted, written

RATIO = 0.05


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """128 bits of a line; null for a blank one. btrim takes the characters that part words."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(4), bare).alias("b")))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """host, mark, pages, host_pages of the boilerplate lines. Counts are combined before the
    shuffle, so a line or host that fills a third of all pages sends one row per task."""
    pages = docs.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(_lines(F.col(text_col)), _mark)).alias("marks"))
    counts = pages.select("host", F.explode("marks").alias("mark")).filter("mark is not null").groupBy("host", "mark").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.filter("pages > 1")
    hosts = docs.groupBy(F.col(host_col).alias("h")).agg(F.count(F.lit(1)).alias("host_pages"))
    joined = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined.filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(
    spark: SparkSession,
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = RATIO,
    length_col: str | None = None,
    report: bool = False,
) -> DataFrame:
    """docs with boilerplate lines taken out of the text. length_col, if given, is set to the new
    length of texts that changed. report: adds n_lines and n_dropped, under names that docs has not (an
    underscore is added until it has not)."""
    found = boilerplate(docs, text_col, host_col, ratio).groupBy("host").agg(F.collect_set("mark").alias("marks"))
    # written: its true size decides whether it is broadcast; a large one is joined by shuffle
    found = written(spark, found, "boilerplate")
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    keyed = keyed.join(found, F.col(f"row.{quoted(host_col)}").eqNullSafe(F.col("host")), "left")
    text = F.col(f"row.{quoted(text_col)}")
    lines = _lines(text)

    def is_boilerplate(line: Column) -> Column:
        return F.coalesce(F.array_contains(F.col("marks"), _mark(line)), F.lit(False))

    untouched = F.col("marks").isNull() | text.isNull()
    kept = F.when(untouched, text).otherwise(F.array_join(F.filter(lines, lambda x: ~is_boilerplate(x)), "\n"))
    dropped = F.when(untouched, F.lit(0)).otherwise(F.size(F.filter(lines, is_boilerplate))).cast("long")
    size = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    keyed = keyed.select("row", kept.alias("kept"), size.alias("n_lines"), dropped.alias("n_dropped"))
    changed = {text_col: F.col("kept")}
    if length_col:
        old = F.col(f"row.{quoted(length_col)}")
        changed[length_col] = F.when(text != F.col("kept"), F.length("kept")).otherwise(old)
    out = [changed.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns]
    out += [F.col(c).alias(fresh(docs.columns, c)) for c in ("n_lines", "n_dropped")] if report else []
    return keyed.select(*out)
