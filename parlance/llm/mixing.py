"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in shuffled order, repeated up to ``max_repeat`` times.
A document's virtual finish time is the cumulative words of its queue divided by the source's
target. All documents are then served in the order of that time until the budget is used.

Nothing runs over one source in one task: a queue is cut into buckets by the leading digits of the
shuffle key, a bucket's start is the sum of the buckets before it (one small row per source and
bucket), and the running sum is made within a bucket. The copies are range-sorted by finish time
over all tasks and written; the sums of the ranges tell in which one the budget ends, and the running
sum within that range is where the order is truncated.

Cases: a null or blank text has size 0 and is taken 0 times over. A null source is a source of its
own, the last. A source without words gets the target 0. Repeated rows are documents of their own;
rows alike in id and text are interchangeable, so that reruns agree. An empty table gives an empty
result. Only the id, text and source columns are read, so other columns cannot clash; the number of a
repeated row gets a name that docs has not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import fresh, quoted, written

#: Characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies that a range of the global order should hold at most.
RANGE_ROWS = 1_000_000
#: Rows that a bucket of a queue should hold about.
BUCKET_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: str, seed: int) -> Column:
    """A fixed pseudo-random order: the MD5 of seed and id, as hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, cycle: int = 3, max_repeat: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds target: the weights 1 to ``cycle``, repeating over the
    sources by code point (null last), share all words; a target stops at ``max_repeat`` times its
    source's size, and the excess is shared anew by weight until none is above.

    One pass: sources capped are those of the least size per weight, so with the sources in that
    order the shares that are left follow from prefix sums. One row per source, never per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1)
    w = w.withColumn("cap", F.col("source_size") * max_repeat)
    w = w.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("place", F.row_number().over(by_room))
    fits = F.col("weight") * F.col("left_size") <= F.col("cap") * F.col("left_weight")
    w = w.withColumn("first_fit", F.min(F.when(fits, F.struct("place", "left_size", "left_weight"))).over(everything))
    open_ = F.col("first_fit").isNotNull() & (F.col("place") >= F.col("first_fit.place"))
    share = (F.col("weight") * F.col("first_fit.left_size")).cast("double") / F.col("first_fit.left_weight").cast("double")
    return w.select("source", "source_size", F.when(open_, share).otherwise(F.col("cap").cast("double")).alias("target"))


def _starts(parts: DataFrame, digits: int) -> DataFrame:
    """parts: source, bucket (``digits`` digits of the key), part (words). source, bucket and the words of the
    source's buckets before it: digit by digit, those of the at most 16 groups that share all digits but the
    last, so no window has a source's buckets together."""
    starts = parts.select("source", "bucket", F.lit(0).cast("long").alias("start"))
    for k in range(1, digits + 1):
        groups = parts.groupBy("source", F.substring("bucket", 1, k).alias("head")).agg(F.sum("part").alias("part"))
        siblings = Window.partitionBy("source", F.substring("head", 1, k - 1)).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select(F.col("source").alias("g_source"), "head", F.coalesce(F.sum("part").over(siblings), F.lit(0)).alias("before"))
        starts = starts.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.substring("bucket", 1, k) == F.col("head")))
        starts = starts.select("source", "bucket", (F.col("start") + F.col("before")).alias("start"))
    return starts


def _placed(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: int = 3,
    max_repeat: int = 3,
    seed: int = 6,
) -> DataFrame:
    """The queues: id, source, size, source_size, target, finish (virtual finish times of the copies),
    done (copies within the budget), and key and tie, which with id are a queue's order."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        shuffle_key(id_col, seed).alias("key"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    rows = written(spark, rows, "mix-rows")  # the texts are read once
    n = rows.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    sized = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), cycle, max_repeat)
    starts = _starts(parts, digits).alias("a").join(sized.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target")
    starts = written(spark, starts, "mix-starts").withColumnsRenamed({"source": "s_source", "bucket": "s_bucket"})

    # a hot source has many buckets, so this key is even; ids, sizes and keys only, no texts
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("id"), "tie").rangeBetween(Window.unboundedPreceding, 0)  # rows alike end together
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(
        starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket"))
    )
    reach = F.col("start") + F.col("upto")
    finish = [F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + reach).cast("double") / F.col("target")) for e in range(max_repeat)]
    placed = placed.select("id", "size", "source_size", "target", "key", "tie", "source", F.array(*finish).alias("finish"))
    placed = written(spark, placed, "mix-placed")

    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).head()["b"]
    copies = placed.filter("size > 0").select(F.explode("finish").alias("f"), "size")
    cut = _truncated(spark, copies, budget, max_repeat * n)
    done = F.when(F.col("size") > 0, F.size(F.filter("finish", lambda f: f <= F.lit(cut)))).otherwise(F.lit(0)) if cut is not None else F.lit(0)
    return placed.withColumn("done", done)


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Returns id_col, size, source_size, target, taken (words, repeats counted), copies, finish
    (virtual finish time of the first copy, null if the source has no words). Options: as _placed."""
    placed = _placed(spark, docs, id_col, **options)
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("done")).cast("long").alias("taken"), F.col("done").alias("copies"), F.get("finish", F.lit(0)).alias("finish")
    )


def apply_mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = 3, seed: int = 6, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with a column ``copy`` (or, if docs
    has one, ``copy_`` and so on) from 1 on. Documents not taken, and those without words, are left out.

    The budget's end cuts each source's queue at one place. So the mix is a row per source, the copies
    that all its documents have and the last document that has one more, and no text is shuffled.
    """
    placed = _placed(spark, docs, id_col, text_col, source_col, max_repeat=max_repeat, seed=seed, **options).filter("size > 0")
    at = F.struct("key", "id", "tie")
    ends = [F.max(F.when(F.col("done") > k, at)).alias(f"end{k}") for k in range(max_repeat)]
    cuts = placed.groupBy("source").agg(F.min("done").alias("all"), *ends)
    last = F.coalesce(*[F.when(F.col("all") == k, F.col(f"end{k}")) for k in range(max_repeat)])
    cuts = written(spark, cuts.select(F.col("source").alias("cut_source"), "all", last.alias("last")), "mix-cuts")
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"),
        F.struct(shuffle_key(id_col, seed).alias("key"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie")).alias("at"),
    ).filter(F.col(f"row.{quoted(text_col)}").rlike(WORD))
    joined = rows.join(cuts, F.col(f"row.{quoted(source_col)}").eqNullSafe(F.col("cut_source")))
    copies = F.col("all") + F.when(F.col("last").isNotNull() & (F.col("at") <= F.col("last")), 1).otherwise(0)
    taken = joined.withColumn("copies", copies).filter("copies > 0")
    return taken.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), "copies")).alias(fresh(docs.columns, "copy")))


def _truncated(spark: SparkSession, copies: DataFrame, budget: int, most: int) -> float | None:
    """copies: f, size. The last finish time up to which all copies, in the order of f over all tasks,
    fit into the budget (equal times go together); null if none does. A range is one task's share of
    the sorted copies, and of the ranges only their sums are gathered, a row per task."""
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // RANGE_ROWS))
    ordered = copies.repartitionByRange(ranges, "f").sortWithinPartitions("f").withColumn("range", F.spark_partition_id())
    ordered = written(spark, ordered, "mix-order")
    sums = ordered.groupBy("range").agg(F.sum("size").alias("words"), F.max("f").alias("last"))
    upto = Window.orderBy("last").rowsBetween(Window.unboundedPreceding, 0)
    sums = written(spark, sums.withColumn("spent", F.sum("words").over(upto)), "mix-ranges")
    whole = sums.filter(F.col("spent") <= budget).agg(F.max("last"), F.coalesce(F.max("spent"), F.lit(0))).head()
    over = sums.filter(F.col("spent") > budget).orderBy("last").select("range").head()
    if over is None:
        return whole[0]
    within = Window.orderBy("f").rangeBetween(Window.unboundedPreceding, 0)  # of one range
    last = ordered.filter(F.col("range") == over["range"]).select("f", F.sum("size").over(within).alias("spent"))
    inside = last.filter(F.col("spent") + F.lit(whole[1]) <= budget).agg(F.max("f")).head()[0]
    return whole[0] if inside is None else inside
