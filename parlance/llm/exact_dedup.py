"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name: blocks are
dealt out by hash, each task sorts its blocks and counts the distinct ones, and a name is the task's
number and that count. Then adjacent names of a document are paired and the pairs are named in the
same way, until each document has one name. Names stand for whole contents, not for hashes of them,
so two texts have the same name (and number of blocks) if and only if they are identical.

One pass over the documents cuts them and numbers rows, and is written; everything after reads that
table, so rows, blocks and places agree whatever file splits a later read has. In that pass, the copies
of a block within a slice of documents are folded into one (a hot block sends one row per slice), and
only the slice's first place of it, two integers, is named; places are mapped back with integers
alone. Names depend on the set of blocks a task gets, not on their order, so a task that is run again
gives the same names. Each round's names are written to the shared folder, and the joins that bring
them back shuffle both sides, so that adaptive execution can split a hot one.

Cases: a null text counts as empty; the empty text is one empty block. Repeated rows, ids included,
are documents of their own: of equal texts the row of the largest id stays (a null id is the
least), of equal ids the last. An empty table gives an empty result. Very long texts are named by
as many blocks as they need, SLICE_BYTES of them at a time. Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import written

BLOCK_BYTES = 8192
#: Bytes of blocks that one naming task should sort.
TASK_BYTES = 24 << 20
#: Bytes of blocks whose copies are folded together, and rows of an Arrow batch of texts or blocks.
SLICE_BYTES, BATCH_ROWS = 8 << 20, 1000
#: Names of one task; the task's number stands above them.
NAMES_PER_TASK = 1 << 40


def _folded(block_bytes: int, names: list[str]):
    """Map over (row, id, n_blocks, sha, text): a row (row, idx, row0, idx0, block, id, n_blocks, sha) per
    block. row0 and idx0 are the slice's first place of it, which alone has the block; the facts of
    the document are beside its first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_slice = max(1, SLICE_BYTES // block_bytes)
        first: dict[bytes, tuple[int, int]] = {}
        places: list[tuple] = []
        heads: list[int] = []  # rows of the batch whose facts are due, None for later blocks

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(list(zip(*places)) or [[]] * 5, (*[pa.int64()] * 4, pa.binary()))]
            facts = [batch.column(k).take(pa.array(heads, pa.int64())) for k in (1, 2, 3)]
            first.clear(), places.clear(), heads.clear()
            return pa.RecordBatch.from_arrays([*columns, *facts], names)

        for batch in batches:
            for at, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4))):
                data = memoryview(text.as_buffer())
                for k in range(max(1, -(-len(data) // block_bytes))):
                    block = bytes(data[k * block_bytes : (k + 1) * block_bytes])
                    new = block not in first
                    places.append((row, k, *first.setdefault(block, (row, k)), block if new else None))
                    heads.append(None if k else at)
                    if len(first) >= per_slice or len(places) >= 8 * per_slice:
                        yield flush(batch)
            if places:
                yield flush(batch)

    return run


def _count(n_keys: int):
    """Map over sorted (key..., payload...): the payload with the name of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = TaskContext.get().partitionId() * NAMES_PER_TASK, None
        for batch in batches:
            names = []
            for key in zip(*[batch.column(k).to_pylist() for k in range(n_keys)]):
                if key != last:
                    name, last = name + 1, key
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns[n_keys:], pa.array(names, pa.int64())], [*batch.schema.names[n_keys:], "name"])

    return run


def name_keys(df: DataFrame, keys: list[str], payload: list[str], tasks: int) -> DataFrame:
    """payload and name; equal keys, and only those, have equal names."""
    dealt = df.select(*keys, *payload).repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_count(len(keys)), ", ".join(f"{p} long" for p in [*payload, "name"]))


def name_documents(spark: SparkSession, rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """rows: id, text (binary, not null). Returns facts (row, id, n_blocks, sha) and names (row, name)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("long")
    cut = rows.select(F.monotonically_increasing_id().alias("row"), "id", blocks.alias("n_blocks"), F.sha2("text", 256).alias("sha"), "text")
    fields = [("row", T.LongType()), ("idx", T.LongType()), ("row0", T.LongType()), ("idx0", T.LongType()), ("block", T.BinaryType())]
    schema = T.StructType([*[T.StructField(n, t) for n, t in fields], *cut.schema.fields[1:2], T.StructField("n_blocks", T.LongType()), T.StructField("sha", T.StringType())])
    folded = written(spark, cut.mapInArrow(_folded(block_bytes, schema.names), schema), "dedup-blocks", BATCH_ROWS)
    facts = folded.filter("idx = 0").select("row", "id", "n_blocks", "sha")
    named = folded.filter("block is not null")
    total = (*named.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0))).head(), *facts.agg(F.coalesce(F.max("n_blocks"), F.lit(1))).head())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-total[0] // TASK_BYTES))
    named = name_keys(named, ["block"], ["row", "idx"], tasks).withColumnsRenamed({"row": "row0", "idx": "idx0"})
    places = folded.select("row", "idx", "row0", "idx0")
    level = written(spark, places.join(named, ["row0", "idx0"]).select("row", "idx", "name"), "dedup-names", BATCH_ROWS)
    most = total[1]
    while most > 1:
        even = F.col("idx") % 2 == 0
        pairs = level.groupBy("row", F.floor(F.col("idx") / 2).cast("long").alias("idx")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")
        )
        # an odd last name has no partner; one whose document has no other keeps its name
        pairs = written(spark, pairs.select("row", "idx", "a", F.coalesce("b", F.lit(-1)).alias("b")), "dedup-pairs")
        distinct = name_keys(pairs.groupBy("a", "b").agg(F.first("a").alias("a2"), F.first("b").alias("b2")), ["a", "b"], ["a2", "b2"], least)
        level = written(spark, pairs.join(distinct, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).select("row", "idx", "name"), "dedup-names")
        most = -(-most // 2)
    return facts, level.select("row", "name")


def dedup_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256, name, n_blocks.

    normalise: a function of the text column, applied before texts are compared (none: as it is).
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).cast("binary").alias("text"))
    facts, names = name_documents(spark, rows, block_bytes)
    whole = written(spark, facts.join(names, "row").select("row", "id", "n_blocks", "name", "sha"), "dedup-whole")
    groups = whole.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = written(spark, groups, "dedup-groups")
    out = whole.join(groups, ["n_blocks", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "name",
        "n_blocks",
    )

