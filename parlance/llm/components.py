"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every greater neighbour of a node goes to the node's least neighbour. Small star:
    the node and its lesser neighbours do. The least is combined before the shuffle. The edges meet
    it in a join both sides of which are shuffled for it, so that adaptive execution can split the
    partition of a node that everything hangs on."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
    least = least.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # else its aggregation's layout holds, which cannot be split
    joined = both.join(least, F.col("a") == F.col("n"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: long a, b. Returns node, root: the least node of its component, for each node that has
    an edge. Every round's edges are written to the shared folder; there are about log(n) rounds."""
    now = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # done when every edge leads to a node that has none onward and no node has two
    while True:
        heads = now.select(F.col("b").alias("head")).distinct()
        onward = now.join(heads, F.col("a") == F.col("head"), "left_semi").select("a")
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        if onward.unionByName(twice).isEmpty():
            break
        now = written(spark, _star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
