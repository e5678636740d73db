"""Embedding whitening: principal components of exactly centred integer vectors, by a row matrix.

Every entry c becomes x = floor(scale * c), a whole number. The fit list holds each distinct x vector
once; n is its length and S its sum per dimension. A row is centred without rounding as n * x - S (n times
its distance from the mean). ``RowMatrix.computeGramianMatrix`` over those rows, divided by n (and by n
squared, for the factor), is the covariance; it is summed on the executors, and only d * d figures reach the
driver. There ``eigh`` solves it, and the broadcast components whiten all rows in ``mapInPandas``.
identity_error is measured: a pass over the fit list takes the mean of the whitened values, a second one
their centred products.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped; an empty vector has no
components and so no rows. Vectors of another length are fitted and whitened among themselves (a few jobs
for each length). Repeated rows are in the fit list once, and each has its rows in the result; ids, null
ones too, are passed on as they are. Entries beyond the range of a long saturate. A deviation beyond it is
null. A component without variance (an eigenvalue that is zero but for rounding, as of a fit list of one
vector) has whitened values of null and is left out of identity_error, which is null if none is left;
without any variance explained is null. An empty table gives an empty result. Only the id and vector columns
are read, so others cannot clash. d is at most 65,535, the row matrix's limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import written

SCALE, COMPONENTS = 256, 4
#: The largest value of a long.
LONG = (1 << 63) - 1


@dataclass
class Fit:
    """What one length's rows are whitened with."""

    n: int
    sums: list[int]
    most: int  # the largest absolute entry
    components: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues; 0 where there is no variance
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they suffice, Python's whole numbers elsewhere."""
        if 2 * self.n * self.most <= LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        if len(self.sums) * (2 * self.n * self.most) ** 2 <= LONG:
            return (y * y).sum(1).tolist()
        return [s if s <= LONG else None for s in ((row * row).sum() for row in y.astype(object))]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """nan for a component without variance."""
        size = np.where(self.values > 0, self.n * np.sqrt(self.values), np.nan)
        return y.astype(np.float64) @ self.components / size


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def _centred(fit: DataFrame, n: int, sums: list[int], most: int) -> DataFrame:
    """The rows n * x - S as one column of vectors, each difference exact before it becomes a double."""
    kind = "bigint" if 2 * n * most <= LONG else "decimal(38,0)"
    total = F.from_json(F.lit("[" + ",".join(map(str, sums)) + "]"), f"array<{kind}>")
    rows = F.zip_with("x", total, lambda x, s: (x.cast(kind) * F.lit(n).cast("bigint") - s).cast("double"))
    return MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(rows).alias("v")), "v")


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """(components, eigenvalues, explained) of the largest eigenvalues; an eigenvalue within rounding of 0
    becomes 0. A component's entry of the largest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    least = max(0.0, float(values[0])) * len(covariance) * np.finfo(float).eps
    values = np.where(values > least, values, 0.0)
    trace = float(np.trace(covariance))
    return vectors, values, [float(v) / trace if trace > 0 else None for v in values]


def _identity_error(fit: DataFrame, found: Fit) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity, over the fit list."""
    alive = np.flatnonzero(found.values > 0)
    if not len(alive):
        return None
    k = len(alive)
    shared = fit.sparkSession.sparkContext.broadcast(found)

    def summed(mean: np.ndarray | None) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one: Fit = shared.value
            total = np.zeros(k if mean is None else k * k)
            for frame in frames:
                w = one.whitened(one.centred(np.stack(frame["x"].to_list())))[:, alive]
                total += w.sum(0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
            yield pd.DataFrame({"cell": np.arange(len(total)), "value": total})

        sums = fit.mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        return np.array([r["value"] for r in sorted(sums, key=lambda r: r["cell"])]) / found.n

    mean = summed(None)
    return float(np.abs(summed(mean).reshape(k, k) - np.eye(k)).max())


def fitted(fit: DataFrame, n: int, sums: list[int], most: int, components: int = COMPONENTS) -> Fit:
    """fit: distinct x vectors of one length."""
    gram = RowMatrix(_centred(fit, n, sums, most)).computeGramianMatrix().toArray()
    return Fit(n, sums, most, *components_of(gram / n / float(n) ** 2, components))


def whiten(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Returns for each remaining row and each of the first components: id_col, component (from 1), n,
    deviation (sum of (n * x - S) squared), whitened, explained, identity_error."""
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale))
    kept = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), x.alias("x"))
    fit = written(spark, kept.select("x").distinct(), "whitening")
    entries = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "c"))
    figures = entries.groupBy("d", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.max("c").alias("high"), F.min("c").alias("low"))
    by_length: dict[int, list] = {}
    for r in sorted(figures.collect(), key=lambda r: (r["d"], r["at"])):  # a row per dimension
        by_length.setdefault(r["d"], []).append(r)
    schema = T.StructType(
        [T.StructField(id_col, kept.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )

    def output(d: int, cells: list) -> DataFrame:
        own = fit.filter(F.size("x") == d)
        found = fitted(own, cells[0]["n"], [int(r["s"]) for r in cells], max(max(r["high"], -r["low"]) for r in cells), components)
        error = _identity_error(own, found)
        shared = spark.sparkContext.broadcast(found)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one: Fit = shared.value
            k = len(one.values)
            for frame in frames:
                if len(frame):
                    y = one.centred(np.stack(frame["x"].to_list()))
                    w = one.whitened(y)
                    yield pd.DataFrame(
                        {
                            id_col: frame["id"].repeat(k).to_numpy(),
                            "component": np.tile(np.arange(1, k + 1), len(frame)),
                            "n": one.n,
                            "deviation": pd.Series(one.deviations(y), dtype="Int64").repeat(k).to_numpy(),
                            "whitened": pd.Series(w.ravel(), dtype="float64").where(lambda v: v.notna(), None),
                            "explained": pd.Series(one.explained * len(frame), dtype="float64"),
                            "identity_error": pd.Series([error] * (k * len(frame)), dtype="float64"),
                        }
                    )

        return kept.filter(F.size("x") == d).mapInPandas(run, schema)

    return reduce(DataFrame.unionAll, [output(d, cells) for d, cells in by_length.items()], spark.createDataFrame([], schema))
