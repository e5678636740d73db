"""Embedding near-dedup by a tiled comparison in the order of principal axes.

Unit vectors are rotated to their principal axes (of the second moments about the origin, where cosines are
taken; summed over all vectors by a row matrix), so that the leading coordinates hold most of the length.
Rows are sorted by their cells of the leading coordinates and cut into tiles. Two tiles are compared unless
their boxes lie too far apart for the cosine asked for. A comparison first takes the products of the leading
coordinates; with the product of the norms of what is left (the suffixes) that is a bound of the cosine,
and pairs under the threshold stop there. The others take twice as many coordinates, again and again, until
they are dropped or the sum is whole. What is left is decided by the plain cosine of the given vectors in
double precision. Axes, tiles and bounds change the cost, never the result. Blocks that are so tight that every
pair must be linked are counted without products.

Equal vectors are one class with a count, so copies of one vector cost one row. A comparison returns the
number of links of each class and the edges of a spanning forest, never all pairs of a group; the classes
are then joined by ``components``. All pairs of tiles that may hold links are compared, so the work grows with
the square of the vectors that lie near one another along the axes.

Cases: a vector that is null, empty, zero, or has a null or non-finite entry links with nothing, and neither
do vectors of different lengths. Such a row is its own component. Ids may be null or repeated: a row is a
vector of its own; component_id is the least id that is not null, null if there is none, and kept tells
whether the row's id equals it (both null included). Entries of any size are scaled first. An empty table
gives an empty result. Only the id and vector columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import written
from parlance.llm.components import components
from parlance.llm.whitening import usable

THRESHOLD = 0.9
#: Bytes of a tile's vectors, rows of it that are compared at once, coordinates of the first bound.
TILE_BYTES, BLOCK, LEADING = 4 << 20, 512, 16
#: Coordinates that order the rows, and that a tile's box has.
CELLS, BOX = 4, 16
#: Lengths that get axes of their own, the most frequent first, and the longest of them; others keep their own order of coordinates.
AXES, AXES_LENGTH = 8, 1024
#: What rounding may take from a bound in single precision, and from a cosine in double.
SINGLE, DOUBLE = 1e-5, 1e-12


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest entry first, so that no square over- or underflows."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def principal_axes(units: DataFrame) -> np.ndarray | None:
    """units: column u of unit vectors of one length. Their second moments' eigenvectors, the largest first."""
    rows = MLUtils.convertVectorColumnsFromML(units.select(array_to_vector("u").alias("u")), "u")
    gram = RowMatrix(rows).computeGramianMatrix().toArray()
    return np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else None


class Comparison:
    """The links between two tiles."""

    def __init__(self, threshold: float, axes: np.ndarray | None):
        self.threshold, self.axes = threshold, axes

    def _prepared(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(rotated unit vectors, squared norms of what follows each step, leading part and its suffix
        norm in single precision, steps)."""
        unit = _unit(values)
        turned = unit if self.axes is None else unit @ self.axes
        d = turned.shape[1]
        steps = [min(d, LEADING)]
        while steps[-1] < d:
            steps.append(min(d, 2 * steps[-1]))
        after = np.stack([np.sqrt((turned[:, s:] ** 2).sum(1)) for s in steps], 1)
        return turned, after, np.hstack([turned[:, : steps[0]], after[:, :1]]).astype(np.float32), steps

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Plain cosines of rows a and b."""
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))

    def _decided(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs at the threshold or above; those within rounding of it by their plain cosines."""
        linked = cosine >= self.threshold
        near = np.flatnonzero(np.abs(cosine - self.threshold) < DOUBLE)
        if len(near):
            linked[near] = self._exact(a[left[near]], b[right[near]]) >= self.threshold
        return left[linked], right[linked]

    def links(self, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """a, b: vectors as rows (same: b is a, and each pair is looked at once). Yields index arrays of
        linked pairs, block by block."""
        turned_a, after_a, lead_a, steps = self._prepared(a)
        turned_b, after_b, lead_b, _ = (turned_a, after_a, lead_a, steps) if same else self._prepared(b)
        reach = np.sqrt(max(0.0, 2 - 2 * self.threshold)) - 1e-9  # as far apart as unit vectors that must be linked can be
        for at in range(0, len(a), BLOCK):
            stop = min(len(a), at + BLOCK)
            for first in range(at if same else 0, len(b), 8 * BLOCK):
                last = min(len(b), first + 8 * BLOCK)
                shape = (stop - at, last - first)
                # a block is tight if its rows lie around its first row so near that none can be too far from another
                ends = turned_a[at], turned_b[first]
                wide = [np.sqrt(((x - e) ** 2).sum(1).max()) for x, e in zip((turned_a[at:stop], turned_b[first:last]), ends, strict=True)]
                if wide[0] + wide[1] + np.sqrt(((ends[0] - ends[1]) ** 2).sum()) < reach:
                    left, right = np.indices(shape).reshape(2, -1)
                    left, right = left + at, right + first
                    if same:
                        left, right = left[left < right], right[left < right]
                    yield left, right
                    continue
                possible = lead_a[at:stop] @ lead_b[first:last].T >= np.float32(self.threshold - SINGLE)
                if same:
                    possible &= np.arange(at, stop)[:, None] < np.arange(first, last)[None, :]
                left, right = np.nonzero(possible)
                if not len(left):
                    continue
                left, right = left + at, right + first
                if len(left) * 8 > possible.size:  # dense: one product of all coordinates is cheaper than gathering
                    cosine = (turned_a[at:stop] @ turned_b[first:last].T)[left - at, right - first]
                else:
                    cosine = np.einsum("ij,ij->i", turned_a[left, : steps[0]], turned_b[right, : steps[0]])
                    for k in range(1, len(steps)):
                        part = slice(steps[k - 1], steps[k])
                        cosine = cosine + np.einsum("ij,ij->i", turned_a[left, part], turned_b[right, part])
                        stay = cosine + after_a[left, k] * after_b[right, k] >= self.threshold - DOUBLE
                        left, right, cosine = left[stay], right[stay], cosine[stay]
                yield self._decided(a, b, left, right, cosine)


def forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """labels: the least member known of each member's set. Joined with the edges left-right, by hooking
    roots onto lesser ones and halving paths until nothing changes."""
    while len(left):
        a, b = labels[left], labels[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _cells(lead: np.ndarray, width: float) -> np.ndarray:
    out = np.zeros((len(lead), CELLS), np.int64)
    k = min(CELLS, lead.shape[1])
    out[:, :k] = np.floor(lead[:, :k] / width)
    return out


def _gap(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """Squared distance of two boxes."""
    sides = F.zip_with(
        F.zip_with(a_low, b_high, lambda x, y: x - y), F.zip_with(b_low, a_high, lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)
    )
    return F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)


def link_vectors(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Returns per row: id_col, n_links (other rows whose cosine is the threshold or more), component_id,
    kept. threshold: above 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = source.filter(usable(F.col("v")) & F.exists("v", lambda c: c != 0))
    classes = good.groupBy("v").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("least"))
    classes = written(spark, classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = np.dtype("<f4") if classes.schema["v"].dataType.elementType.typeName() == "float" else np.dtype("<f8")

    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(AXES).collect()
    total = classes.count()

    def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, entries) of vectors without nulls."""
        offsets = column.offsets.to_numpy()
        return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = values_of(batch.column(0))
            if batch.num_rows:
                unit = _unit(flat.reshape(batch.num_rows, -1))  # the vectors of one length
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(unit.ravel()))], ["u"])

    def axes_of(d: int) -> np.ndarray | None:
        return principal_axes(classes.filter(F.size("v") == d).select("v").mapInArrow(lengthened, "u array<double>"))

    axes = spark.sparkContext.broadcast({r["d"]: axes_of(r["d"]) for r in lengths if r["d"] <= AXES_LENGTH})
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6)))

    keys = ["d", *[f"c{k}" for k in range(CELLS)], "p"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the sort key: length, cells of the leading coordinates, the first coordinate."""
        for batch in batches:
            offsets, flat = values_of(batch.column(0))
            lengths = np.diff(offsets)
            cells, first = np.zeros((len(lengths), CELLS), np.int64), np.zeros(len(lengths))
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                unit = _unit(np.stack([flat[offsets[i] : offsets[i] + d] for i in own]))
                turned = axes.value.get(int(d))
                lead = unit if turned is None else unit @ turned[:, :CELLS]
                cells[own], first[own] = _cells(lead, width), lead[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), *[pa.array(c) for c in cells.T], pa.array(first)], [*batch.schema.names, *keys])

    kind = classes.schema["v"].dataType.simpleString()
    schema = f"v {kind}, node long, times long, d int, " + ", ".join(f"c{k} long" for k in range(CELLS)) + ", p double"
    sorted_rows = classes.select("v", "node", "times").mapInArrow(placed, schema)
    bytes_all = total * size.itemsize * (lengths[0]["d"] if lengths else 1)
    sorted_rows = sorted_rows.repartitionByRange(max(1, -(-bytes_all // (8 * tile_bytes))), *keys, "node").sortWithinPartitions(*keys, "node")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one length as one row each."""
        held: list[pa.RecordBatch] = []

        def tile(part: pa.Table, d: int) -> pa.RecordBatch:
            _, flat = values_of(part.column("v").combine_chunks())
            unit = _unit(flat.reshape(-1, d))
            turned = axes.value.get(d)
            lead = (unit if turned is None else unit @ turned)[:, :BOX]
            cells = [[d], [flat.astype(size).tobytes()], [part.column("node").to_numpy().astype("<i8").tobytes()], [part.column("times").to_numpy().astype("<i8").tobytes()], [lead.min(0)], [lead.max(0)]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["d", "values", "nodes", "times", "low", "high"])

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            whole = pa.Table.from_batches(held)
            d = whole.column("d").to_numpy()
            at = 0
            while at < len(d):
                run = at + int(np.searchsorted(d[at:], d[at], side="right"))
                stop = min(run, at + max(1, tile_bytes // (int(d[at]) * size.itemsize)))
                if stop == len(d) and not last:
                    break
                yield tile(whole.slice(at, stop - at), int(d[at]))
                at = stop
            held = whole.slice(at).combine_chunks().to_batches() if at < len(d) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from cut(False)
        if held:
            yield from cut(True)

    columns = "d int, values binary, nodes binary, times binary, low array<double>, high array<double>"
    tiles = sorted_rows.mapInArrow(tiled, columns).withColumn("raw", F.monotonically_increasing_id())
    tiles = written(spark, tiles, "tiles")
    # tiles get numbers without gaps: a partition's come after those of the ones before it (a figure for each partition)
    part = F.shiftright("raw", 33)
    counts = {r["part"]: r["n"] for r in tiles.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([counts.get(k, 0) for k in range(max(counts, default=-1) + 1)])))
    starts = F.from_json(F.lit("[" + ",".join(map(str, before)) + "]"), "array<bigint>")
    tiles = tiles.withColumn("tile", F.get(starts, part.cast("int")) + F.col("raw").bitwiseAND((1 << 33) - 1)).drop("raw")

    boxes = tiles.select("tile", "d", "low", "high")
    later = boxes.select(F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("a"), F.col("tile").alias("b"), F.col("d").alias("bd"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    may = later.join(boxes, (F.col("a") == F.col("tile")) & (F.col("d") == F.col("bd"))).filter(_gap("low", "high", "bl", "bh") <= 2 - 2 * threshold + 1e-9).select("a", "b")
    held = ("values", "nodes", "times")
    work = may.join(tiles.select(F.col("tile").alias("a"), "d", *held), "a")
    work = work.join(tiles.select(F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in held]), "b")
    work = work.select("d", (F.col("a") == F.col("b")).alias("same"), *held, *[f"b_{c}" for c in held])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pair of tiles: (node, null, links) and the edges of a forest as (node, least node, 0)."""
        for batch in batches:
            for row in batch.to_pylist():
                d, same = row["d"], row["same"]
                a, b = (np.frombuffer(row[c], size).astype(np.float64).reshape(-1, d) for c in ("values", "b_values"))
                nodes, times = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["times"], "<i8")
                if not same:
                    nodes, times = np.concatenate([nodes, np.frombuffer(row["b_nodes"], "<i8")]), np.concatenate([times, np.frombuffer(row["b_times"], "<i8")])
                shift = 0 if same else len(a)
                found, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for left, right in Comparison(threshold, axes.value.get(d)).links(a, b, same):
                    right = right + shift
                    for one, other in ((left, right), (right, left)):
                        found += np.bincount(one, times[other], len(nodes)).astype(np.int64)
                    labels = forest(labels, left, right)
                some, joined = np.flatnonzero(found), np.flatnonzero(labels != np.arange(len(labels)))
                one = np.concatenate([nodes[some], nodes[joined]])
                other = pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[labels[joined]]]), mask=np.arange(len(one)) < len(some))
                yield pa.RecordBatch.from_arrays([pa.array(one), other, pa.array(np.concatenate([found[some], np.zeros(len(joined), np.int64)]))], ["a", "b", "n"])

    links = written(spark, work.mapInArrow(compared, "a long, b long, n long"), "links", batch_rows=1)
    sums = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(spark, links.filter("b is not null").select("a", "b"))
    linked = classes.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    result = linked.join(least, "root").select("v", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    out = source.join(result, "v", "left")
    own = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
