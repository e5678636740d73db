"""Bootstrap intervals of a mean, over many tasks.

``bootstrap_ci`` has the published draws: one seeded generator whose whole numbers below n index the rows
of 10,000 resamples, group after group. The generator is a stream of 32-bit words, and whether a word
is drawn or rejected depends on the word alone. So tasks jump ahead to blocks of the stream and count what they
would accept; prefix sums of the counts say at which word each resample begins; other tasks draw their
resamples from there. Values travel as packed doubles, once to each task, in ranges of ``RANGE`` rows, and not through
the driver, which sees counts only. With up to RANGE rows the results equal numpy's to the last bit; beyond that a
resample's sum is added up from ranges, which each draw the same words again. A task holds 8 bytes a row of its range:
drawn values are added as they come, in numpy's order.

``poisson_bootstrap_ci`` has another order of draws: a row's weights come from a hash of its key, so any
number of rows is read once and a task sends a sum per resample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import lineage

SAMPLES, SEED = 10_000, 42
#: Words of a counted block, least draws of a task, tasks of a group for each core, rows of a range.
BLOCK, TASK_DRAWS, TASKS_A_CORE, RANGE = 1 << 22, 1 << 25, 4, 1 << 25
#: Words that a task draws at once; resamples of a task of the other form.
HELD, WEIGHTS = 1 << 16, 1 << 20


class Stream:
    """The whole numbers below n that the seeded generator draws, from any place of its words on."""

    def __init__(self, seed: int, n: int):
        if not 0 < n < 1 << 32:
            raise ValueError("the published draws are for up to 2^32 - 1 rows; poisson_bootstrap_ci takes any number")
        self.seed, self.n = seed, n
        self.least = (1 << 32) % n  # a word whose product has less in its lower half is rejected

    def words(self, first: int, count: int) -> Iterator[np.ndarray]:
        """count 32-bit words from word ``first`` on, in parts: the halves of 64-bit draws, the lower one first."""
        bits = np.random.PCG64(self.seed)
        bits.advance(first // 2)
        odd = first % 2
        while count > 0:
            raw = bits.random_raw((min(count, HELD) + odd + 1) // 2).view("<u4")[odd:][:count]
            odd, count = (odd + len(raw)) % 2, count - len(raw)
            if odd and count:  # stay on whole draws
                bits.advance((1 << 128) - 1)
            yield raw

    def accepted(self, first: int, count: int) -> int:
        if not self.least:
            return count
        n, least = np.uint32(self.n), np.uint32(self.least)
        return sum(int(np.count_nonzero(w * n >= least)) for w in self.words(first, count))  # the product's lower half

    def generator(self, first: int) -> np.random.Generator:
        """numpy's generator, with word ``first`` as the next one."""
        bits = np.random.PCG64(self.seed)
        bits.advance(first // 2)
        if first % 2:  # the upper half of a draw that was begun
            raw = int(bits.random_raw())
            bits.state = bits.state | {"has_uint32": 1, "uinteger": raw >> 32}
        return np.random.Generator(bits)

    def drawn(self, first: int) -> Iterator[np.ndarray]:
        """The numbers from word ``first`` on, without end."""
        draw = self.generator(first)
        while True:
            yield draw.integers(0, self.n, size=HELD)

    def sums(self, x: np.ndarray, low: int, first: int, skip: int, count: int) -> Iterator[float]:
        """Of ``count`` resamples, after ``skip`` numbers from word ``first`` on: what they take from x, the values
        of the rows from ``low`` on, summed."""
        draw = self.generator(first)
        for at in range(0, skip, HELD):
            draw.integers(0, self.n, size=min(HELD, skip - at))
        taken, whole = np.empty(HELD), len(x) == self.n

        def total(count: int) -> float:
            """The next ``count`` numbers' values, added in the order in which numpy adds up an array of them all."""
            if count > HELD:
                half = count // 2 - count // 2 % 8
                return total(half) + total(count - half)
            v = draw.integers(0, self.n, size=count)
            if whole:
                return np.take(x, v, out=taken[:count], mode="clip").sum()
            v -= low
            return x[v[(v >= 0) & (v < len(x))]].sum()

        for _ in range(count):
            yield total(self.n)


def _accepted_blocks(spark, stream: Stream, first: int, draws: int) -> list[int]:
    """Accepted words of blocks from word ``first`` on, as many as hold the draws."""
    found: list[int] = []
    share = 1 - stream.least / (1 << 32)
    while sum(found) < draws:
        begin = len(found)
        more = max(1, -(-int((draws - sum(found)) / share) // BLOCK) + 1)

        def run(batches: Iterator[pa.RecordBatch], stream=stream) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stream.accepted(first + b * BLOCK, BLOCK) for b in blocks], pa.int64())], ["id", "n"])

        tasks = min(more, 8 * spark.sparkContext.defaultParallelism)
        rows = spark.range(begin, begin + more, 1, tasks).mapInArrow(run, "id long, n long").collect()  # a count for each block
        found += [r["n"] for r in sorted(rows, key=lambda r: r["id"])]
    return found


def _plan(spark, sizes: list[tuple[str, int]], samples: int, seed: int) -> list[tuple]:
    """Tasks: (group, n, task, first resample, resamples, first word, draws to skip)."""
    out, word = [], 0
    for k, (group, n) in enumerate(sizes):
        each = max(1, TASK_DRAWS // n, -(-samples // (TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
        if n == 1:  # one row needs no draw
            out.append((group, n, len(out), 0, samples, 0, 0))
            continue
        stream = Stream(seed, n)
        counts = np.array(_accepted_blocks(spark, stream, word, samples * n), np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        for at in range(0, samples, each):
            block = int(np.searchsorted(ends, at * n, side="right")) - 1
            out.append((group, n, len(out), at, min(each, samples - at), word + block * BLOCK, at * n - int(ends[block])))
        if k + 1 < len(sizes):  # the next group goes on after the word of the last draw
            block = int(np.searchsorted(ends, samples * n, side="left")) - 1
            word, left = word + block * BLOCK, samples * n - int(ends[block])
            for w in stream.words(word, BLOCK):
                taken = np.cumsum(((w.astype(np.uint64) * np.uint64(n)) & np.uint64(0xFFFFFFFF)) >= np.uint64(stream.least))
                if taken[-1] >= left:
                    word += int(np.searchsorted(taken, left)) + 1
                    break
                word, left = word + len(w), left - int(taken[-1])
    return out


def bootstrap_ci(pairs: DataFrame, metric: str, key: str = "source_index", groups: tuple[str, ...] | None = None, by: str = "eval_type", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """The published interval: resampled means with one generator, which runs on from group to group. Rows are
    in the order of their keys as strings (of equal keys the lesser value first); a null value makes its group's results null.
    Sorting and counting run at once. Returns (group or 'all'), n, mean, low, high; a group without rows has none."""
    spark = pairs.sparkSession
    rows = pairs.select(F.col(by).alias("g") if groups else F.lit("all").alias("g"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(metric).cast("double"), F.lit(float("nan"))).alias("x"))
    if groups:
        rows = rows.filter(F.col("g").isin(*groups))
    placed = lineage.cut(rows.repartitionByRange("g", "k", "x").sortWithinPartitions("g", "k", "x").select("g", "x", F.monotonically_increasing_id().alias("i")))
    part = F.shiftright("i", 33)
    seen = placed.groupBy("g", part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).collect()  # a row for each task and group
    sizes, shifts = {}, []
    for r in sorted(seen, key=lambda r: (r["g"], r["p"])):
        shifts.append((r["g"], r["p"], sizes.get(r["g"], 0) - r["first"]))
        sizes[r["g"]] = sizes.get(r["g"], 0) + r["n"]
    order = [(g, sizes[g]) for g in (groups or ("all",)) if g in sizes]
    schema = "group string, n long, mean double, low double, high double"
    if not order:
        return spark.createDataFrame([], schema)
    offsets = F.broadcast(spark.createDataFrame(shifts, "g string, p long, shift long"))
    placed = placed.withColumn("p", part).join(offsets, ["g", "p"]).select("g", "x", (F.col("i") + F.col("shift")).alias("i"))
    plan = _plan(spark, order, samples, seed)
    tasks = F.broadcast(spark.createDataFrame(plan, "g string, n long, task long, at long, count long, word long, skip long"))  # TASKS_A_CORE a core and group, samples at most
    many = len(plan) * max(-(-n // RANGE) for _, n in order)
    size = RANGE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values of rows that follow one another within a range: (group, range, first row, doubles)."""
        for batch in batches:
            g, x, i = pa.array(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            code = g.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(i) != 1) | (np.diff(code) != 0) | (np.diff(i // size) != 0)) + 1
            first, last = np.concatenate(([0], cuts)), np.append(cuts, len(i))
            if len(i):
                packed = pa.array([x[a:b].tobytes() for a, b in zip(first, last)], pa.binary())
                yield pa.RecordBatch.from_arrays([g.take(pa.array(first)), pa.array(i[first] // size), pa.array(i[first]), packed], ["g", "q", "i", "values"])

    parts = placed.select("g", "x", "i").mapInArrow(pack, "g string, q long, i long, values binary")
    work = parts.join(tasks, "g").repartitionById(many, F.pmod(F.col("task") + F.col("q") * len(plan), F.lit(many)).cast("int"))  # a task and range each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, resample, sum of its values in this range); resample -1 is the sum of the range itself."""
        one = x = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if one is None:
                one = {c: batch.column(c)[0].as_py() for c in ("g", "n", "q", "at", "count", "word", "skip")}
                n, low = one["n"], one["q"] * size
                x = np.empty(min(size, n - low))
            for i, values in zip(batch.column("i").to_pylist(), batch.column("values")):
                v = np.frombuffer(values.as_buffer(), np.float64)
                x[i - low : i - low + len(v)] = v
        if one is None:
            return
        batch = None
        sums = list(Stream(seed, n).sums(x, low, one["word"], one["skip"], one["count"])) if n > 1 else [x.sum()] * one["count"]
        at = np.arange(one["at"], one["at"] + one["count"])
        if one["at"] == 0:
            sums, at = [*sums, x.sum()], np.append(at, -1)
        yield pa.RecordBatch.from_arrays([pa.array([one["g"]] * len(at)), pa.array(at), pa.array(sums, pa.float64()), pa.array([n] * len(at))], ["g", "r", "s", "n"])

    means = work.mapInArrow(run, "g string, r long, s double, n long").groupBy("g", "r").agg((F.sum("s") / F.first("n")).alias("m"), F.first("n").alias("n"))

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = np.quantile(frame.loc[frame["r"] >= 0, "m"].to_numpy(), [0.025, 0.975])
        return pd.DataFrame({"group": frame["g"].iloc[:1], "n": frame["n"].iloc[0], "mean": frame.loc[frame["r"] < 0, "m"].iloc[0], "low": low, "high": high})

    return means.groupBy("g").applyInPandas(interval, schema)  # samples + 1 rows a group


def poisson_bootstrap_ci(pairs: DataFrame, metric: str, key: str = "source_index", samples: int = 1000, seed: int = SEED) -> DataFrame:
    """The interval for data of any size: each row counts Poisson(1) times in each resample, by a hash of
    row and resample. Null values are left out. Returns mean (of the resampled means), low, high."""
    total, steps, term = 0.0, [], float(np.exp(-1.0))
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(samples), np.zeros(samples)
        place = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, x = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            step = max(1, WEIGHTS // samples)
            for at in range(0, len(h), step):
                z = h[at : at + step, None] + place
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                w = np.searchsorted(steps, u, side="right").astype(np.float64)
                weights += w.sum(0)
                sums += x[at : at + step] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(weights), pa.array(sums)], ["b", "w", "s"])

    hashed = pairs.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(metric).cast("double").alias("x")).filter(F.col("x").isNotNull())
    means = hashed.mapInArrow(run, "b long, w double, s double").groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(q.alias("q"), F.avg("m").alias("mean")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
