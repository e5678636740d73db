"""N-gram Jaccard join by a MinHash LSH forest.

A text's set is that of its shingles of ``words`` consecutive words (a text of fewer words is one
shingle). Texts with the same set are copies: one of them stands for all. Every text has ``trees``
labels, each the first ``max_depth`` values of a MinHash signature of its own; the labels of a tree,
sorted, are its prefix trie.

Texts that share a prefix of the ``floor_depth`` in some tree can meet; connected, they form a
candidate set, which is brought together. There the forest is walked: all texts start with their
whole labels, and each shortens its prefixes step by step, meeting those that sort under the same
prefix in some tree, until it has met every text whose size allows the similarity, or the prefix is
so short that a pair at the threshold has met with the target recall. Pairs that have met, and no
others, are verified exactly on the shingle sets.

No pairs are emitted. A candidate set is cut into blocks by hash, of BLOCK texts and at most SPLIT of
them unless their bytes ask for more, and a task holds two blocks; it returns, for each text, the
number of texts (and of documents, copies counted) it is similar to, and a spanning forest of the
similar pairs. The forest's components are the classes, so a group of thousands of near copies costs
a row per text and block, and loses no link.

Cases: a null or wordless text has no shingles: it is similar to nothing and a class of its own.
Repeated rows, ids included, are copies of one another. Very long texts are taken whole, split into
words a part at a time. An empty table gives an empty result. Only the id and text columns are read,
so others cannot clash, and ``drop_similar`` finds names for its own that none of docs has. Rows are
numbered once, in a written table, so a later read in other splits finds the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import fresh, numbered, written
from parlance.llm.components import components
from parlance.llm.decontaminate import plain_parts

WORDS, SIMILARITY = 5, 0.8
TREES, MAX_DEPTH, RECALL = 20, 8, 0.999
#: Texts of one block of a candidate set; the blocks that a set is cut into; and bytes of shingles at
#: which there are more.
BLOCK, SPLIT, BLOCK_BYTES = 256, 32, 8 << 20
#: Texts of each side whose pairs are looked at together.
TILE = 512
#: Bytes of text that are hashed at once; a word of more bytes than LONG_WORD is hashed by itself.
PART_BYTES, LONG_WORD = 1 << 20, 1 << 16
#: Rows of an Arrow batch of texts or shingle sets.
BATCH_ROWS = 1000
_SEED = 20240229


def floor_depth(trees: int, max_depth: int, similarity: float, recall: float) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with this chance."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit numbers of words: the sum of each byte's random number times a power of an odd base, by
    the word's place in its part; divided by the power at the word's start, it is the same anywhere."""

    def __init__(self):
        draw = np.random.default_rng(_SEED)
        self.letter = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b)))) for b in (self.base, self.inverse))

    def __call__(self, plain: bytes) -> tuple[np.ndarray, np.ndarray]:
        """plain: words parted by spaces. Their numbers, and their places."""
        if len(plain) > LONG_WORD and b" " not in plain:
            return np.array([xxhash.xxh64_intdigest(plain, _SEED)], np.uint64), np.zeros(1, np.int64)
        data = np.frombuffer(plain, np.uint8)
        self._powers(len(data) + 1)
        edge = np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letter[data] * self.up[: len(data)])))
        numbers = _mix((sums[end] - sums[start]) * self.down[start])
        for k in np.flatnonzero(end - start > LONG_WORD).tolist():
            numbers[k] = xxhash.xxh64_intdigest(plain[start[k] : end[k]], _SEED)
        return numbers, start


class Shingler:
    """Sorted, distinct 64-bit shingle numbers of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.hash = words, WordHasher()

    def _numbers(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(0, len(rows) - size + 1), np.uint64)
        for k in range(size if len(out) else 0):
            out = _mix(out + rows[k : len(rows) - size + 1 + k])
        return out

    def _set(self, rows: np.ndarray) -> np.ndarray:
        return np.unique(self._numbers(rows, min(self.words, len(rows)))) if len(rows) else np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Texts are hashed together, PART_BYTES at a time; a longer one alone, part by part."""
        out, waiting, size = [], [], 0
        for text in texts:
            if text is not None and len(text) > PART_BYTES:
                out += self._together(waiting)
                waiting, size = [], 0
                out.append(self._set(np.concatenate([np.zeros(0, np.uint64), *[self.hash(part)[0] for part in plain_parts(text, PART_BYTES)]])))
                continue
            waiting.append(text or b"")
            size += len(waiting[-1]) + 1
            if size > PART_BYTES:
                out += self._together(waiting)
                waiting, size = [], 0
        return out + self._together(waiting)

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        rows, start = self.hash(b"".join(plain for t in texts for plain in (*plain_parts(t, len(t) + 1), b" ")))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
        runs, out, at = self._numbers(rows, self.words), [], 0
        for end in ends:
            out.append(np.unique(runs[at : end - self.words + 1]) if end - at >= self.words else self._set(rows[at:end]))
            at = end
        return out


class Signer:
    """Labels of MinHash signatures: 16 bits of each value, ``depth`` values per tree."""

    def __init__(self, trees: int, depth: int):
        draw = np.random.default_rng(_SEED)
        self.trees, self.depth = trees, depth
        self.factor = draw.integers(1, 1 << 31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, (trees * depth, 1), dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Big-endian, so that labels sort as bytes."""
        folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.factor), np.uint32(0xFFFFFFFF))
        for k in range(0, len(folded), 512):  # stays in cache, whatever the text's length
            part = folded[None, k : k + 512] ^ self.shift
            part *= self.factor
            np.minimum(least, part.min(axis=1), out=least)
        return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")


def _slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _sign(words: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(trees, depth)
        for batch in (p for b in batches for p in _slices(b)):
            sets = shingler([x.as_py() for x in batch.column(2)])
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            labels = [signer(s).tobytes() if len(s) else None for s in sets]
            columns = [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "set_key", "n_shingles", "labels"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in (p for b in batches for p in _slices(b, 100)):
            sets = [s.tobytes() for s in shingler([x.as_py() for x in batch.column(batch.num_columns - 1)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "shingles"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, by matrix products over
    the shingles that both sides hold, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    row_a, row_b = (np.repeat(np.arange(len(x), dtype=np.int32), [len(s) for s in x]) for x in (left, right))
    parts = []
    for values, rows in ((a, row_a), (b, row_b)):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        parts.append((at[hit][order], rows[hit][order]))
    for k in range(0, len(common), 2048):
        wide = min(2048, len(common) - k)
        dense = []
        for (at, rows), n in zip(parts, (len(left), len(right))):
            lo, hi = np.searchsorted(at, (k, k + wide))
            m = np.zeros((n, wide), np.float32)
            m[rows[lo:hi], at[lo:hi] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _places(labels: np.ndarray, depth: int) -> np.ndarray:
    """Of each text (row) in each tree (column): the place of its prefix among the sorted ones."""
    out = np.empty(labels.shape[:2], np.int32)
    for tree in range(labels.shape[1]):
        prefix = np.ascontiguousarray(labels[:, tree, :depth]).view(f"V{2 * depth}").ravel()
        out[:, tree] = np.unique(prefix, return_inverse=True)[1]
    return out


def met_pairs(left: np.ndarray, right: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], similarity: float, floor: int) -> np.ndarray:
    """left, right: labels (texts x trees x depth). Which pairs meet: prefixes shorten from whole labels
    to the floor, for each text of left until it has met all whose size allows the similarity."""
    a, b = sizes[0][:, None].astype(np.float64), sizes[1][None, :].astype(np.float64)
    fits = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    met = np.zeros(fits.shape, bool)
    for depth in range(left.shape[2], floor - 1, -1):
        rows = np.flatnonzero((fits & ~met).any(axis=1))
        if not len(rows):
            break
        places = _places(np.concatenate((left[rows], right)), depth)
        ours, theirs = places[: len(rows)], places[len(rows) :]
        now = np.zeros((len(rows), len(right)), bool)
        for tree in range(left.shape[1]):
            now |= ours[:, tree, None] == theirs[None, :, tree]
        met[rows] |= now
    return met & fits


class _Links:
    """What a group's tiles find: texts and documents each text is linked to, and pairs that join what
    was apart."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.texts, self.documents = copies, np.zeros(len(copies), np.int64), np.zeros(len(copies), np.int64)
        self.root, self.pairs = list(range(len(copies))), []

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, rows: np.ndarray, columns: np.ndarray, similar: np.ndarray, both_ways: bool) -> None:
        self.texts[rows] += similar.sum(axis=1)
        self.documents[rows] += similar @ self.copies[columns]
        if both_ways:
            self.texts[columns] += similar.sum(axis=0)
            self.documents[columns] += self.copies[rows] @ similar
        for i, j in _tree(similar):
            i, j = int(rows[i]), int(columns[j])
            a, b = self._find(i), self._find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.pairs.append((i, j))


def _tree(similar: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that connect what the matrix connects: a breadth-first search over rows and columns, a
    level at a time, one pair for each row or column that is reached."""
    rows, columns = similar.any(axis=1), similar.any(axis=0)  # not reached yet
    while rows.any():
        front = np.array([int(rows.argmax())])
        rows[front] = False
        while len(front):
            reached = np.flatnonzero(similar[front].any(axis=0) & columns)
            if not len(reached):
                break
            columns[reached] = False
            yield from zip(front[similar[np.ix_(front, reached)].argmax(axis=0)].tolist(), reached.tolist())
            front = np.flatnonzero(similar[:, reached].any(axis=1) & rows)
            rows[front] = False
            yield from zip(front.tolist(), reached[similar[np.ix_(front, reached)].argmax(axis=1)].tolist())


def _verify_group(rows: list[tuple], similarity: float, trees: int, floor: int) -> list[tuple[int, int | None, int, int]]:
    """rows: (same_block, first_block, rep, copies, labels, shingles). Returns (rep, None, texts,
    documents) for linked texts and (rep, rep, 0, 0) for pairs that connect them."""
    same = rows[0][0]
    if not same:
        rows = sorted(rows, key=lambda r: not r[1])
    n_left = len(rows) if same else sum(r[1] for r in rows)
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    labels = np.stack([np.frombuffer(r[4], ">u2").reshape(trees, -1) for r in rows])
    links = _Links(np.array([r[3] for r in rows], np.int64))
    left = [np.arange(k, min(k + TILE, n_left)) for k in range(0, n_left, TILE)]
    right = left if same else [np.arange(k, min(k + TILE, len(rows))) for k in range(n_left, len(rows), TILE)]
    for i, a in enumerate(left):
        for b in right[i:] if same else right:
            met = met_pairs(labels[a], labels[b], (sizes[a], sizes[b]), similarity, floor)
            if a is b:
                np.fill_diagonal(met, False)
                met |= met.T
            x, y = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
            if not len(x):
                continue
            both = shared_counts([sets[k] for k in a[x].tolist()], [sets[k] for k in b[y].tolist()]).astype(np.float64)
            similar = met[np.ix_(x, y)] & (both >= similarity * (sizes[a[x]][:, None] + sizes[b[y]][None, :] - both) - 1e-9)
            links.add(a[x], b[y], similar, a is not b)
    names = [r[2] for r in rows]
    out = [(names[k], None, int(links.texts[k]), int(links.documents[k])) for k in np.flatnonzero(links.texts).tolist()]
    return out + [(names[i], names[j], 0, 0) for i, j in links.pairs]


def _verify(similarity: float, trees: int, floor: int):
    """Map over rows sorted by group: (set, p, q, block, rep, copies, labels, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "texts", "documents"])

        for batch in (p for b in batches for p in _slices(b, 100)):
            for root, p, q, block, rep, copies, labels, shingles in zip(*[c.to_pylist() for c in batch.columns]):
                if (root, p, q) != group:
                    if rows:
                        out += _verify_group(rows, similarity, trees, floor)
                    group, rows = (root, p, q), []
                rows.append((p == q, block == p, rep, copies, labels, shingles))
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if rows:
            out += _verify_group(rows, similarity, trees, floor)
        yield flush()

    return run


def join_similar(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id_col, class_id (the least id of its class), class_size (documents),
    n_links (other documents of this similarity or more), n_texts (other texts), kept (one document
    of each class: of the least id, then the first row), row (its number among docs). row_col: a
    column of docs, a written table, that numbers its rows; without one they are numbered here."""
    floor = floor_depth(trees, max_depth, similarity, recall)
    if row_col is None:
        texts = numbered(spark, docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), "join-rows").select("row", "id", "text")
    else:
        texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = texts.select("row", "id", "text").mapInArrow(_sign(words, trees, max_depth), f"row long, id {texts.schema['id'].dataType.simpleString()}, set_key binary, n_shingles long, labels binary")
    signed = written(spark, signed, "join-signed", BATCH_ROWS)

    # copies: texts of the same set; one row per set stands for them
    sets = signed.filter("set_key is not null").groupBy("set_key").agg(F.min(F.struct("row", "n_shingles", "labels")).alias("s"), F.count(F.lit(1)).alias("copies"))
    sets = written(spark, sets.select("set_key", F.col("s.row").alias("rep"), "copies", F.col("s.n_shingles").alias("n_shingles"), F.col("s.labels").alias("labels")), "join-sets")

    # who shares a prefix of the floor's length hangs on the least of them
    wide = 2 * max_depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    leaves = sets.select("rep", "labels", tree).select("rep", "tree", F.substring("labels", F.col("tree") * wide + 1, F.lit(2 * floor)).alias("prefix"))
    knots = leaves.groupBy("tree", "prefix").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    knots = knots.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # so that a join can split a hot prefix
    hung = leaves.join(knots, ["tree", "prefix"]).filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    found = written(spark, components(spark, hung), "join-candidates")
    loads = found.join(sets.select(F.col("rep").alias("node"), "copies", "n_shingles", "labels"), "node")
    sizes = found.join(sets.select(F.col("rep").alias("node"), "n_shingles"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("volume"))
    blocks = F.greatest(F.least(F.ceil(F.col("size") / block), F.lit(SPLIT)), F.ceil(F.col("volume") * 8 / BLOCK_BYTES)).cast("int")
    members = loads.join(written(spark, sizes.select("root", blocks.alias("blocks")), "join-sizes"), "root")
    members = members.select("node", "root", "copies", "labels", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = written(spark, members, "join-members")

    # exact verification: the texts of candidate sets only, each once for every other block
    chosen = members.join(texts, F.col("node") == F.col("row")).select("root", "block", "blocks", F.col("node").alias("rep"), "copies", "labels", "text")
    chosen = chosen.mapInArrow(_sets(words), "root long, block int, blocks int, rep long, copies long, labels binary, shingles binary")
    dealt = chosen.select("root", "block", "rep", "copies", "labels", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "copies", "labels", "shingles")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # the blocks of one set follow one another over the tasks, so that a large one is spread evenly
    slot = F.pmod(F.xxhash64("root") + F.floor(F.col("q") * (F.col("q") + 1) / 2) + F.col("p"), F.lit(tasks)).cast("int")
    dealt = dealt.repartitionById(tasks, slot).sortWithinPartitions("root", "p", "q")
    links = written(spark, dealt.mapInArrow(_verify(similarity, trees, floor), "a long, b long, texts long, documents long"), "join-links", BATCH_ROWS)

    classes = written(spark, components(spark, links.filter("b is not null").select("a", "b")), "join-classes")
    linked = links.filter("b is null").groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    reps = sets.select("rep", "copies").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(linked.withColumnRenamed("a", "rep"), "rep", "left")
    reps = reps.filter("copies > 1 or root is not null")  # the rest are alone
    keyed = sets.select("set_key", "rep").join(reps, "rep").select("set_key", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("documents", F.lit(0)).alias("documents"))
    keyed = written(spark, keyed, "join-keyed")
    placed = signed.select("row", "id", "set_key").join(keyed, "set_key", "left")
    placed = written(spark, placed.select("row", "id", "copies", "root", "texts", "documents"), "join-placed")
    heads = placed.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    out = placed.join(written(spark, heads, "join-heads"), "root", "left")
    alone = F.col("root").isNull()
    result = [
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("documents") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(0)).otherwise(F.col("texts")).cast("long").alias("n_texts"),
        (alone | (F.col("row") == F.col("head.row"))).alias("kept"),
    ]
    return out.select(F.col("id").alias(id_col), *result, "row")


def drop_similar(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class; all columns as they were."""
    number = fresh(docs.columns, "_row")
    gone = fresh([*docs.columns, number], "_gone")
    rows = numbered(spark, docs, "join-rows", number)
    dropped = join_similar(spark, rows, row_col=number, **options).filter("not kept").select(F.col("row").alias(gone))
    dropped = written(spark, dropped, "join-gone")
    return rows.join(dropped, F.col(f"`{number}`") == F.col(f"`{gone}`"), "left_anti").drop(number)
