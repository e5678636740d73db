"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, by interval joins in DuckDB.

Tokenizer A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` model; both cut the same bytes,
a blank and the text. A task takes its Arrow partition in slices and gives DuckDB a table of token intervals
for each side (chunk, start, stop, id). An ASOF join finds the B token that covers an A token's first byte,
a range join those that begin within the A token: together each overlapping pair once. Offsets where a token
of either side ends cut the tokens into groups, numbered by window sums. Pairs are counted per document,
and each slice's numbers of documents per pair are partial counts that Spark merges.

Texts are cut into chunks where neither tokenizer can have a token across: before a blank between other
characters, if A's pattern and B's pieces allow it (``Sides.separable`` reads that from the files; else a text
is one chunk). Equal chunks are tokenized and joined once, as long as the worker remembers them.

A pair's count is the number of documents that hold it, in the whole corpus. The counts are looked up in
a second pass: the most frequent ``SHARED`` pairs at most are broadcast, which bounds what is sent; all other
pairs are joined by a shuffle.

Cases: a null or empty text, and one whose tokens' bytes are not the blank and the text (B may rewrite texts,
or the text may hold B's own mark U+2581), has no tokens: zeros, and no groups (null). Special strings within
texts are plain text. Repeated rows are documents of their own, and count as such; ids, null ones too, are
passed on. Very long texts are aligned whole, in a slice of their own. An empty table gives an empty result.
Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import text_slices, written
from parlance.llm.token_counts import byte_letters

#: Bytes of text that are aligned at once: bounds a task's tables.
SLICE_BYTES = 8 << 20
#: Chunks that a worker remembers, and those that it aligns at once.
REMEMBERED, ADDED = 1_000_000, 60_000
#: Pairs whose counts are broadcast at most: 24 bytes each.
SHARED = 1 << 20
#: A blank between two characters of which the first is no blank and the second no white space.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
MARK = "▁"

#: Texts in which a blank is not simply one between two words.
ODD = r"\A |  | \z| [\s\v\x1c-\x1f\x{85}\pZ]"

LINKS = """
SELECT a.chunk, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.start >= b.start
UNION ALL
SELECT a.chunk, a.id AS a, b.id AS b FROM a JOIN b ON a.chunk = b.chunk AND b.start > a.start AND b.start < a.stop"""
#: Tokens of one side in order, each with the number of its group: the cuts before it, where both sides' tokens end.
GROUPS = """
SELECT chunk, id, coalesce(sum(cut) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp
FROM (SELECT {0}.*, ({0}.stop IN (SELECT stop FROM {1}))::BIGINT AS cut FROM {0}) ORDER BY start"""


class Sides:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        #: No token of either side reaches over a cut: A's pattern begins anew there, and no piece has a mark after another character.
        self.separable = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """The text in parts, each of which a blank precedes."""
        return CUT.split(text) if self.separable else [text]

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts, their number per text): none of null and empty texts."""
        plain = pc.split_pattern(texts, " ")
        lengths = pc.fill_null(pc.list_value_length(plain), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        other = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, ODD)) if self.separable else texts.is_valid()
        flat, ends, at, pieces = plain.flatten(), np.cumsum(lengths), 0, []
        for k in np.flatnonzero(pc.fill_null(other, False).to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            mine = self.chunks(text) if text else []
            pieces += [flat.slice(at, ends[k] - lengths[k] - at), pa.array(mine, flat.type)]
            at, lengths[k] = ends[k], len(mine)
        return pa.concat_arrays([*pieces, flat.slice(at)]), lengths

    def tokens(self, chunks: list[str]) -> tuple[pa.Table, pa.Table]:
        """Both sides' intervals for a blank and each chunk; none where the bytes are not the chunk's."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        whole = [b" " + c.encode() for c in chunks]
        if any(self._bytes(names, ids) != whole for names, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            both = zip(a, b, whole, strict=True)
            fits = [b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for x, y, w in both]
            a, b = ([x if ok else [] for x, ok in zip(side, fits, strict=True)] for side in (a, b))
        return _intervals(a, self.size_a), _intervals(b, self.size_b)

    def _bytes(self, names: list[bytes], ids: list[list[int]]) -> list[bytes]:
        return [b"".join(map(names.__getitem__, x)) for x in ids]


def _intervals(ids: list[list[int]], sizes: np.ndarray) -> pa.Table:
    """chunk, start, stop, id of all tokens; the chunks' bytes follow one another."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
    size = sizes[flat]
    stop = np.cumsum(size)
    return pa.table({"chunk": np.repeat(np.arange(len(ids)), lengths), "start": stop - size, "stop": stop, "id": flat})


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Aligner:
    """Both sides, and the chunks aligned so far: a bounded number of them."""

    def __init__(self, a: str, b: str, remembered: int = REMEMBERED):
        self.sides, self.remembered = Sides(a, b), remembered
        #: Above any of B's ids: a pair is a * width + b.
        self.width = len(self.sides.bytes_b)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        #: n_a, n_b, n_groups, n_links per chunk; groups as text; pairs of all chunks, with offsets.
        self.counts = np.zeros((0, 4), np.int64)
        self.groups: list[str] = []
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _add(self, chunks: list[str]) -> None:
        """Aligns new chunks."""
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as base:
            for name, side in zip("ab", self.sides.tokens(chunks), strict=True):
                base.register("given", side)
                base.execute(f"CREATE TEMP TABLE {name} AS FROM given")
                base.unregister("given")
            links = base.sql(LINKS).to_arrow_table()
            a, b = (base.sql(GROUPS.format(*names)).to_arrow_table() for names in ("ab", "ba"))
        n = len(chunks)
        chunk = links["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        pairs = (links["a"].to_numpy() * self.width + links["b"].to_numpy())[order]
        found = np.bincount(chunk, minlength=n)
        first, text = self._written(a, b, n)
        counts = np.stack([np.bincount(a["chunk"].to_numpy(), minlength=n), np.bincount(b["chunk"].to_numpy(), minlength=n), first, found], 1)
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + n), strict=True))
        self.counts = np.concatenate([self.counts, counts])
        self.groups += text
        self.pairs, self.ends = np.concatenate([self.pairs, pairs]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(found)])

    def _written(self, a: pa.Table, b: pa.Table, n: int) -> tuple[np.ndarray, list[str]]:
        """(groups per chunk, their text): in each group A's tokens, then B's."""
        sides = [(t["id"].to_numpy(), t["grp"].to_numpy(), t["chunk"].to_numpy()) for t in (a, b)]
        many = int(sides[0][1][-1]) + 1 if len(sides[0][1]) else 0
        per = [np.bincount(g, minlength=many) for _, g, _ in sides]
        before = [_offsets(p) for p in per]
        out = np.empty(len(sides[0][0]) + len(sides[1][0]), object)
        chunk_of = np.zeros(many, np.int64)
        chunk_of[sides[0][1]] = sides[0][2]
        opens = np.concatenate(([True], chunk_of[1:] != chunk_of[:-1])) if many else np.zeros(0, bool)
        for k, (ids, grp, _) in enumerate(sides):
            at = np.arange(len(ids)) + before[1 - k][grp + k]
            head = np.zeros(len(ids), np.int64)  # 0: within a group
            head[before[k][:-1]] = 3 if k else np.where(opens, 1, 2)
            out[at] = self._words(k)[head, ids]
        total = np.bincount(chunk_of, per[0] + per[1], n).astype(np.int64) if many else np.zeros(n, np.int64)
        ends, listed = np.cumsum(total).tolist(), out.tolist()
        return np.bincount(chunk_of, minlength=n), ["".join(listed[e - t : e]) for e, t in zip(ends, total.tolist(), strict=True)]

    def _words(self, side: int) -> np.ndarray:
        """Ids as text after what comes before them: a comma, nothing, a semicolon, a bar."""
        if not hasattr(self, "_texts"):
            self._texts = [np.array([[f"{mark}{k}" for k in range(len(x))] for mark in (",", "", ";", "|")], object) for x in (self.sides.bytes_a, self.sides.bytes_b)]
        return self._texts[side]

    def align(self, texts: pa.Array) -> Slice:
        parts, lengths = self.sides.parts(texts)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.remembered:
            self._forget()
            new = words
        for k in range(0, len(new), ADDED):
            self._add(new[k : k + ADDED])
        known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        chunk = known[coded.indices.to_numpy(zero_copy_only=False)] if len(parts) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        good = lengths > 0
        good[doc[self.counts[chunk, 0] == 0]] = False  # a text with a chunk that does not come out whole has no tokens
        stay = good[doc]
        chunk, doc, lengths = chunk[stay], doc[stay], np.where(good, lengths, 0)
        offsets = _offsets(lengths)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[chunk], 0)])
        counts = sums[offsets[1:]] - sums[offsets[:-1]]
        text = [self.groups[k] for k in chunk.tolist()]
        groups = [";".join(text[i:j]) if j > i else None for i, j in pairwise(offsets.tolist())]
        many = self.ends[chunk + 1] - self.ends[chunk]
        at = np.repeat(self.ends[chunk] - _offsets(many)[:-1], many) + np.arange(int(many.sum()))
        room = len(self.sides.bytes_a) * self.width
        keys, times = np.unique(np.repeat(doc, many) * room + self.pairs[at], return_counts=True)
        return Slice(counts, groups, np.searchsorted(keys, np.arange(len(lengths) + 1) * room), keys % room, times)


@dataclass
class Slice:
    """The alignment of some texts: per text its counts and groups; its distinct pairs and how often it holds each."""

    counts: np.ndarray
    groups: list[str | None]
    ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


#: The aligner of this Python worker, by its files: chunks stay known whatever tasks it runs.
_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _KEPT:
        _KEPT.clear()
        _KEPT[a, b] = Aligner(a, b)
    return _KEPT[a, b]


def _kinds(sides: Sides) -> list[str]:
    """Types that a document's pairs are packed in: A's ids, B's ids, how often."""
    return ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (sides.bytes_a, sides.bytes_b)] + ["<u4"]


def _packed(kinds: list[str], columns: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True))


def _unpacked(kinds: list[str], data: bytes) -> tuple[np.ndarray, ...]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(sizes)
    at = np.cumsum([0, *[n * s for s in sizes]])
    return tuple(np.frombuffer(data[at[i] : at[i + 1]], kinds[i]).astype(np.int64) for i in range(3))


def align(spark: SparkSession, docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", shape: Callable[[Column], Column] = lambda groups: groups, shared: int = SHARED) -> DataFrame:
    """a: path of a byte-level BPE file, b: of a sentencepiece model. Returns per document id_col, n_a, n_b,
    n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3`` as ids, null without tokens), n_best (links whose pair's
    count is the highest of its A id), count_sum (over links). shape: applied to groups before they are
    written, for those who want less than the whole of them."""
    sides = spark.sparkContext.broadcast((a, b))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType(
        [T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("groups", T.StringType()), T.StructField("pairs", T.BinaryType())]
        + [T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sides.value)
        kinds, width = _kinds(own.sides), own.width
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                done = own.align(part.column(1))
                n = part.num_rows
                pair_a, pair_b = done.pairs // width, done.pairs % width
                pairs = [_packed(kinds, (pair_a[i:j], pair_b[i:j], done.times[i:j])) for i, j in pairwise(done.ends.tolist())]
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in done.counts.T], pa.array(done.groups, pa.string()), pa.array(pairs, pa.binary()), none, none], schema.names)
                distinct, docs_with = np.unique(done.pairs, return_counts=True)
                m = len(distinct)
                empty = [pa.nulls(m, part.schema.field(0).type), *[pa.nulls(m, pa.int64()) for _ in counts], pa.nulls(m, pa.string()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(distinct // width << 32 | distinct % width), pa.array(docs_with)], schema.names)

    rows = source.mapInArrow(run, schema).withColumn("partial", F.col("pair").isNotNull())
    rows = written(spark, rows.select("id", *counts, shape(F.col("groups")).alias("groups"), "pairs", "pair", "n", "partial", F.monotonically_increasing_id().alias("row")), "aligned", batch_rows=BATCH_ROWS)

    sums = written(spark, rows.filter("partial").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    top = sums.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    sums = written(spark, sums.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    # the least power of two that at most ``shared`` pairs reach: a figure for each power
    powers = {r["p"]: r["m"] for r in sums.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("m")).collect()}
    floor, reached = 64, 0
    while floor and reached + powers.get(floor - 1, 0) <= shared:
        floor -= 1
        reached += powers.get(floor, 0)
    known = sums.filter(F.floor(F.log2("n")) >= floor).toArrow() if reached else None
    if known is not None:
        order = np.argsort(keys := known["pair"].to_numpy())
        known = keys[order], known["n"].to_numpy()[order], known["best"].to_numpy()[order]
    table = spark.sparkContext.broadcast(known)
    packed = spark.sparkContext.broadcast(_kinds(Sides(a, b)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n_best and count_sum from the broadcast counts; the pairs that it has not, with how often."""
        for batch in batches:
            best, total, rest, often = [], [], [], []
            for x in batch.column(batch.num_columns - 1):
                pa_, pb, times = _unpacked(packed.value, x.as_py() or b"")
                pair = pa_ << 32 | pb
                hit = np.zeros(len(pair), bool)
                if table.value is not None:
                    keys, n, is_best = table.value
                    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    hit = keys[at] == pair
                    at, met = at[hit], times[hit]
                    best.append(int(met[is_best[at]].sum()))
                    total.append(int((met * n[at]).sum()))
                else:
                    best.append(0)
                    total.append(0)
                rest.append(pair[~hit])
                often.append(times[~hit])
            lists = pa.array(rest, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.int64()), pa.array(total, pa.int64()), *lists], [*batch.schema.names[:-1], "n_best", "count_sum", "rest", "often"])

    carried = rows.filter("not partial").select("row", "id", *counts, "groups", "pairs")
    after = T.StructType(
        [f for f in carried.schema.fields if f.name != "pairs"] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("rest", "often")]
    )
    out = carried.mapInArrow(looked_up, after)
    if floor:  # some pairs are rarer than those that were sent
        out = written(spark, out, "looked-up", batch_rows=BATCH_ROWS)
        left = out.select("row", F.explode(F.arrays_zip("rest", "often")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.often").alias("times"))
        found = left.join(sums, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        out = out.join(found, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select(F.col("id").alias(id_col), *counts, "groups", "n_best", "count_sum")


#: Documents of an Arrow batch, whose pairs come along.
BATCH_ROWS = 2000
