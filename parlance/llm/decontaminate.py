"""Benchmark decontamination with an FM-index per shard of the training documents.

A shard is a slice of documents of one task, of SLICE_BYTES of text (a longer text alone, in shards
that overlap by a phrase). All its words are indexed: the words that benchmark items use as symbols of
their own, any other as one symbol, which no test phrase holds. All phrases (windows of ``window``
consecutive item words; an item of fewer words is one phrase) are searched backwards through the
wavelet ranks, occurrences are located by sampled suffix positions, and overlapping occurrences merge
into removal spans.

There is no shuffle: each document is read once, and only the phrases are sent to the tasks. A
benchmark of more than ``max_benchmark_words`` is taken in pieces of that size, read one after another.
The documents are then numbered and written once; each piece is a pass over them that writes only the numbers,
spans and items of documents it hits (the first also every number of words), and its phrases leave
driver and tasks before the next. No text is shuffled or written again.

Cases: a null or wordless text has no words and no hits; a null or wordless item has no phrase; a
null item_id counts as the empty string. Items that share an id count once. Repeated rows are
judged alike. An empty benchmark hits nothing, an empty table gives an empty result. Very long
texts are searched whole. Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import carried, numbered, restored, text_slices, written
from parlance.llm.fm_index import FMIndex

WINDOW = 13
#: Bytes of text of one shard.
SLICE_BYTES = 4 << 20
#: Symbols of one FM-index: bounds a task's memory at about 100 bytes a symbol.
SHARD_SYMBOLS = 1_000_000
#: Benchmark words whose phrases are held at once (about 100 bytes each).
MAX_BENCHMARK_WORDS = 500_000
#: Word bytes: digits, a-z, and all of UTF-8 beyond ASCII; A-Z are lower-cased, the rest parts words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).translate(_BYTES).split()


def plain_parts(text: bytes | None, most: int) -> Iterator[bytes]:
    """The text with words of ``words_of`` parted by spaces, in parts of about ``most`` bytes that end at
    a space (a longer word is a part alone)."""
    plain, at = text.translate(_BYTES) if text else b"", 0
    while at < len(plain):
        stop = len(plain)
        if at + most < stop:
            cut = plain.rfind(b" ", at, at + most)
            stop = cut + 1 if cut >= 0 else plain.find(b" ", at + most)
            stop = stop if stop >= 0 else len(plain)
        yield plain[at:stop]
        at = stop


class Phrases:
    """The windows of benchmark items as rows of symbols, by length; symbol 0 is any other word.
    A group: its distinct phrases, and for phrase k the items owners[starts[k]:starts[k + 1]]."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({name for name, words in items if words})
        place = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, words in items:
            if words:
                row = np.array([self.symbols.setdefault(w, len(self.symbols) + 1) for w in words], np.int32)
                size = min(window, len(row))
                by_length.setdefault(size, []).append((place[name], np.lib.stride_tricks.sliding_window_view(row, size)))
        self.groups = []
        for _, found in sorted(by_length.items()):
            owner = np.repeat([k for k, _ in found], [len(w) for _, w in found])
            rows, which = np.unique(np.concatenate([w for _, w in found]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), owner), axis=1), axis=0)
            self.groups.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))
        self.longest = max(by_length, default=0)


def _occurrences(symbols: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """For each shard index and phrase length: positions, length, phrase of each, number of the group."""
    at = 0
    while phrases.groups and at < len(symbols):
        stop = min(at + SHARD_SYMBOLS, len(symbols))
        index = FMIndex(symbols[at:stop])
        for number, (rows, _, _) in enumerate(phrases.groups):
            low, high = index.search(rows)
            count = high - low
            which = np.repeat(np.arange(len(rows)), count)
            ranks = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            yield at + index.locate(ranks), rows.shape[1], which, number
        # a phrase that begins before the next shard ends within this one
        at = stop if stop == len(symbols) else max(at + 1, stop - phrases.longest + 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_texts(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, merged hit spans (of words), sorted ids of items found."""
    get, parts, starts, at = phrases.symbols.get, [], [], 0
    for text in texts:
        starts.append(at)
        for part in plain_parts(text, SLICE_BYTES):
            words = part.split()
            parts.append(np.fromiter(map(get, words, itertools.repeat(0)), np.int32, len(words)))
            at += len(words)
        parts.append(np.zeros(1, np.int32))  # parts the documents
        at += 1
    starts = np.array([*starts, at], np.int64)
    delta = np.zeros(at + 1, np.int32)
    items: list[set[int]] = [set() for _ in texts]
    for places, size, which, number in _occurrences(np.concatenate(parts) if parts else np.zeros(0, np.int32), phrases):
        np.add.at(delta, places, 1)
        np.add.at(delta, places + size, -1)
        doc = np.searchsorted(starts, places, side="right") - 1
        _, first, owners = phrases.groups[number]
        for d, p in np.unique(np.stack((doc, which), axis=1), axis=0).tolist():
            items[d].update(owners[first[p] : first[p + 1]].tolist())
    hit = np.cumsum(delta) > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, d in zip(first.tolist(), last.tolist(), (np.searchsorted(starts, first, side="right") - 1).tolist()):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return [(int(n), s, [phrases.names[k] for k in sorted(i)]) for n, s, i in zip(np.diff(starts) - 1, spans, items)]


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Phrases]:
    """Phrases of at most ``most`` words (a longer item is a piece alone); of an empty benchmark one, empty."""
    items, n, any_yet = [], 0, False
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator()
    for item, text in rows:
        words = words_of(text)
        if items and n + len(words) > most:
            yield Phrases(items, window)
            items, n, any_yet = [], 0, True
        if words:
            items.append((item, words))
            n += len(words)
    if items or not any_yet:
        yield Phrases(items, window)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def _searched(rows: DataFrame, phrases: Phrases, carry: list[str]) -> DataFrame:
    """rows: two columns, the second of them text. The columns ``carry``, the first or both, and n_words, items, spans of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)
    names, kind = [*carry, *[f.name for f in _FOUND]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in text_slices(b, 1, SLICE_BYTES)):
            found = search_texts([x.as_buffer().to_pybytes() if x.is_valid else None for x in part.column(1)], shared.value)
            spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([i for _, _, i in found], pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *columns], names)

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in carry], *_FOUND]))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, n_words, items, spans, the last two of all pieces, as sets and merged."""
    for batch in batches:
        items = [sorted(set(x)) for x in batch.column(2).to_pylist()]
        spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row])] for row in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.string())), pa.array(spans, batch.schema.field(3).type)], batch.schema.names)


def _judged(found: DataFrame, share: int) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = found.withColumn("n_hit", hits)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _contamination(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, share: int, max_benchmark_words: int, texts: bool) -> tuple[DataFrame, DataFrame | None]:
    """rows: row, text. For a benchmark of one piece (row, with ``texts`` the text, and what was found; None);
    else (at, row, text; at and what was found)."""
    pieces = _pieces(benchmark, item_col, item_text_col, window, max_benchmark_words)
    first, second = next(pieces), next(pieces, None)
    if second is None:
        return _judged(_searched(rows, first, ["row", "text"] if texts else ["row"]), share), None
    base = numbered(spark, rows, "contamination-rows", "at")
    finds = written(spark, _searched(base.select("at", "text"), first, ["at"]), "contamination")
    for piece in itertools.chain([second], pieces):
        more = _searched(base.select("at", "text"), piece, ["at"]).filter("size(items) > 0")
        finds = finds.unionByName(written(spark, more, "contamination"))
    grouped = finds.groupBy("at").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return base, _judged(written(spark, grouped.mapInArrow(_together, grouped.schema), "contamination-found"), share)


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    max_benchmark_words: int = MAX_BENCHMARK_WORDS,
) -> DataFrame:
    """Per document: id_col, n_words, n_hit, items (ids found, as strings, sorted), spans (merged,
    of word positions, end exclusive), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    found, later = _contamination(spark, rows, benchmark, item_col, item_text_col, window, share, max_benchmark_words, False)
    if later is not None:
        found = found.select("at", "row").join(later, "at")
    return found.select(F.col("row").alias(id_col), "n_words", "n_hit", "items", "spans", "contaminated")


def drop_contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    max_benchmark_words: int = MAX_BENCHMARK_WORDS,
) -> DataFrame:
    """docs without the contaminated ones; all columns as they were."""
    rows = docs.select(carried(docs.columns, text_col).alias("row"), F.col(text_col).alias("text"))
    found, later = _contamination(spark, rows, benchmark, item_col, item_text_col, window, share, max_benchmark_words, True)
    if later is None:
        kept = found.filter(~F.col("contaminated"))
    else:
        kept = found.join(written(spark, later.filter("contaminated").select("at"), "contamination-gone"), "at", "left_anti")
    return kept.select(*restored(docs.columns, text_col))
