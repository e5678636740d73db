"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch of documents lie behind one another in one array of symbols.
In each round every pre-token finds its pair of lowest rank and all its occurrences of that pair are
merged at once, in all pre-tokens together; a pre-token without a mergeable pair leaves, and the
number of its symbols is its count. (A merge only makes symbols whose own pairs rank later, so the
order of the rounds is the order of the library.) A document's count is the sum over its pre-tokens.

The merges are read on the driver from ``path`` and sent to the tasks: their size is the
vocabulary's. A task keeps a bounded table of counts it has met.

Cases: a null text has 0 bytes and 0 tokens, as has the empty one. Special strings within a text
count as one token each, as the library does by default. Repeated rows are counted alike. Very long
texts are counted whole. An empty table gives an empty result. Only the id and text columns are
read, so others cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern of byte-level pre-tokens, a fixed part of the vocabulary's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 500_000
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The format's letter of each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Merges:
    """Ranks of symbol pairs. Symbols are the 256 bytes and, above, the result of each merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = dict(letters)
        keys = []
        for k, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(ids[left] << 32 | ids[right])
            ids.setdefault(left + right, 256 + k)
        self.result = np.array([ids[a + b] for a, b in (p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"])], np.int64)
        self.order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[self.order]
        self.special = [x["content"] for x in model.get("added_tokens", ())]
        self.none = len(keys)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], self.none)


def merged_lengths(merges: Merges, pieces: list[bytes]) -> np.ndarray:
    """Number of symbols that each (non-empty) piece ends with."""
    out = np.array([len(p) for p in pieces], np.int64)
    alive = np.flatnonzero(out > 1)
    if not len(alive):
        return out
    symbols = np.frombuffer(b"".join([pieces[i] for i in alive.tolist()]), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(alive)), out[alive])
    ranks = np.append(merges.ranks(symbols[:-1], symbols[1:]), merges.none)
    ranks[:-1][owner[1:] != owner[:-1]] = merges.none
    while True:
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        least = np.minimum.reduceat(ranks, start)
        size = np.diff(np.append(start, len(symbols)))
        if (least == merges.none).any():
            done = least == merges.none
            out[alive[owner[start[done]]]] = size[done]
            stay = np.repeat(~done, size)
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            least, size = least[~done], size[~done]
            if not len(symbols):
                return out
        chosen = ranks == np.repeat(least, size)
        # in a run of overlapping occurrences (a symbol paired with itself) every second one counts
        begin = chosen & ~np.concatenate(([False], chosen[:-1]))
        place = np.arange(len(chosen))
        run = np.maximum.accumulate(np.where(begin, place, 0))
        hit = np.flatnonzero(chosen & ((place - run) % 2 == 0))
        symbols[hit] = merges.result[ranks[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[hit] = True
        symbols, owner, ranks, touched = symbols[keep], owner[keep], ranks[keep], touched[keep]
        # only pairs beside a merged symbol have new ranks
        redo = np.flatnonzero(touched | np.concatenate((touched[1:], [False])))
        redo = redo[redo < len(symbols) - 1]
        new = merges.ranks(symbols[redo], symbols[redo + 1])
        new[owner[redo] != owner[redo + 1]] = merges.none
        ranks[redo] = new
        ranks[-1] = merges.none


class Counter:
    """Counts texts batch by batch; remembers a bounded number of pre-tokens."""

    def __init__(self, merges: Merges, remembered: int = REMEMBERED):
        self.merges, self.remembered, self.known = merges, remembered, {}
        self.find = regex.compile(PATTERN, regex.V0).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def count(self, texts: list[str | None]) -> list[int]:
        index: dict[str, int] = {}
        flat: list[int] = []
        ends, extra = [], []
        for text in texts:
            parts = [text or ""]
            if self.special and text:
                parts = self.special.split(text)
            extra.append(len(parts) - 1)
            for part in parts:
                flat += [index.setdefault(w, len(index)) for w in self.find(part)]
            ends.append(len(flat))
        words = list(index)
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.remembered:
            known = self.known = {w: known[w] for w in words if w in known}
        known.update(zip(new, merged_lengths(self.merges, [w.encode("utf-8") for w in new]).tolist()))
        sizes = np.array([known[w] for w in words], np.int64)
        total = np.concatenate(([0], np.cumsum(sizes[np.array(flat, np.int64)] if flat else np.zeros(0, np.int64))))
        ends = np.array(ends, np.int64)
        return (total[ends] - total[np.concatenate(([0], ends[:-1]))] + np.array(extra)).tolist() if len(ends) else []


#: Bytes of text that are counted at once: bounds the arrays of a task.
SLICE_BYTES = 8 << 20


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    merges = spark.sparkContext.broadcast(Merges(path))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for batch in batches:
            column = batch.column(1)
            sizes = np.array([x.as_buffer().size if x.as_buffer() else 0 for x in column], np.int64)
            counts: list[int] = []
            at = 0
            while at < len(column):
                stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, side="right")))
                counts += counter.count(column.slice(at, stop - at).to_pylist())
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
