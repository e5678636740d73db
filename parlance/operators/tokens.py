"""Token budgets: counts, chunks, windows, truncation and merge groups in a tokenizer's own tokens.

``WhiteSpace`` is the built-in tokenizer. Its counts add up when texts are joined, so everything is
a fold in the JVM. A subword tokenizer's do not: ``Subword`` measures the joined text itself, in Arrow UDFs
(one pass over the rows; the tokenizer is loaded once per Python worker). A chunk is grown by a bounded
search: the counts of its parts, added up, say where it is likely to end, the joined text is measured
there, and a part is added or taken off until one more would not fit. That is where a loop that adds part
after part ends, as long as a text has no fewer tokens with one more part than without.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import structure


class Tokenizer(Protocol):
    """What a loader returns."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class FromFile:
    """A tokenizer of a ``tokenizers`` file, without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Loaded

        self.inner = Loaded.from_file(path)
        self.inner.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids, skip_special_tokens=False)


class FromModel:
    """A tokenizer of a ``sentencepiece`` model."""

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids)


# ---- per row, in a task --------------------------------------------------------------------


class Packer:
    """Packs texts under a budget with one tokenizer. ``measured`` counts the texts that were encoded."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.measured = tokenizer, 0

    def count(self, text: str) -> int:
        self.measured += 1
        return len(self.tokenizer.encode(text))

    def runs(self, sizes: list[int], fits: Callable[[int, int], bool], budget: int) -> Iterator[tuple[int, int]]:
        """Greedy runs of parts: as many as fit, one at least. sizes: their own counts."""
        ends, at = list(accumulate(sizes, initial=0)), 0
        while at < len(sizes):
            stop = min(len(sizes), max(at + 1, bisect_right(ends, ends[at] + budget) - 1))
            if stop == at + 1 or fits(at, stop):
                while stop < len(sizes) and fits(at, stop + 1):
                    stop += 1
            else:
                stop -= 1
                while stop > at + 1 and not fits(at, stop):
                    stop -= 1
            yield at, stop
            at = stop

    def joined(self, parts: list[str], budget: int, glue: str) -> Iterator[tuple[int, int]]:
        return self.runs([self.count(p) for p in parts], lambda a, b: self.count(glue.join(parts[a:b])) <= budget, budget)

    def windows(self, text: str, budget: int, overlap: int = L.OVERLAP_TOKENS) -> list[str]:
        """Overlapping windows of budget tokens, decoded; the last one reaches the end."""
        ids = self.tokenizer.encode(text)
        step = max(1, budget - overlap)
        last = max(0, -(-(len(ids) - budget) // step))
        return [self.tokenizer.decode(ids[k * step : k * step + budget]).strip() for k in range(last + 1)]

    def split_long_turn(self, turn: str, budget: int, overlap: int = L.OVERLAP_TOKENS) -> list[str]:
        """A turn's sentences, those over the budget as windows, packed together again with a blank."""
        sentences = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+", turn)) if s] or [turn]
        parts = [p for s in sentences for p in ([s] if self.count(s) <= budget else self.windows(s, budget, overlap))]
        return [" ".join(parts[a:b]) for a, b in self.joined(parts, budget, " ")]

    def chunks(self, turns: list[tuple[int, str]], budget: int, overlap: int = L.OVERLAP_TOKENS) -> list[dict]:
        parts: list[tuple[int, str]] = []
        for idx, line in turns:
            parts += [(idx, line)] if self.count(line) <= budget else [(idx, p) for p in self.split_long_turn(line, budget, overlap)]
        lines, out = [p for _, p in parts], []
        for a, b in self.joined(lines, budget, "\n"):
            text = "\n".join(lines[a:b])
            out.append({"text": text, "turn_indices": list(dict.fromkeys(i for i, _ in parts[a:b])), "token_count": self.count(text)})
        return out

    def direct(self, clean: str, budget: int) -> list[dict]:
        """The prompt of a text, whole or with its middle cut out; none where no cut fits."""
        head, tail = structure.prompt_parts(L.DIRECT_INSTRUCTION)
        if self.count(head + clean + tail) <= budget:
            return [{"prompt": head + clean + tail, "truncated": False, "coverage": 1.0}]
        keep = max(200, int(len(clean) * 0.8))
        while keep > 200:
            first = int(keep * 0.7)
            prompt = head + clean[:first] + L.TRUNCATION_MARK + clean[first - keep :] + tail
            if self.count(prompt) <= budget:
                return [{"prompt": prompt, "truncated": True, "coverage": min(1.0, keep / max(1, len(clean)))}]
            keep = int(keep * 0.8)
        return []

    def groups(self, summaries: list[str], budget: int) -> list[list[str]]:
        """Greedy groups of summaries whose merge prompt stays within the budget."""
        head, tail = structure.prompt_parts(L.MERGE_INSTRUCTION)

        def prompt(a: int, b: int) -> str:
            return head + "\n".join(f"Section {k}: {s}" for k, s in enumerate(summaries[a:b], 1)) + tail

        room = max(1, budget - self.count(head + tail))
        sizes = [self.count(f"Section 1: {s}\n") for s in summaries]
        return [summaries[a:b] for a, b in self.runs(sizes, lambda a, b: self.count(prompt(a, b)) <= budget, room)]


# ---- columns -------------------------------------------------------------------------------


class WhiteSpace:
    """Tokens are runs of anything but white space; all of it stays in the JVM."""

    def count(self, text: Column) -> Column:
        return X.token_count(text)

    def total(self, texts: Column) -> Column:
        """Of an array; null texts count 0."""
        return F.aggregate(F.coalesce(texts, X.no_strings()), F.lit(0), lambda n, s: n + self.count(F.coalesce(s, F.lit(""))))

    def chunks(self, turns: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
        return structure.chunks(turns, budget, overlap)

    def windows(self, text: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
        return structure.token_windows(X.tokens(text), budget, overlap)

    def direct(self, text: Column, budget: int = L.PROMPT_TOKENS) -> Column:
        return structure.direct_prompt(text, budget)

    def groups(self, summaries: Column, budget: int = L.GROUP_TOKENS) -> Column:
        """array<array<string>>: greedy groups whose merge prompt stays within the budget."""
        first = F.struct(F.array().cast("array<array<string>>").alias("done"), X.no_strings().alias("open"))

        def step(acc: Column, s: Column) -> Column:
            longer = F.concat(acc["open"], F.array(s))
            full = (F.size(acc["open"]) > 0) & (self.count(structure.merge_prompt(structure.sections(longer))) > budget)
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, F.array(s)).otherwise(longer).alias("open"),
            )

        return F.aggregate(summaries, first, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


BUILT_IN = WhiteSpace()

#: Packers of this Python worker: the last few tokenizers, by the key of their loader.
_PACKERS: dict[str, Packer] = {}
KEPT = 4


def packer(key: str, load: Callable[[], Tokenizer]) -> Packer:
    if key not in _PACKERS:
        while len(_PACKERS) >= KEPT:
            del _PACKERS[next(iter(_PACKERS))]
        _PACKERS[key] = Packer(load())
    return _PACKERS[key]


class Subword:
    """A real tokenizer. load: makes it in a Python worker, as ``lambda: FromFile(path)`` does. Null
    texts have null results."""

    def __init__(self, load: Callable[[], Tokenizer]):
        self.load, self.key = load, uuid.uuid4().hex

    def _per_row(self, work: Callable[[Packer, object], object], kind: str):
        key, load = self.key, self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = packer(key, load)
            for batch in batches:
                yield pd.Series([None if x is None else work(own, x) for x in batch], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, kind)

    def count(self, text: Column) -> Column:
        return self._per_row(lambda own, x: own.count(x), "int")(text)

    def total(self, texts: Column) -> Column:
        return self._per_row(lambda own, x: sum(own.count(s) for s in x if s is not None), "int")(F.coalesce(texts, X.no_strings()))

    def chunks(self, turns: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
        return self._per_row(lambda own, x: own.chunks([(t["idx"], t["line"]) for t in x], budget, overlap), f"array<{structure.CHUNK}>")(turns)

    def windows(self, text: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
        return self._per_row(lambda own, x: own.windows(x, budget, overlap), "array<string>")(text)

    def direct(self, text: Column, budget: int = L.PROMPT_TOKENS) -> Column:
        """As the built-in one's: struct<prompt, truncated, coverage>, null where no truncation fits."""
        found = self._per_row(lambda own, x: own.direct(x, budget), "array<struct<prompt:string,truncated:boolean,coverage:double>>")
        return F.get(found(X.strip(text)), F.lit(0))

    def groups(self, summaries: Column, budget: int = L.GROUP_TOKENS) -> Column:
        return self._per_row(lambda own, x: own.groups(list(x), budget), "array<array<string>>")(summaries)
