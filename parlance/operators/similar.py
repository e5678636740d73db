"""Similar sentences of one text, by prefix filtering.

Two sets of words of a Jaccard similarity t or more share a word among the first of each, if all words
are ordered alike, the rare ones first: of a set of n words the first n - ceil(t * n) + 1. An index of these
words (within the text) gives the candidates; sizes bound them further; their sets are then compared. Short
texts compare all pairs in the JVM, longer ones use the index, in an Arrow UDF to which the short ones are null.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X

#: Sentences of a text up to which all pairs are compared.
SHORT = 48
PAIR = "struct<i:int,j:int,similarity:double,a:string,b:string>"
DROP = "struct<drop:int,keep:int,reason:string>"


class Index:
    """The sets, and where their first words occur."""

    def __init__(self, sets: list[Collection[str]], least: float):
        self.sets, self.least = [frozenset(s) for s in sets], least
        often = Counter(w for s in self.sets for w in s)
        self.first = [sorted(s, key=lambda w: (often[w], w))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for s in self.sets]
        self.places: dict[str, list[int]] = defaultdict(list)
        for k, words in enumerate(self.first):
            for w in words:
                self.places[w].append(k)

    def after(self, i: int) -> Iterator[tuple[int, float]]:
        """(j, similarity) of the similar sets j > i, in order."""
        own, found = self.sets[i], set()
        for w in self.first[i]:
            found.update(self.places[w])
        for j in sorted(j for j in found if j > i):
            other = self.sets[j]
            if min(len(own), len(other)) >= self.least * max(len(own), len(other)) - 1e-9:
                shared = len(own & other)
                similarity = shared / (len(own) + len(other) - shared)
                if similarity >= self.least:
                    yield j, similarity


class Every:
    """The same of a few sets: all pairs are compared."""

    def __init__(self, sets: list[Collection[str]], least: float):
        self.sets, self.least = [frozenset(s) for s in sets], least

    def after(self, i: int) -> Iterator[tuple[int, float]]:
        own = self.sets[i]
        for j in range(i + 1, len(self.sets)):
            shared = len(own & self.sets[j])
            if shared:
                similarity = shared / (len(own) + len(self.sets[j]) - shared)
                if similarity >= self.least:
                    yield j, similarity


def _udf(work, kind: str, units: Column) -> Column:
    """work on each of the units that are not null. They travel as JSON: Arrow sizes a column of lists anew with each
    row, which is quadratic in a batch even of nulls."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else work(json.loads(x)) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(F.to_json(units, {"ignoreNullFields": "false"}))


def _indexed_pairs(units, least: float) -> list[dict]:
    index = Index([u["words"] for u in units], least)
    who = [u["speaker"] for u in units]
    return [{"i": i + 1, "j": j + 1, "similarity": s, "a": who[i], "b": who[j]} for i in range(len(units)) for j, s in index.after(i)]


def pairs(units: Column, least: float) -> Column:
    """units: array<struct<words, speaker>>, each word once. array<PAIR> of the pairs i < j (from 1) whose words are similar by
    ``least`` (above 0) or more, in order."""

    def all_after(left: Column, i: Column) -> Column:
        found = F.transform(
            F.slice(units, i + 2, F.size(units)),
            lambda right, k: F.struct((i + 1).alias("i"), (i + k + 2).alias("j"), X.set_jaccard(left["words"], right["words"]).alias("similarity"), left["speaker"].alias("a"), right["speaker"].alias("b")),
        )
        return F.filter(found, lambda p: p["similarity"] >= least)

    short = F.size(units) <= SHORT
    indexed = _udf(lambda x: _indexed_pairs(x, least), f"array<{PAIR}>", F.when(~short, units))
    return F.when(short, F.flatten(F.transform(units, all_after)).cast(f"array<{PAIR}>")).otherwise(indexed)


def _verdict(a: dict, b: dict, similarity: float, support) -> tuple[bool, str] | None:
    """(the first goes, reason), or nothing, for two sentences of named speakers."""
    if a["speaker"] == b["speaker"]:
        return (len(a["words"]) <= len(b["words"]), L.REPEATED_EVENT) if similarity >= L.SAME_SPEAKER else None
    if similarity >= L.CONFLICT:
        for first, (weak, strong) in ((True, (a, b)), (False, (b, a))):
            if support(weak) <= L.WEAK and support(strong) >= L.STRONG:
                return first, L.OPPOSED_EVENT
    return None


def dropped(units, support=itemgetter("support")) -> list[dict]:
    """What ``drops`` gives, of the units of one text: the pairs in order, as long as both sentences are there."""
    kind = Every if len(units) <= SHORT else Index
    index, gone, out = kind([u["words"] if u["speaker"] is not None else [] for u in units], min(L.SAME_SPEAKER, L.CONFLICT)), set(), []
    for i, unit in enumerate(units):
        if i in gone or unit["speaker"] is None:
            continue
        for j, similarity in index.after(i):
            found = None if j in gone else _verdict(unit, units[j], similarity, support)
            if found:
                drop, keep = (i, j) if found[0] else (j, i)
                gone.add(drop)
                out.append({"drop": drop + 1, "keep": keep + 1, "reason": found[1]})
                if drop == i:
                    break
    return out


def drops(units: Column) -> Column:
    """units: array<struct<words, speaker, support>>, each word once. array<DROP>: the sentences (from 1) that go because another
    stays, pair by pair in order of (i, j); a pair with a sentence that is gone already does nothing."""

    def all_after(left: Column, i: Column) -> Column:
        found = F.transform(
            F.slice(units, i + 2, F.size(units)), lambda right, k: F.struct((i + 1).alias("i"), (i + k + 2).alias("j"), X.set_jaccard(left["words"], right["words"]).alias("similarity"), left.alias("a"), right.alias("b"))
        )
        return F.filter(found, lambda p: p["a"]["speaker"].isNotNull() & p["b"]["speaker"].isNotNull() & (p["similarity"] >= min(L.SAME_SPEAKER, L.CONFLICT)))

    def step(done: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        there = ~F.exists(done, lambda d: (d["drop"] == p["i"]) | (d["drop"] == p["j"]))
        same = a["speaker"] == b["speaker"]
        repeated = same & (p["similarity"] >= L.SAME_SPEAKER)
        opposed = ~same & (p["similarity"] >= L.CONFLICT)
        first = (repeated & (F.size(a["words"]) <= F.size(b["words"]))) | (opposed & (a["support"] <= L.WEAK) & (b["support"] >= L.STRONG))
        second = ~first & (repeated | (opposed & (b["support"] <= L.WEAK) & (a["support"] >= L.STRONG)))
        one = F.struct(F.when(first, p["i"]).otherwise(p["j"]).alias("drop"), F.when(first, p["j"]).otherwise(p["i"]).alias("keep"), F.when(repeated, L.REPEATED_EVENT).otherwise(L.OPPOSED_EVENT).alias("reason"))
        return F.when(there & (first | second), F.concat(done, F.array(one.cast(DROP)))).otherwise(done)

    short = F.size(units) <= SHORT
    none = F.array().cast(f"array<{DROP}>")
    indexed = _udf(dropped, f"array<{DROP}>", F.when(~short, units))
    return F.when(short, F.aggregate(F.flatten(F.transform(units, all_after)), none, step)).otherwise(indexed)
