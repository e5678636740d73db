"""ROUGE-1, ROUGE-2 and ROUGE-L of token arrays as Column expressions, and of texts in one Arrow pass."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import text as X


def rouge_tokens(text: Column, stem: bool = False) -> Column:
    """Runs of a-z and 0-9 in lower case. stem: words of over three letters are stemmed in an Arrow
    UDF (Porter's algorithm); without it everything stays in the JVM."""
    found = X.find_all(F.lower(text), "[a-z0-9]+")
    return _stemmed(found) if stem else found


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: each common gram counts as often as the side that has it less.
    Both sides are sorted together, so a gram's occurrences follow one another and one pass counts them."""
    both = F.sort_array(F.concat(F.transform(a, lambda g: F.struct(g.alias("g"), F.lit(0).alias("side"))), F.transform(b, lambda g: F.struct(g.alias("g"), F.lit(1).alias("side")))))
    first = F.struct(F.lit("").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        # a side's occurrences come before the other's: each of the other's takes one of them
        same = acc["g"] == x["g"]
        left = F.when(same, acc["a"]).otherwise(F.lit(0))
        hit = (x["side"] == 1) & (left > acc["b"]) & same
        taken = F.when(same, acc["b"]).otherwise(F.lit(0)) + hit.cast("int")
        return F.struct(x["g"].alias("g"), (left + 1 - x["side"]).alias("a"), taken.alias("b"), (acc["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(both, first, step, lambda acc: acc["n"])


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; b should be the shorter side."""
    return X.let(F.struct(a.alias("a"), b.alias("b")), lambda both: _lcs(both["a"], both["b"]))


#: Tokens per machine word of the bit-parallel table; sums of two words and a carry stay below 2^63.
BITS = 60


def _lcs(a: Column, b: Column) -> Column:
    """Bit-parallel dynamic programming: a row of the classic table is one bit per token of b, in words
    of BITS bits; a token of a updates a row with one addition per word. Zeros count the length."""
    words = F.ceil(F.size(b) / BITS).cast("int")
    full = F.lit((1 << BITS) - 1)

    def mask(token: Column) -> Column:
        def word(w: Column) -> Column:
            hits = F.transform(F.slice(b, w * BITS + 1, BITS), lambda t, i: F.when(t == token, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(hits, F.lit(0).cast("long"), lambda x, y: x + y)

        return F.transform(F.sequence(F.lit(0), words - 1), word)

    def update(row: Column, masks: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, w: Column) -> Column:
            v, m = F.get(row, w), F.get(masks, w)
            total = v + v.bitwiseAND(m) + acc["carry"]
            new = total.bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
            return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(acc["out"], F.array(new)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), words - 1), first, step, lambda acc: acc["out"])

    def run(common: Column) -> Column:
        known = F.map_from_arrays(common, F.transform(common, mask))
        start = F.transform(F.sequence(F.lit(0), words - 1), lambda w: full)
        return X.let(known, lambda masks: F.aggregate(F.filter(a, lambda t: F.array_contains(common, t)), start, lambda row, t: update(row, F.element_at(masks, t))))

    rows = X.let(F.array_intersect(a, b), run)
    ones = F.aggregate(rows, F.lit(0), lambda n, v: n + F.bit_count(v))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(words * BITS - ones)


def scores(shared: Column, reference: Column, prediction: Column) -> Column:
    """struct<precision, recall, fmeasure> from counts."""
    p = F.when(prediction > 0, shared / prediction).otherwise(F.lit(0.0))
    r = F.when(reference > 0, shared / reference).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


def rouge(reference: Column, prediction: Column) -> Column:
    """struct<rouge1, rouge2, rougeL> of token arrays, each with precision, recall, fmeasure."""
    r2, p2 = X.n_grams(reference, 2), X.n_grams(prediction, 2)
    return F.struct(
        scores(overlap(reference, prediction), F.size(reference), F.size(prediction)).alias("rouge1"),
        scores(overlap(r2, p2), F.size(r2), F.size(p2)).alias("rouge2"),
        scores(lcs(prediction, reference), F.size(reference), F.size(prediction)).alias("rougeL"),
    )


def _longest(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the classic table is a whole number, a bit per token of
    the shorter side, and zeros count the length."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, t in enumerate(b):
        masks[t] = masks.get(t, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for t in a:
        m = masks.get(t)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(b) - row.bit_count()


def counts(reference: Column, prediction: Column, stem: bool = False, longest: bool = True) -> Column:
    """struct<r, p, one, two, longest> of two texts: tokens of each, common tokens and pairs of tokens, length of the
    longest common subsequence (null unless asked for); null where a text that it needs is."""

    @F.pandas_udf("struct<r:int,p:int,one:int,two:int,longest:int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from parlance.functions import stem as porter

        find, known = re.compile("[a-z0-9]+").findall, {}

        def tokens(text: str) -> list[str]:
            found = find(text)
            if stem:
                for w in set(found).difference(known):
                    known[w] = porter.stem(w) if len(w) > 3 else w
                found = [known[w] for w in found]
            return found

        def one(a: str | None, b: str | None) -> tuple:
            r, p = (None if x is None else tokens(x) for x in (a, b))
            if r is None or p is None:
                return (None if r is None else len(r), None if p is None else len(p), None, None, None)
            shared = []
            for x, y in ((r, p), (zip(r, r[1:]), zip(p, p[1:]))):
                has = Counter(x)
                shared.append(sum(min(n, has[g]) for g, n in Counter(filter(has.__contains__, y)).items()))
            return (len(r), len(p), *shared, _longest(p, r) if longest else None)

        for references, predictions in batches:
            if len(known) > 1 << 18:
                known.clear()
            rows = [one(a, b) for a, b in zip(references, predictions)]
            yield pd.DataFrame(rows, columns=["r", "p", "one", "two", "longest"]).astype("Int32")

    return run(F.lower(reference), F.lower(prediction))


def of_counts(c: Column) -> Column:
    """struct<rouge1, rouge2, rougeL>, each with precision, recall, fmeasure."""

    def pairs(n: Column) -> Column:
        return F.greatest(n - 1, F.lit(0))

    return F.struct(
        scores(c["one"], c["r"], c["p"]).alias("rouge1"), scores(c["two"], pairs(c["r"]), pairs(c["p"])).alias("rouge2"), scores(c["longest"], c["r"], c["p"]).alias("rougeL")
    )


def _stemmed(tokens: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from parlance.functions.stem import stem

        known: dict[str, str] = {}
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else [known.setdefault(w, stem(w)) if len(w) > 3 else w for w in ws])

    return run(tokens)
