"""Similar sentences by prefix filtering, names in one pass and gram overlaps, against plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance import queries as Q
from parlance.functions import lexicon as L
from parlance.functions import rouge as R
from parlance.functions import text as X
from parlance.functions.stem import stem
from parlance.operators import similar

UNITS = "id int, units array<struct<words:array<string>,speaker:string,support:double>>"


def jaccard(a, b):
    both = len(set(a) | set(b))
    return len(set(a) & set(b)) / both if both else 0.0


def some_units(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{min(int(rng.expovariate(0.4)), 30)}" for _ in range(rng.randint(0, 7))]
        if out and rng.random() < 0.4:
            words = [w for w in rng.choice(out)[0] if rng.random() < 0.85] + words[:1]
        out.append((list(dict.fromkeys(words)), rng.choice(["Ann", "Bob", None]), rng.choice([0.0, 0.3, 0.5, 0.6, 1.0])))
    return out


def plain_drops(units):
    gone, out = set(), []
    for i, (wi, a, si) in enumerate(units, 1):
        for j, (wj, b, sj) in list(enumerate(units, 1))[i:]:
            if i in gone or j in gone or a is None or b is None:
                continue
            s, drop = jaccard(wi, wj), None
            if a == b and s >= L.SAME_SPEAKER:
                drop, reason = (i if len(wi) <= len(wj) else j), L.REPEATED_EVENT
            elif a != b and s >= L.CONFLICT:
                reason = L.OPPOSED_EVENT
                drop = i if si <= L.WEAK and sj >= L.STRONG else j if sj <= L.WEAK and si >= L.STRONG else None
            if drop:
                gone.add(drop)
                out.append((drop, i + j - drop, reason))
    return out


@pytest.mark.parametrize("short", [0, 48])
def test_pairs_and_drops_equal_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(similar, "SHORT", short)
    cases = [some_units(k, n) for k, n in enumerate([0, 1, 2, 5, 12, 30, 47, 60])] + [[(["x", "y"], "Ann", 1.0)] * 9]
    df = spark.createDataFrame(list(enumerate(cases)), UNITS)
    two = F.transform("units", lambda u: F.struct(u["words"].alias("words"), u["speaker"].alias("speaker")))
    for least in (0.5, 0.68, 0.82, 1.0):
        for r in df.select("id", similar.pairs(two, least).alias("p")).collect():
            units = cases[r.id]
            want = [(i + 1, j + 1, jaccard(a[0], b[0]), a[1], b[1]) for i, a in enumerate(units) for j, b in enumerate(units) if i < j and jaccard(a[0], b[0]) >= least]
            assert [tuple(p) for p in r.p] == want
    for r in df.select("id", similar.drops(F.col("units")).alias("d")).collect():
        assert [tuple(d) for d in r.d] == plain_drops(cases[r.id])


def test_thousands_of_sentences(spark):
    rng = random.Random(3)
    units = [([f"w{int(rng.expovariate(0.002))}" for _ in range(6)] + [f"n{k}"], rng.choice(["Ann", "Bob"]), 1.0) for k in range(5000)]
    units = [(list(dict.fromkeys(w)), s, c) for w, s, c in units] + [(["same", "thing", "again"], "Ann", 1.0)] * 300
    index = similar.Index([u[0] for u in units], 0.5)
    looked = sum(1 for i in range(5000) for _ in index.after(i))
    assert looked < 2000
    row = spark.createDataFrame([(1, units)], UNITS).select(similar.drops(F.col("units")).alias("d")).head()
    assert len(row.d) >= 299 and len({d.drop for d in row.d}) == len(row.d)


def test_names_in_one_pass_equal_one_by_one(spark):
    rng = random.Random(5)
    pool = ["Ann", "Ann Lee", "ANN", "Anna", "O'Neil", "Jean-Luc", "J.", "Bob", "Mc", "Dr. No", "Al"]
    rows = []
    for k in range(300):
        names = rng.sample(pool, rng.randint(0, 6))
        words = [rng.choice([*pool, "annex", "will", "bobsled", "xal", "al-", "go.", "o'neil's", "j", "dr.", "no"]) for _ in range(rng.randint(0, 7))]
        rows.append((k, rng.choice([" ", "  ", ", "]).join(words), names))
    df = spark.createDataFrame(rows, "id int, s string, names array<string>")

    def plain(s, names):
        found = []
        for n in names:
            m = re.search(r"\b" + re.escape(n.lower()) + r"\b", s.lower())
            if m:
                found.append((m.start(), n))
        return min(found)[1] if found else None

    for r in df.select("id", X.primary_speaker(F.col("s"), F.col("names")).alias("w")).collect():
        assert r.w == plain(*rows[r.id][1:]), rows[r.id]


def test_overlaps_and_grams(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice("abcdef") for _ in range(rng.randint(0, 12))], [rng.choice("abcxyz") for _ in range(rng.randint(0, 12))]) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    for r in df.select("id", R.overlap(F.col("a"), F.col("b")).alias("n"), *[X.n_grams(F.col("a"), k).alias(f"g{k}") for k in (1, 2, 3)]).collect():
        _, a, b = rows[r.id]
        assert r.n == (Counter(a) & Counter(b)).total()
        for k in (1, 2, 3):
            assert r[f"g{k}"] == [" ".join(a[i : i + k]) for i in range(len(a) - k + 1)]


def scores(r, p, n):
    grams = [Counter(" ".join(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, p)]
    shared = (grams[0] & grams[1]).total()
    a, b = (shared / max(1, g.total()) for g in (grams[1], grams[0]))
    return a, b, 2 * a * b / (a + b) if a + b else 0.0


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_stemmed_and_longest_queries_over_whole_tables(spark):
    data = "/root/testdata/sf0.001"
    passages = {r.item_id: r.text or "" for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    stems = lambda t: [stem(w) if len(w) > 3 else w for w in words(t)]
    for r in Q.rouge_stemmed(spark, data).collect():
        a, b = stems(passages[r.doc_id % len(passages)]), stems(docs[r.doc_id])
        want = [*scores(a, b, 1), *scores(a, b, 2)]
        assert [r[f"rouge{n}_{c}"] for n in (1, 2) for c in ("precision", "recall", "fmeasure")] == pytest.approx(want, abs=1e-9)
    for r in Q.rouge_l(spark, data).collect():
        a, b = words(passages[r.doc_id % len(passages)]), words(docs[r.doc_id])
        n = common_length(b, a)
        p, c = n / max(1, len(b)), n / max(1, len(a))
        assert (r.rougeL_precision, r.rougeL_recall, r.rougeL_fmeasure) == pytest.approx((p, c, 2 * p * c / (p + c) if n else 0.0), abs=1e-9)
