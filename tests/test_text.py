"""Text functions against Python's own string functions and golden rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance import queries as Q
from parlance.functions import rouge as R
from parlance.functions import text as X
from parlance.functions.stem import stem
from parlance.operators import attribution, facts, reliability

TEXTS = ["", " ", "a\n\n b \r\nc d\x0be\x1cf", " x ", "Go. Then! ok? \"Yes.\" No", "one two\tthree", "It costs 3.30 now. Tail", "éa ßB Ça.", "x\x1f"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)


def column(df, expr):
    return [r[1] for r in sorted(df.select("i", expr).collect())]


def test_strip_lines_tokens(texts):
    assert column(texts, X.strip(F.col("t"))) == [t.strip() for t in TEXTS]
    got = column(texts, X.turns(F.col("t")))
    assert [[(r.idx, r.line) for r in row] for row in got] == [[(i, x.strip()) for i, x in enumerate(t.splitlines()) if x.strip()] for t in TEXTS]
    assert column(texts, X.tokens(F.col("t"))) == [t.split() for t in TEXTS]
    assert column(texts, X.token_count(F.col("t"))) == [len(t.split()) for t in TEXTS]


def test_sentences(spark):
    df = spark.createDataFrame([(0, 'It is 3.30. "Go." Then?\tYes! tail')], "i int, t string")
    assert column(df, X.sentences(F.col("t"))) == [["It is 3.30.", '"Go." Then?', "Yes!", "tail"]]
    assert column(df, X.sentence_units(F.col("t"))) == [["It is 3.", "30.", '"Go.', '" Then?', "Yes!"]]
    assert column(df, X.complete_sentences(F.col("t"))) == ['It is 3.30. "Go." Then? Yes!']


@pytest.mark.parametrize(("text", "unfinished"), [("", False), ("  ", False), ("Done.", False), ('He said "no."', False), ("(so!)  ", False), ("not yet", True), ("no.)]", True)])
def test_incomplete(spark, text, unfinished):
    assert spark.range(1).select(X.is_incomplete(F.lit(text))).head()[0] is unfinished


#: Text to the matches of the number pattern.
NUMBERS = {
    "1.5x": ["1"], "50%off": ["50"], "50% off": ["50%"], "5x v2": [], "-5": ["5"], "10 Am": ["10"], ", 10": [" 10"], "a 10": ["10"], "5 hourss": ["5"],
    "at 3:00 PM for €10 or 1,200 euros": ["3:00 PM", "€10", "1,200 euros"], "5é": [],
}


def test_numbers(spark):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, t string")
    assert column(df, facts.numbers(F.col("t"))) == list(NUMBERS.values())
    assert spark.range(1).select(facts.norm_number(F.lit(" 1,200 Euros"))).head()[0] == "1200euros"


def test_facts(spark):
    d = "Alice: Meet Bob at 3:00 PM.\nJosé: Fine, €10.\n  Mary Ann : Hi Mary!\nalice: no"
    row = spark.range(1).select(facts.fact_struct(F.lit(d)).alias("f"), facts.facts_text(facts.fact_struct(F.lit(d))).alias("t")).head()
    assert row.f.speakers == ["Alice", "Mary Ann"]
    assert row.f.numbers == ["3:00 PM", "€10"]
    assert row.f.mentioned_people == ["Meet", "Bob", "PM", "Fine", "Mary", "Ann", "Hi"]
    assert row.t.splitlines()[0] == "Dialogue speakers: Alice, Mary Ann"
    assert "none detected" in spark.range(1).select(facts.facts_text(facts.fact_struct(F.lit("")))).head()[0]


def test_words_and_speakers(spark):
    row = spark.range(1).select(X.content_words(F.lit("The the Cat, it's a MONDAY Monday cat")).alias("c"), X.action_words(F.lit("Ann will Pack the big Box"), F.array(F.lit("ann"))).alias("a")).head()
    assert row.c == ["the", "cat", "it's", "monday"]
    assert row.a == ["pack", "big", "box"]
    names = F.array(F.lit("Bob"), F.lit("Al"), F.lit("Bo"))
    who = [spark.range(1).select(X.primary_speaker(F.lit(s), names)).head()[0] for s in ("Alice met bob.", "al and Bob", "Bobby", "")]
    assert who == ["Bob", "Al", None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rouge_against_a_plain_table(spark):
    import random

    rng = random.Random(3)
    pairs = [([rng.choice("abcdefg") for _ in range(rng.randint(0, 150))], [rng.choice("abcdefg") for _ in range(rng.randint(0, 150))]) for _ in range(25)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = column(df, R.lcs(F.col("a"), F.col("b")))
    assert got == [lcs(a, b) for a, b in pairs]
    shared = column(df, R.overlap(F.col("a"), F.col("b")))
    assert shared == [sum(min(a.count(x), b.count(x)) for x in set(a)) for a, b in pairs]


def test_bound_values_are_computed_once(spark):
    """F4 to F9, F11 to F14: what a lambda uses for each element was computed anew for each."""
    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(Q.dialogue_facts_text(spark, data)).count("regexp_extract_all") == 3
    assert plan(Q.primary_speaker(spark, data)).count("regexp_extract(") == 1
    assert "array_union" not in plan(reliability.assess(Q.orders_as_pairs(spark, data)))
    assert plan(attribution.repair(Q.orders_as_pairs(spark, data))).count("regexp_extract(") == 6


def test_rouge_of_texts_in_one_pass(spark):
    """counts of whole texts equal those of token arrays, nulls too."""
    words = ["The", "cat", "sat", "on", "mat", "running", "x1"]
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 90))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(40)] + [(40, None, "a"), (41, "a b", None)]
    df = spark.createDataFrame(texts, "id int, a string, b string")
    for stem in (False, True):
        plain = R.rouge(R.rouge_tokens(F.col("a"), stem), R.rouge_tokens(F.col("b"), stem))
        for r in df.select("id", plain.alias("x")).join(df.select("id", R.of_counts(R.counts(F.col("a"), F.col("b"), stem)).alias("y")), "id").collect():
            assert r.x == r.y
    plan = Q.rouge_1_2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_rouge_scores(spark):
    r = spark.range(1).select(R.rouge(R.rouge_tokens(F.lit("The cat sat on the mat.")), R.rouge_tokens(F.lit("the cat on a mat the"))).alias("r")).head().r
    assert r.rouge1.recall == pytest.approx(5 / 6)
    assert r.rouge2.precision == pytest.approx(1 / 5)
    assert r.rougeL.fmeasure == pytest.approx(2 / 3)
    assert spark.range(1).select(R.rouge(R.rouge_tokens(F.lit("")), R.rouge_tokens(F.lit("a"))).alias("r")).head().r.rougeL.fmeasure == 0


def test_stemmer():
    # examples of the published description
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
            "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in want} == want


def test_patterns_equal_pythons():
    word = re.compile(L.WORD)
    assert word.findall("It's a-b 'x") == ["It's", "a-b", "x"]
