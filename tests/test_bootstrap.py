"""Bootstrap intervals against numpy's generator, and the streams that tasks jump into."""

import numpy as np
import pytest

from parlance import queries as Q
from parlance.operators import bootstrap, evaluation

DATA = "/root/testdata/sf0.001"


def frame(spark, values, group="real_long"):
    return spark.createDataFrame([(f"{i:05d}", group, float(v)) for i, v in enumerate(values)], "source_index string, eval_type string, d double").repartition(3)


def expected(arrays, samples, seed=42):
    rng, out = np.random.default_rng(seed), []
    for x in arrays:
        out.append((len(x), x.mean(), *np.quantile(x[rng.integers(0, len(x), size=(samples, len(x)))].mean(1), [0.025, 0.975])))
    return out


@pytest.mark.parametrize("n", [2, 3, 12, 64, 1000, 3_000_000_000, (1 << 32) - 1, (1 << 31) + 1])
def test_stream_equals_the_generator(n):
    stream = bootstrap.Stream(42, n)
    want = np.random.default_rng(42).integers(0, n, size=5000)
    got = np.concatenate([x for _, x in zip(range(3), stream.drawn(0))])
    assert got[:5000].tolist() == want.tolist()
    for first in (0, 1, 2, 7, 100, 101):
        words = np.concatenate(list(stream.words(0, 400)))
        assert np.concatenate(list(stream.words(first, 290))).tolist() == words[first : first + 290].tolist()
    assert stream.accepted(0, 1001) + stream.accepted(1001, 999) == stream.accepted(0, 2000)


def test_words_in_small_parts(monkeypatch):
    monkeypatch.setattr(bootstrap, "HELD", 5)
    stream = bootstrap.Stream(7, 3_000_000_000)
    want = np.random.default_rng(7).integers(0, 3_000_000_000, size=60).reshape(20, 3)
    runs = bootstrap.Stream(7, 3_000_000_000)
    runs.n, runs.least = 3_000_000_000, stream.least
    got, source = [], stream.drawn(0)
    while len(got) < 60:
        got += next(source).tolist()
    assert got[:60] == want.ravel().tolist()


@pytest.mark.parametrize(("block", "draws"), [(1 << 22, 1 << 25), (64, 30)])
def test_intervals_equal_numpy(spark, monkeypatch, block, draws):
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "TASK_DRAWS", draws)
    x = np.arange(12) / 7.0
    r = bootstrap.bootstrap_ci(frame(spark, x), "d", samples=300).collect()
    assert [(r[0].n, r[0]["mean"], r[0].low, r[0].high)] == expected([x], 300) and r[0].group == "all"
    parts = [np.random.default_rng(k).normal(size=n) for k, n in enumerate((13, 1, 37))]
    df = frame(spark, parts[0], "a").unionByName(frame(spark, parts[1], "b")).unionByName(frame(spark, parts[2], "c"))
    got = {r.group: (r.n, r["mean"], r.low, r.high) for r in bootstrap.bootstrap_ci(df, "d", groups=("a", "none", "b", "c"), samples=40).collect()}
    assert [got[g] for g in "abc"] == expected(parts, 40)


def test_ranges_of_values_add_up(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=50)
    monkeypatch.setattr(bootstrap, "RANGE", 8)
    r = bootstrap.bootstrap_ci(frame(spark, x), "d", samples=100).head()
    assert (r.n, r["mean"], r.low, r.high) == pytest.approx(expected([x], 100)[0], rel=1e-12)


def test_values_reach_each_task_once(spark, monkeypatch):
    """rows were sent once for every few resamples; tasks are bounded by the cores, whatever the rows."""
    monkeypatch.setattr(bootstrap, "TASK_DRAWS", 30)
    monkeypatch.setattr(bootstrap, "TASKS_A_CORE", 1)
    assert len(bootstrap._plan(spark, [("all", 50)], 400, 42)) == spark.sparkContext.defaultParallelism
    x = np.random.default_rng(4).normal(size=50)
    r = bootstrap.bootstrap_ci(frame(spark, x), "d", samples=400).head()
    assert [(r.n, r["mean"], r.low, r.high)] == expected([x], 400)


@pytest.mark.parametrize("n", [3, 127, 1000, 1023, 4096])
def test_sums_are_numpys_without_an_array_of_all_draws(monkeypatch, n):
    """a resample was copied into an array as long as the rows, for which ranges had to be half as long: all words
    were drawn twice for over 2^24 rows."""
    x = np.random.default_rng(n).normal(size=n) * 10.0 ** np.random.default_rng(1).integers(-9, 9, n)
    draws = np.random.default_rng(42)
    plain = [x[draws.integers(0, n, size=n)].sum() for _ in range(40)]
    made, empty = [], np.empty
    monkeypatch.setattr(bootstrap, "HELD", 128)
    monkeypatch.setattr(np, "empty", lambda size, *a, **k: made.append(size) or empty(size, *a, **k))
    assert list(bootstrap.Stream(42, n).sums(x, 0, 0, 0, 40)) == plain
    assert max(made) <= 128 and bootstrap.RANGE * 8 <= 1 << 28


@pytest.mark.parametrize("n", [5, 1000, (1 << 31) + 1])
def test_generator_at_any_word(n):
    stream = bootstrap.Stream(9, n)
    for first in (0, 1, 6, 17):
        words = np.concatenate(list(stream.words(first, 400))).astype(np.uint64) * np.uint64(n)
        kept = (words >> np.uint64(32))[(words & np.uint64(0xFFFFFFFF)) >= np.uint64(stream.least)]
        assert stream.generator(first).integers(0, n, size=len(kept)).tolist() == kept.tolist()


def test_no_rows_and_unknown_values(spark):
    none = frame(spark, [1.0]).filter("1 = 0")
    assert bootstrap.bootstrap_ci(none, "d").collect() == []
    assert bootstrap.poisson_bootstrap_ci(none, "d", samples=10).head()["mean"] is None
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", 1.0)], "source_index string, eval_type string, d double")
    assert tuple(bootstrap.bootstrap_ci(rows, "d", samples=50).head()) == ("all", 2, None, None, None)
    with pytest.raises(ValueError):
        bootstrap.Stream(42, 1 << 32)


def test_query_takes_all_documents(spark):
    pairs = evaluation.paired(Q._document_scores(spark, DATA)).toPandas()
    x = pairs.assign(k=pairs["source_index"].astype(str)).sort_values("k")["d_critical"].to_numpy()
    assert len(set(x)) > 20
    r = Q.bootstrap_ci(spark, DATA).head()
    assert [(r.n, r["mean"], r.low, r.high)] == expected([x], 10_000)
    p = Q.poisson_bootstrap_ci(spark, DATA).head()
    assert abs(p.low - r.low) < 0.01 and abs(p.high - r.high) < 0.01 and abs(p["mean"] - x.mean()) < 0.005


def test_poisson_weights_do_not_depend_on_partitions(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=200)
    one = bootstrap.poisson_bootstrap_ci(frame(spark, x).coalesce(1), "d", samples=500).head()
    monkeypatch.setattr(bootstrap, "WEIGHTS", 900)
    two = bootstrap.poisson_bootstrap_ci(frame(spark, x).repartition(7), "d", samples=500).head()
    assert (one.low, one.high) == pytest.approx((two.low, two.high)) and one.low < x.mean() < one.high
    spread = (one.high - one.low) / (2 * 1.96 * x.std() / np.sqrt(200))
    assert 0.85 < spread < 1.15


def test_report_of_deltas_that_differ(spark):
    out = {r.eval_type: r for r in Q.interval_report(spark, DATA).collect()}
    pairs = evaluation.paired(Q._scored(spark, DATA)).toPandas()
    pairs["k"] = pairs["source_index"].astype(str)
    arrays = [pairs[pairs.eval_type == g].sort_values("k")["d_rougeL"].to_numpy() for g in ("real_long", "synthetic_stress")]
    for g, (n, mean, low, high) in zip(("real_long", "synthetic_stress"), expected(arrays, 10_000)):
        assert (out[g].n, out[g].rougeL_low, out[g].rougeL_high) == (n, low, high) and low < mean < high
        assert out[g].rougeL_delta == pytest.approx(mean)
