"""Near vectors and whitening against brute force, SQL and odd rows."""

import math

import numpy as np
import pytest

from parlance.llm import near_vectors, whitening
from parlance.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int, times string, u int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, None) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def linked_by_force(rows, threshold):
    """(id, links, component) of each row."""
    n = len(rows)
    near = [set() for _ in range(n)]
    x = [np.array(v, np.float32).astype(float) if usable(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def some_vectors(seed, d, n=120):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for k in range(n):
        kind = k % 4
        v = rng.normal(size=d) if kind == 0 else centres[k % 6] + rng.normal(size=d) * (0.02, 0.2, 0.45)[kind - 1]
        rows.append((k, [float(c) for c in v.astype(np.float32)]))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[7][1]), (None, rows[3][1]), (202, [2 * c for c in rows[5][1]])]
    return rows


ODD = [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 0.0]), (305, [float("inf"), 1.0, 1.0]), (306, [1.0, 2.0, 3.0]), (None, [-0.0, 0.0, 0.0]),
       (307, [1e30, 2e30, 3e30]), (308, [1e-30, 2e-30, 3e-30]), (309, [5.0]), (310, [0.25]), (311, [-3.0]), (None, [7.0, 1.0]), (312, None)]


@pytest.mark.parametrize(("d", "tile"), [(3, 1 << 20), (3, 200), (40, 4000), (40, 1 << 20), (1, 64)])
def test_links_equal_all_pairs(spark, d, tile):
    rows = some_vectors(d, d) + ODD
    got = near_vectors.link_vectors(spark, frame(spark, rows), tile_bytes=tile).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(key, got)) == sorted(map(key, linked_by_force(rows, 0.9)))


def test_tight_groups_and_other_thresholds(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(k, [float(c) for c in (base + 1e-3 * rng.normal(size=16) if k % 3 else rng.normal(size=16)).astype(np.float32)]) for k in range(150)]
    for threshold in (0.5, 0.9999, 1.0):
        got = near_vectors.link_vectors(spark, frame(spark, rows), threshold=threshold, tile_bytes=2048).collect()
        assert sorted(map(key, got)) == sorted(map(key, linked_by_force(rows, threshold)))
    with pytest.raises(ValueError):
        near_vectors.link_vectors(spark, frame(spark, rows), threshold=0.0)


def test_comparison_stops_early_but_loses_nothing():
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(size=(900, 70)), np.repeat(rng.normal(size=(30, 70)), 20, 0) + 0.25 * rng.normal(size=(600, 70))])
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    for axes in (None, np.linalg.eigh(unit.T @ unit)[1][:, ::-1]):
        found = set()
        for left, right in near_vectors.Comparison(0.9, axes).links(a, a, True):
            found |= set(zip(left.tolist(), right.tolist()))
        assert found == {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9)) if i < j}
        across = [pair for left, right in near_vectors.Comparison(0.9, axes).links(a[:800], a[700:], False) for pair in zip(left.tolist(), right.tolist())]
        assert sorted(across) == sorted(zip(*[x.tolist() for x in np.nonzero(unit[:800] @ unit[700:].T >= 0.9)]))


def test_pairs_at_the_threshold_follow_the_plain_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [float(np.float32(0.9)), float(np.float32(math.sqrt(0.19)))]), (2, [9.0, math.sqrt(19)]), (3, [0.9000001, 0.43588]), (4, [0.8999999, 0.4358901])]
    got = near_vectors.link_vectors(spark, frame(spark, rows)).collect()
    assert sorted(map(key, got)) == sorted(map(key, linked_by_force(rows, 0.9)))


def test_forest_joins_what_edges_join():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 60
        edges = rng.integers(0, n, (2, int(rng.integers(0, 80))))
        labels = near_vectors.forest(near_vectors.forest(np.arange(n), *edges[:, ::2]), *edges[:, 1::2])
        want = np.arange(n)
        for _ in range(n):
            for a, b in edges.T:
                want[[a, b]] = min(want[a], want[b])
        assert labels.tolist() == want.tolist()


def test_empty_tables(spark):
    none = frame(spark, [(1, [1.0])]).filter("1 = 0")
    assert near_vectors.link_vectors(spark, none).collect() == []
    assert whitening.whiten(spark, none).collect() == []
    bad = frame(spark, [(1, None), (None, [0.0]), (2, [float("nan")])])
    assert sorted(map(key, near_vectors.link_vectors(spark, bad).collect())) == sorted(map(key, linked_by_force([(1, None), (None, [0.0]), (2, [math.nan])], 0.9)))


def test_near_vectors_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = some_vectors(3, 12) + ODD
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = base.execute(Q.ORACLE_SQL["op11_near_vectors"]).fetchall()
    assert sorted(map(key, Q.op11_near_vectors(spark, str(tmp_path)).collect())) == sorted(map(key, want))


# ---- whitening -----------------------------------------------------------------------------


def whitened_by_force(rows):
    """Per length: (n, {x: deviation}, whitened function, explained) from whole numbers."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fits = {}
    for d in {len(x) for _, x in kept} - {0}:
        fit = sorted({x for _, x in kept if len(x) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float)
        values, vectors = np.linalg.eigh(y.T @ y / n / n**2)
        fits[d] = n, sums, values[::-1][:4], vectors[:, ::-1][:, :4], np.trace(y.T @ y / n / n**2)
    return kept, fits


def check_whitened(spark, rows):
    got = whitening.whiten(spark, frame(spark, rows)).toPandas()
    kept, fits = whitened_by_force(rows)
    assert len(got) == sum(min(4, len(x)) for _, x in kept)
    for d, (n, sums, values, vectors, trace) in fits.items():
        mine = [(i, x) for i, x in kept if len(x) == d]
        for k in range(min(4, d)):
            ids = {-1 if i is None else i for i, _ in mine}
            part = got[(got.component == k + 1) & got.vec_id.fillna(-1).isin(ids) & (got.n == n)]
            want = sorted((-1 if i is None else i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in mine)
            assert sorted(zip(part.vec_id.fillna(-1).astype(int), part.deviation.astype(object))) == want
            if values[k] > 1e-9 * values[0] > 0:
                w = {(-1 if i is None else i): (np.array([n * c - s for c, s in zip(x, sums)], float) @ vectors[:, k]) / n / math.sqrt(values[k]) for i, x in mine}
                have = part.whitened.to_numpy(float)
                ref = np.array([w[-1 if math.isnan(i) else int(i)] for i in part.vec_id.astype(float)])
                assert min(np.abs(have - ref).max(), np.abs(have + ref).max()) < 1e-6
                assert np.allclose(part.explained.astype(float), values[k] / trace, rtol=1e-9)
                assert (part.identity_error.astype(float) < 1e-9).all()
            else:
                assert part.whitened.isna().all()
    return got


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(2)
    scale = np.array([5, 3, 2, 1, 0.5, 0.3])
    rows = [(k, [float(c) for c in (100 + rng.normal(size=6) * scale).astype(np.float32)]) for k in range(80)]
    rows += [(200, rows[0][1]), (None, rows[1][1]), (202, rows[1][1])]
    rows += [(300, None), (301, [1.0, None]), (302, [math.nan]), (303, [math.inf] * 6), (304, [])]
    check_whitened(spark, rows)


def test_whitening_of_other_lengths_and_without_variance(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in rng.normal(size=3).astype(np.float32)]) for k in range(30)]
    rows += [(100 + k, [1.5, 2.5]) for k in range(3)] + [(200 + k, [float(k % 4), 2.0 * (k % 4), 1.0, 1.0, 0.0]) for k in range(9)]
    got = check_whitened(spark, rows)
    alone = got[got.vec_id.between(100, 102)]
    assert (alone.n == 1).all() and alone.whitened.isna().all() and alone.explained.isna().all() and alone.identity_error.isna().all() and (alone.deviation == 0).all()


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 0.0])]
    got = whitening.whiten(spark, frame(spark, rows)).toPandas()
    assert len(got) == 6 and got[got.vec_id < 2].deviation.isna().all() and (got.n == 3).all()
    assert (got[got.vec_id == 2].deviation == 768**2 + 1).all()  # the sums are -1 (of the largest and the least long) and 768
    fit = whitening.Fit(3, [0], 1 << 40, np.eye(1), np.ones(1), [1.0])
    y = fit.centred(np.array([[1 << 40], [2]]))
    assert fit.deviations(y) == [None, 36]
