"""Exact neighbours and joins by blocks: tiles against brute force, copies, and the rows that are sent to tasks."""

import numpy as np
import pytest

from tessera.operators import similarity as M


def _brute(v, k, metric):
    s = M._scores(v, v, metric)
    np.fill_diagonal(s, -np.inf)
    ids = np.broadcast_to(np.arange(len(v)), s.shape)
    order = np.lexsort((ids, -np.round(s, 7)), axis=1)[:, :k]
    return order, np.take_along_axis(s, order, 1)


@pytest.mark.parametrize("metric", M.METRICS)
def test_tiles_give_the_brute_force_neighbours(metric, monkeypatch):
    for name, size in (("WHOLE", 0), ("STRIP", 16), ("TILE", 24), ("FOLD", 7), ("CHUNK", 40)):
        monkeypatch.setattr(M, name, size)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 9)) + 4.0
    v[60:100] = v[7]  # more copies than k
    if metric == "hellinger":
        v = np.abs(v)
    if metric == "cosine":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(150)
    i, j, s = M._nearest(ids, v, ids, v, 6, metric, True)
    order, score = _brute(v, 6, metric)
    assert (i.reshape(-1, 6) == ids[:, None]).all() and (j.reshape(-1, 6) == order).all()
    assert np.allclose(s.reshape(-1, 6), score, atol=1e-6)


def test_rows_without_a_finite_score_have_no_neighbours(monkeypatch):
    monkeypatch.setattr(M, "WHOLE", 0)
    v = np.random.default_rng(4).normal(size=(30, 4))
    v[3, 1], v[5, 2] = np.nan, np.inf
    ids = np.arange(30)
    for metric in ("euclidean", "manhattan", "chebyshev", "cosine"):
        i, j, _ = M._nearest(ids, v, ids, v, 40, metric, True)
        assert set(i) == set(j) == set(range(30)) - {3, 5} and len(i) == 28 * 27


def test_a_block_has_many_rows_however_small_block_rows(spark):
    rows = spark.range(40_000).selectExpr("id", "array(cast(id as double), 1D) as v")
    slots = spark.sparkContext.defaultParallelism
    assert M._blocks(rows, "v", 128) <= max(2, int(np.ceil(np.sqrt(4 * slots))))
    assert M._blocks(rows.limit(100), "v", 128) == 1
    assert M._blocks(rows.limit(0), "v", 128) == 1
    assert M._blocks(rows, "v", 128, 1_000) == 40


def test_join_scores_each_pair_by_itself(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 5))
    v[50:60] = v[3]
    df = spark.createDataFrame([(int(n), [float(x) for x in r]) for n, r in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if s[a, b] >= 0.9}
    got = {(r.id1, r.id2): r.cosine_similarity for r in M.cosine_join(df, "id", "v", 0.9, block_rows=16).collect()}
    assert set(got) == want and all(abs(x - s[p]) < 1e-12 for p, x in got.items())
    pair = [got[(a, b)] for a in (3, *range(50, 60)) for b in (3, *range(50, 60)) if a < b]
    assert len(set(pair)) == 1
