"""Shared rounds of centres: against numpy, and all restarts in the same jobs."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import lloyd as L


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")


def test_rounds_follow_the_definition(spark, monkeypatch):
    monkeypatch.setattr(L, "CELL_VALUES", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(83, 4))
    starts = [x[:3], x[10:15], np.vstack([x[:2], np.full((1, 4), 99.0)])]  # the last centre of the third set gets no row
    packed = L.pack(_frame(spark, x), "v")
    for (cost, centres), c in zip(L.lloyd(packed, starts, 4, 0.0), starts):
        for _ in range(4):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            near, want = d.argmin(1), d.min(1).sum()
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        assert np.allclose(centres, c) and np.isclose(cost, want)


def test_a_row_that_is_a_first_centre_keeps_its_own():
    x = np.ones((4, 2))
    (_, near, _), = L.nearest(x, x, np.array([2, -1, 3, 0]))
    assert near.tolist() == [2, 0, 3, 0]


def test_restarts_share_their_jobs(spark, monkeypatch):
    from tessera.operators import cluster as C

    seen, real = [], L.sums_by_centre
    monkeypatch.setattr(L, "sums_by_centre", lambda packed, sets, *a: seen.append(len(sets)) or real(packed, sets, *a))
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(loc=c, scale=0.2, size=(30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    frame, centres = C.kmeans(_frame(spark, x), "v", 3, n_init=4, id_col="id")
    labels = [r["cluster"] for r in frame.orderBy("id").collect()]
    assert sorted(map(len, (set(labels[:30]), set(labels[30:60]), set(labels[60:])))) == [1, 1, 1] and len(set(labels)) == 3
    assert seen[0] == 4 and seen == sorted(seen, reverse=True)


def test_vectors_of_different_lengths_are_refused():
    with pytest.raises(ValueError, match="different lengths"):
        L.matrix(pa.array([[1.0], [1.0, 2.0]]))
