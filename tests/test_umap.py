"""The UMAP layout keeps neighbourhoods; its curve and graph are those of the definition."""

import numpy as np
import pytest

from tessera.operators import umap as module
from tessera.operators.umap import curve, fuzzy_graph, umap_layout


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)


def test_curve():
    a, b = curve()  # known values of the default settings
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.005)
    for min_dist in (0.0, 0.5, 0.9):
        a, b = curve(min_dist)
        x = np.linspace(0.01, 3, 50)
        assert np.abs(1 / (1 + a * x ** (2 * b)) - np.where(x < min_dist, 1, np.exp(min_dist - x))).max() < 0.2


def test_graph(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = np.zeros((40, 40))
    for i in range(40):
        near = [j for j in np.argsort(d[i]) if j != i][:5]
        over = d[i, near] - d[i, near].min()
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-over / mid).sum() > np.log2(6) else (mid, hi)
        want[i, near] = np.exp(-over / lo)
    want = want + want.T - want * want.T
    got = np.zeros((40, 40))
    for r in fuzzy_graph(_frame(spark, x), 6).collect():
        got[r["i"], r["j"]] = r["w"]
    assert np.allclose(got, want, atol=1e-5)


def test_neighbourhoods(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(loc=c, scale=0.5, size=(20, 8)) for c in np.eye(8) * 4])  # two components can't part eight corners
    kept = []
    for epochs in (0, 30):
        got = {r["id"]: (r["x_embed"], r["y_embed"]) for r in umap_layout(_frame(spark, x), "id", "v", neighbours=10, epochs=epochs).collect()}
        y = np.array([got[i] for i in range(160)])
        far = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) + np.eye(160) * 1e9
        assert np.isfinite(y).all()
        kept.append((far.argsort(1)[:, :8] // 20 == np.arange(160)[:, None] // 20).mean())
    assert kept[1] > 0.9 and kept[1] > kept[0] + 0.1


def test_odd_rows(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [0.0, 3.0]), ("b", None), ("c", [None, 1.0]), ("d", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = umap_layout(df, "id", "v", epochs=2, metric="cosine").collect()
    assert sorted(str(r["id"]) for r in got) == ["None", "a", "a", "d"] and all(np.isfinite([r["x_embed"], r["y_embed"]]).all() for r in got)
    assert umap_layout(df.limit(0), "id", "v").count() == 0
    for bad in (dict(metric="hamming"), dict(neighbours=1)):
        with pytest.raises(ValueError):
            umap_layout(df, "id", "v", **bad)


def test_packed_epochs_are_the_joined_ones(spark, monkeypatch):
    """Positions that are broadcast give the same layout as those joined to the edges, and nothing is written by an epoch."""
    x = np.random.default_rng(5).normal(size=(70, 4))
    x[60:] = x[0]  # copies
    places, written = [], []
    plain = module.reliable_checkpoint
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df: written.append(1) or plain(df))
    for most in (module.MAX_POINTS, 10):
        monkeypatch.setattr(module, "MAX_POINTS", most)
        written.clear()
        got = {r["id"]: (r["x_embed"], r["y_embed"]) for r in umap_layout(_frame(spark, x), "id", "v", neighbours=6, epochs=4).collect()}
        places.append(np.array([got[i] for i in range(70)]))
        assert (len(written) < 8) == (most > 10)
    assert np.allclose(*places, atol=1e-6)
