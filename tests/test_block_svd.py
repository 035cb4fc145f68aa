"""The randomised SVD over blocks: against numpy, with several blocks, lone terms, and no dense block on the driver."""

import numpy as np
import pytest

from tessera.operators import block_svd as B
from tessera.operators import reduce as R
from tessera.operators import strip_svd as ST


def _long(spark):
    rng = np.random.default_rng(8)
    rows = [(f"d{d}", f"t{t}", float(rng.random() + 0.1)) for d in range(40) for t in rng.choice(30, 6, replace=False)]
    rows += [(f"d{d}", f"lone{d}", 0.5 + d / 100) for d in range(0, 40, 3)]
    return rows, spark.createDataFrame(rows, "doc_id string, term string, weight double")


def test_blocks_give_the_svd(spark, monkeypatch):
    rows, w = _long(spark)
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    a = np.zeros((len(docs), len(terms)))
    for d, t, x in rows:
        a[docs.index(d), terms.index(t)] += x
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    monkeypatch.setattr(R, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(R, "_to_block", lambda *args: pytest.fail("a dense block on the driver"))
    monkeypatch.setattr(B, "BLOCK_VALUES", 1_000)  # several blocks
    model, scores = R.truncated_svd(w, k=4, n_oversamples=36, n_iter=4)
    assert np.allclose(model.singular_values, s[:4], rtol=1e-6)
    got = {r.doc_id: r.reduced for r in scores.collect()}
    loads = {r.term: r.comp for r in model.loadings.collect()}
    assert set(got) == set(docs) and set(loads) == set(terms)
    v = np.array([loads[t] for t in terms])
    assert np.allclose(np.abs(v), np.abs(vt[:4].T), atol=1e-5)
    assert all(v[np.abs(np.round(v[:, j], 12)).argmax(), j] > 0 for j in range(4))
    assert np.allclose(np.array([got[d] for d in docs]), a @ v, atol=1e-5)
    again = {r.doc_id: r.reduced for r in model.transform(w).collect()}
    assert all(np.allclose(again[d], got[d], atol=1e-5) for d in docs)


def test_fewer_directions_than_columns(spark, monkeypatch):
    rows = [(d, t, 1.0 + (d % 2) * t) for d in range(6) for t in range(4)]
    w = spark.createDataFrame([(d, f"t{t}", x) for d, t, x in rows], "doc_id long, term string, weight double")
    monkeypatch.setattr(R, "BROADCAST_VALUES", 0)
    model, scores = R.truncated_svd(w, k=3)
    a = np.zeros((6, 4))
    for d, t, x in rows:
        a[d, t] = x
    assert np.allclose(model.singular_values, np.linalg.svd(a, compute_uv=False)[:3], atol=1e-6)
    assert scores.count() == 6


@pytest.mark.parametrize("spread_rows", [False, True])
def test_strips_give_the_svd(spark, monkeypatch, spread_rows):
    """Many terms: strips of columns, several chunks, cells and ranges; no dense block of terms, no blocks of documents."""
    rows, w = _long(spark)
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    a = np.zeros((len(docs), len(terms)))
    for d, t, x in rows:
        a[docs.index(d), terms.index(t)] += x
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    monkeypatch.setattr(R, "BROADCAST_VALUES", 600)  # 15 of 40 columns
    monkeypatch.setattr(R, "_to_block", lambda *args: pytest.fail("a dense block on the driver"))
    monkeypatch.setattr(R, "block_svd", lambda *args: pytest.fail("rows of terms sent to blocks of documents"))
    for name, n in (("CHUNK_ENTRIES", 50), ("CELL_ENTRIES", 60), ("RANGE_DOCS", 16)):
        monkeypatch.setattr(ST, name, n)
    w = w.repartition(3) if spread_rows else w.orderBy("doc_id")
    model, scores = R.truncated_svd(w, k=4, n_oversamples=36, n_iter=1)
    assert np.allclose(model.singular_values, s[:4], rtol=1e-6)
    got, loads = {r.doc_id: r.reduced for r in scores.collect()}, {r.term: r.comp for r in model.loadings.collect()}
    assert set(got) == set(docs) and set(loads) == set(terms)
    v = np.array([loads[t] for t in terms])
    assert np.allclose(np.abs(v), np.abs(vt[:4].T), atol=1e-5)
    assert all(v[np.abs(np.round(v[:, j], 12)).argmax(), j] > 0 for j in range(4))
    assert np.allclose(np.array([got[d] for d in docs]), a @ v, atol=1e-5)
