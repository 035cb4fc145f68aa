"""t-SNE layout invariants: neighbourhoods of well-separated groups survive."""

import numpy as np

from tessera.operators.layout import _forces, _grid, pack_edges, tsne_layout


def test_tsne_separates_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(6)[:3] * 10
    x = np.vstack([rng.normal(loc=c, scale=0.5, size=(40, 6)) for c in centres])
    lab = np.repeat(np.arange(3), 40)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    out = tsne_layout(df, "id", "v", perplexity=10, n_iter=120, exaggeration_iter=60).toPandas().sort_values("id")
    y = out[["x_embed", "y_embed"]].to_numpy()
    assert np.isfinite(y).all()
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    nn = d.argmin(1)
    assert (lab[nn] == lab).mean() > 0.85
    same = lab[:, None] == lab[None, :]
    np.fill_diagonal(same, False)
    dist = np.sqrt(np.where(np.isfinite(d), d, 0))
    assert dist[same].mean() < dist[~same & ~np.eye(len(y), dtype=bool)].mean()


def test_svd_then_tsne_chain(spark):
    from tests.conftest import SF001
    from tessera.plans import cluster_texts as CT

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    cfg = CT.TextClusterConfig(reduction="svd__tsne", step_one_dims=10, tsne_perplexity=10, tsne_iterations=40,
                               algorithm="kmeans", n_init=2, svd_iterations=2)
    frame, scores, model = CT.cluster_texts(docs, config=cfg)
    pdf = frame.toPandas()
    assert len(pdf) == docs.count()
    assert pdf[["x_embed", "y_embed"]].notna().all().all()
    assert model.space == "after_step1"
    assert scores.count() == 1


def test_forces_of_packed_edges_follow_the_definition(spark):
    rng = np.random.default_rng(5)
    n = 97
    p = np.where(rng.random((n, n)) < 0.2, rng.random((n, n)), 0.0)
    np.fill_diagonal(p, 0.0)
    p[:, 3] = p[3] = 0.0  # a point without edges gets no force
    i, j = np.nonzero(p)
    edges = spark.createDataFrame([(int(a), int(b), float(p[a, b])) for a, b in zip(i, j)], "i long, j long, p double")
    packed = pack_edges(edges, 10)
    assert packed.count() == 10  # a row for each run of points, not for each edge
    y = rng.normal(size=(n, 2))
    attr, rep, z = _forces(packed, y, 8)
    diff = y[:, None] - y[None]
    want = ((p / (1 + (diff**2).sum(-1)))[:, :, None] * diff).sum(1)
    assert np.allclose(attr, want, atol=1e-12)
    cnt, cen = _grid(y, 8)
    away = y[:, None] - cen[None]
    q = 1 / (1 + (away**2).sum(-1))
    q[3] = 0.0
    assert np.allclose(rep, ((cnt * q * q)[:, :, None] * away).sum(1), atol=1e-12)
    assert np.isclose(z, (cnt * q).sum() - (n - 1))
