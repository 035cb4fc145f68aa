"""The clustering chain: settings that are refused, rows that stay, both steps."""

import pytest

from tests.conftest import SF001
from tessera.operators import reduce as R
from tessera.operators import tfidf
from tessera.plans import cluster_texts as CT


def _docs(spark, n=60):
    texts = [["red apple pie", "green apple tart", "fast red car", "blue car race", "tall green tree"][i % 5] + f" word{i % 7}" for i in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "!")], "doc_id long, text string")


def test_every_document_is_labelled(spark):
    cfg = CT.TextClusterConfig(algorithm="kmeans", n_init=1, n_clusters=3, step_one_dims=4)
    frame, scores, model = CT.cluster_texts(_docs(spark), config=cfg)
    rows = frame.collect()
    assert len(rows) == 63 and all(r["cluster"] is not None for r in rows)
    assert scores.count() == 1
    again = {r["doc_id"]: r["cluster"] for r in CT.assign_texts(_docs(spark), model).collect()}
    assert all(again[r["doc_id"]] == r["cluster"] for r in rows if r["doc_id"] < 60)


@pytest.mark.parametrize("reduction", ["umapp", "svdd", "umap__linear", "", "tsne__svd"])
def test_unknown_reductions_are_refused(spark, reduction):
    with pytest.raises(ValueError, match="reduction"):
        CT.cluster_texts(_docs(spark, 5), config=CT.TextClusterConfig(reduction=reduction))


def test_pca_of_sparse_texts_and_unknown_spaces_are_refused(spark):
    with pytest.raises(ValueError, match="pca"):
        CT.cluster_texts(_docs(spark, 5), config=CT.TextClusterConfig(reduction="pca"))
    with pytest.raises(ValueError, match="cluster_space"):
        CT.cluster_texts(_docs(spark, 20), config=CT.TextClusterConfig(cluster_space="somewhere", step_one_dims=3))


@pytest.mark.parametrize("reduction,scaling", [("svd", None), ("pca", "min_max"), ("linear", "standard_scaler")])
def test_dense_vectors(spark, reduction, scaling):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    cfg = CT.TextClusterConfig(embedding="vectors", reduction=reduction, scale_before_reduction=scaling, algorithm="kmeans", n_init=1, step_one_dims=3)
    frame, _, model = CT.cluster_texts(emb, "vec_id", None, cfg, vec_col="embedding")
    assert frame.count() == emb.count()
    assert (model.svd_model is not None) == (reduction == "svd") and (model.pca_model is not None) == (reduction != "svd")


def test_svd_is_the_same_local_and_distributed(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    _, w = tfidf.tfidf_fit_transform(docs)
    got = []
    for values, parts in ((R.BROADCAST_VALUES, 3), (0, 5)):
        monkeypatch.setattr(R, "BROADCAST_VALUES", values)
        _, scores = R.truncated_svd(w.repartition(parts), k=3, n_iter=3)
        got.append({r["doc_id"]: r["reduced"] for r in scores.collect()})
    assert set(got[0]) == set(got[1])
    assert all(got[0][d] == pytest.approx(got[1][d], abs=1e-7) for d in got[0])


def test_clustering_before_reduction_on_tfidf(spark):
    cfg = CT.TextClusterConfig(algorithm="kmeans", cluster_space="before", n_init=2, n_clusters=3, step_one_dims=3, svd_iterations=1)
    docs = _docs(spark, 30)
    frame, scores, model = CT.cluster_texts(docs, config=cfg)
    rows = {r["doc_id"]: r["cluster"] for r in frame.collect()}
    assert len(rows) == 33 and None not in rows.values()
    assert {r["doc_id"]: r["cluster"] for r in CT.assign_texts(docs, model).collect()} == rows
    assert scores.first()["silhouette"] is not None
    for bad in (dict(algorithm="agglomerative"), dict(scale_before_cluster="min_max")):
        with pytest.raises(ValueError, match="before reduction"):
            CT.cluster_texts(docs, config=CT.TextClusterConfig(**{**dict(algorithm="kmeans"), **bad, "cluster_space": "before"}))
