"""Fitted chains: each training row gets its own cluster again, before and after saving, for every kind of vector and space."""

import numpy as np
import pytest

from tests.test_cluster_texts import _docs
from tessera.operators import scale as S
from tessera.plans import cluster_texts as CT
from tessera.session import shared_dir


def _saved(spark, model):
    import uuid

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    CT.save_model(model, path)
    return CT.load_model(spark, path)


def _vectors(spark, zeros=2):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(loc=c, scale=0.3, size=(14, 4)) for c in ([3, 0, 0, 0], [0, 30, 0, 0], [0, 0, 3, 3])])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None)] + [(101 + i, [0.0] * 4) for i in range(zeros)]
    return spark.createDataFrame(rows, "vec_id long, emb array<double>")


@pytest.mark.parametrize("settings", [
    dict(reduction="pca", scale_before_reduction="min_max", scale_before_cluster="standard", cluster_space="after_step1"),
    dict(reduction="svd", scale_before_cluster="min_max", cluster_space="after_full"),
    dict(algorithm="agglomerative", linkage="single", affinity="l2", scale_before_cluster="standard"),
    dict(algorithm="agglomerative", cluster_space="after_step1"),
    dict(reduction="tsne", cluster_space="after_full", tsne_iterations=12, tsne_perplexity=5.0),
    dict(reduction="umap", cluster_space="after_full", umap_epochs=8, umap_neighbours=8),
    dict(reduction="pca__umap", umap_epochs=3, umap_metric="manhattan"),
])
def test_dense_vectors(spark, settings):
    config = CT.TextClusterConfig(**{**dict(embedding="vectors", algorithm="kmeans", n_init=2, n_clusters=3, step_one_dims=3, svd_iterations=2), **settings})
    rows = _vectors(spark, 0 if config.cluster_space == "after_full" and config.reduction in CT.LAYOUTS else 2)
    frame, _, model = CT.cluster_texts(rows, "vec_id", None, config, vec_col="emb")
    want = {r["doc_id"]: r["cluster"] for r in frame.collect()}
    again = _saved(spark, model)
    assert again.config == config
    assert {r["doc_id"]: r["cluster"] for r in CT.assign_texts(rows, again, "vec_id", None, "emb").collect()} == want
    assert CT.assign_texts(rows.limit(0), again, "vec_id", None, "emb").count() == 0


def test_texts_and_empty_texts(spark):
    config = CT.TextClusterConfig(algorithm="kmeans", n_init=1, n_clusters=3, step_one_dims=4, svd_iterations=2, scale_before_cluster="min_max")
    docs = _docs(spark)
    frame, _, model = CT.cluster_texts(docs, config=config)
    want = {r["doc_id"]: r["cluster"] for r in frame.collect()}
    assert {r["doc_id"]: r["cluster"] for r in CT.assign_texts(docs, _saved(spark, model)).collect()} == want
    with pytest.raises(ValueError, match="no texts"):
        CT.cluster_texts(docs.limit(0), config=config)


def test_word_vectors(spark):
    words = spark.createDataFrame([(w, [float(i % 3), float(i % 5), 1.0]) for i, w in enumerate("red green blue apple car tree pie tart fast race tall".split())], "word string, vector array<double>")
    docs = _docs(spark, 30)
    config = CT.TextClusterConfig(embedding="idf_word_vector", algorithm="kmeans", n_init=1, n_clusters=3, step_one_dims=2)
    frame, _, model = CT.cluster_texts(docs, config=config, word_vectors=words)
    again = _saved(spark, model)
    got = {r["doc_id"]: r["cluster"] for r in CT.assign_texts(docs.where("doc_id < 5"), again, word_vectors=words).collect()}
    assert got == {r["doc_id"]: r["cluster"] for r in frame.collect() if r["doc_id"] < 5}  # the idf is that of the fit
    with pytest.raises(ValueError, match="word vectors"):
        CT.assign_texts(docs, again)


def test_scaling_of_new_rows(spark):
    fit = spark.createDataFrame([([0.0, 5.0],), ([4.0, 5.0],), (None,)], "v array<double>")
    new = spark.createDataFrame([(0, [8.0, 7.0]), (1, [1.0, None]), (2, None)], "i int, v array<double>")
    for method, want in (("min_max", [2.0, 0.0]), ("standard", [3.0, 0.0])):
        got = {r["i"]: r["scaled"] for r in S.fit_scale(fit, "v", method).transform(new, "v").collect()}
        assert got == {0: want, 1: None, 2: None}
