"""One table of odd vectors through every operator on vectors: nulls, vectors that hold nulls, repeated and null ids,
string labels, zero vectors, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import agglomerative as A
from tessera.operators import cluster as C
from tessera.operators import reduce as R
from tessera.operators import scale as S
from tessera.operators.layout import tsne_layout
from tessera.operators.similarity import METRICS, cosine_join, topk_between, topk_neighbours

SCHEMA = "id string, v array<double>, cluster string, _labels int, score string"
ROWS = [
    ("a", [1.0, 0.0], "x", 1, "s"), ("b", [2.0, 0.1], "x", 1, "s"), ("c", None, "x", 1, "s"), ("d", [0.0, 1.0], "y", 1, "s"),
    ("e", [0.1, 2.0], "y", 1, "s"), ("f", [1.0, None], "y", 1, "s"), ("a", [1.0, 0.0], "x", 1, "s"), ("g", [0.0, 0.0], None, 1, "s"),
    (None, [3.0, 0.0], "x", 1, "s"), ("h", [0.2, 1.0], "y", 1, "s"),
]
GOOD = [r for r in ROWS if r[1] is not None and None not in r[1]]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_scaling(odd, none):
    m = np.array([r[1] for r in GOOD])
    for scaled, want in ((S.min_max_scale(odd, "v"), (m - m.min(0)) / (m.max(0) - m.min(0))), (S.standard_scale(odd, "v"), (m - m.mean(0)) / m.std(0))):
        rows = scaled.collect()
        assert len(rows) == len(ROWS)
        assert sum(r.scaled is None for r in rows) == len(ROWS) - len(GOOD)
        assert np.allclose(sorted(r.scaled for r in rows if r.scaled is not None), sorted(want.tolist()))
    assert S.min_max_scale(none, "v").count() == 0 and S.standard_scale(none, "v").count() == 0


def test_scores_with_string_labels(odd, none):
    m, labels = np.array([r[1] for r in GOOD if r[2]]), np.array([r[2] for r in GOOD if r[2]])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    far = 1 - unit @ unit.T
    each = []
    for i, c in enumerate(labels):
        own = (labels == c) & (np.arange(len(labels)) != i)
        a, b = far[i, own].mean(), far[i, labels != c].mean()
        each.append((b - a) / max(a, b))
    assert C.silhouette(odd, "v", "cluster").first()[0] == pytest.approx(np.mean(each))
    centre = {c: m[labels == c].mean(0) for c in set(labels)}
    within = sum(((x - centre[c]) ** 2).sum() for x, c in zip(m, labels))
    between = sum((labels == c).sum() * ((centre[c] - m.mean(0)) ** 2).sum() for c in centre)
    assert C.calinski_harabasz(odd, "v", "cluster").first()[0] == pytest.approx(between / (within / (len(m) - 2)))
    spread = {c: np.mean(np.linalg.norm(m[labels == c] - centre[c], axis=1)) for c in centre}
    assert C.davies_bouldin(odd, "v", "cluster").first()[0] == pytest.approx(sum(spread.values()) / np.linalg.norm(centre["x"] - centre["y"]))
    for score in (C.silhouette, C.calinski_harabasz, C.davies_bouldin):
        rows = score(none, "v", "cluster").collect()
        assert len(rows) == 1 and rows[0][0] is None


def test_kmeans(odd, none):
    labelled, centres = C.kmeans(odd, "v", k=2, n_init=2, id_col="id")
    rows = labelled.collect()
    assert len(rows) == len(ROWS) and len(centres) == 2
    assert all((r.cluster is None) == (r.v is None or None in r.v) for r in rows)
    assert len({r.cluster for r in rows if r.id in ("d", "e", "h")}) == 1
    labelled, centres = C.kmeans(none, "v", k=2, id_col="id")
    assert labelled.count() == 0 and centres == []


def test_agglomerative_keeps_repeated_ids(odd, none):
    rows = A.agglomerative(odd.drop("cluster"), "v", k=2, linkage="complete", metric="manhattan").collect()
    assert len(rows) == len(ROWS)
    assert all((r.cluster is None) == (r.v is None or None in r.v) for r in rows)
    assert len({r.cluster for r in rows if r.id == "a"}) == 1
    assert len({r.cluster for r in rows if r.id in ("d", "e", "h")}) == 1
    assert A.agglomerative(none.drop("cluster"), "v").count() == 0


def test_neighbours(odd, none):
    good = [r for r in GOOD if r[0]]
    for metric in METRICS:
        got = topk_neighbours(odd, "id", "v", 2, metric).collect()
        assert {r.id1 for r in got} == {r[0] for r in good} and all(r.id1 != r.id2 and math.isfinite(r[2]) for r in got)
        assert topk_neighbours(none, "id", "v", 2, metric).count() == 0
    assert cosine_join(none, "id", "v", 0.5).count() == 0
    assert all(r.id1 in "abdegh" and r.id2 in "abdegh" for r in cosine_join(odd, "id", "v", 0.5).collect())


def test_neighbours_in_another_table(spark, odd, none):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0]), (4, None)], "n long, w array<double>")
    got = {}
    for r in topk_between(odd, "id", "v", base, "n", "w", k=2, metric="euclidean", block_rows=2).collect():
        got.setdefault(r.id1, {})[r["rank"]] = (r.id2, round(r.distance, 9))
    assert set(got) == {"a", "b", "d", "e", "g", "h"}
    assert got["a"][1] == (1, 0.0) and got["d"][1] == (2, 0.0) and got["g"] == {1: (1, 1.0), 2: (2, 1.0)}
    assert topk_between(none, "id", "v", base, "n", "w").count() == 0
    assert topk_between(odd, "id", "v", base.limit(0), "n", "w").count() == 0


def test_pca(odd, none):
    model = R.pca(odd, "v", 2)
    m = np.array([r[1] for r in GOOD])
    assert np.allclose(model.mean, m.mean(0))
    rows = model.transform(odd, "v").collect()
    assert sum(r.reduced is None for r in rows) == len(ROWS) - len(GOOD)
    with pytest.raises(ValueError, match="no vector"):
        R.pca(none, "v", 2)


def test_layout(odd, none):
    rows = tsne_layout(odd.where("id is not null").dropDuplicates(["id"]), "id", "v", perplexity=2, n_iter=30).collect()
    assert {r.id for r in rows} == set("abdegh") and all(math.isfinite(r.x_embed) and math.isfinite(r.y_embed) for r in rows)
    assert tsne_layout(none, "id", "v").count() == 0


def test_layout_of_new_rows(spark):
    from tessera.operators.layout import layout_transform

    rng = np.random.default_rng(3)
    rows = [(f"r{i}", [float(x) for x in rng.normal(size=3)], float(i), float(-i)) for i in range(40)]
    fitted = spark.createDataFrame([*rows, ("n", None, 0.0, 0.0)], "id string, v array<double>, x_embed double, y_embed double")
    own = layout_transform(fitted.select("id", "v"), "id", "v", fitted, k=5)
    at = {r.id: (r.x_embed, r.y_embed) for r in own.collect()}
    assert all(at[i] == pytest.approx((x, y)) for i, _, x, y in rows)  # fitted rows land on themselves
    assert at["n"] == (None, None)
    new = [("p", [float(x) for x in rng.normal(size=3)])]
    got = layout_transform(spark.createDataFrame(new, "id string, v array<double>"), "id", "v", fitted, k=3).first()
    d = sorted((float(np.linalg.norm(np.array(v) - new[0][1])), x, y) for _, v, x, y in rows)[:3]
    w = [1 / x for x, _, _ in d]
    assert got.x_embed == pytest.approx(sum(a * x for a, (_, x, _) in zip(w, d)) / sum(w))
    assert got.y_embed == pytest.approx(sum(a * y for a, (_, _, y) in zip(w, d)) / sum(w))
    assert F.col  # the frame's columns are those of the ids and the layout
    assert own.columns == ["id", "x_embed", "y_embed"]
