"""C2 against a brute-force agglomeration on the full distance matrix."""

import numpy as np
import pytest

from tessera.operators.agglomerative import agglomerative


def _brute(x, k, linkage, metric):
    n = len(x)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1)[:, None]
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = [[i] for i in range(n)]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                pair = d[np.ix_(groups[a], groups[b])]
                v = {"average": pair.mean(), "complete": pair.max(), "single": pair.min()}[linkage]
                if best is None or v < best[0]:
                    best = (v, a, b)
        _, a, b = best
        groups[a] = groups[a] + groups[b]
        del groups[b]
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("linkage,metric", [("average", "cosine"), ("complete", "euclidean"),
                                            ("single", "euclidean"), ("average", "euclidean")])
def test_agglomerative_exact_small(spark, linkage, metric):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(loc=c, scale=0.3, size=(8, 3)) for c in ([3, 0, 0], [0, 3, 0], [0, 0, 3])])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = agglomerative(df, "v", 3, linkage, metric, id_col="id").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(sorted(g) for g in groups.values()) == _brute(x, 3, linkage, metric)
    sizes = [len(groups[c]) for c in sorted(groups)]
    assert sizes == sorted(sizes, reverse=True)


def test_one_path_for_any_number_of_rows(spark, monkeypatch):
    from tessera.operators import agglomerative as AG

    asked = []
    real = AG._compress
    monkeypatch.setattr(AG, "_compress", lambda rows, micro, *a: asked.append(micro) or real(rows, micro, *a))
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(loc=c, scale=0.1, size=(n, 3)) for c, n in zip(np.eye(3) * 4, (40, 30, 20))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    want = [0] * 40 + [1] * 30 + [2] * 20
    for micro in (12, 90, 91, 2_000):  # fewer summaries than rows, as many, and more
        got = agglomerative(df, "v", 3, "average", "cosine", micro=micro).orderBy("id").collect()
        assert [r["cluster"] for r in got] == want
    assert asked == [12, 90, 91, 2_000]


def test_equal_rows_stay_rows_of_their_own(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(5, [0.0, 0.0])], "id long, v array<double>")
    got = agglomerative(df, "v", 4, "complete", "euclidean").collect()
    assert len(got) == 6 and len({r["cluster"] for r in got}) == 4


def test_no_rows(spark):
    assert agglomerative(spark.createDataFrame([], "id long, v array<double>"), "v").count() == 0


@pytest.mark.parametrize("linkage,metric,threshold,want", [
    ("single", "euclidean", 1.5, [[0, 1, 2], [3, 4]]), ("complete", "euclidean", 1.5, [[0, 1], [2], [3, 4]]), ("average", "euclidean", 1.6, [[0, 1], [2], [3, 4]]), ("average", "euclidean", 1.8, [[0, 1, 2], [3, 4]]),
    ("ward", "euclidean", 1.9, [[0, 1], [2], [3, 4]]), ("ward", "euclidean", 2.0, [[0, 1, 2], [3, 4]]), ("single", "euclidean", 0.4, [[0], [1], [2], [3], [4]]),
    ("single", "euclidean", 100.0, [[0, 1, 2, 3, 4]]), ("average", "cosine", 0.001, [[0, 1, 2, 3, 4]]),
])
def test_distance_threshold(spark, linkage, metric, threshold, want):
    # on a line: 1, 2, 3.2, 9, 9.5; ward heights are 0.5, 1, 1.963 and more
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate([1.0, 2.0, 3.2, 9.0, 9.5])], "id long, v array<double>")
    groups = {}
    for r in agglomerative(df, "v", linkage=linkage, metric=metric, distance_threshold=threshold).collect():
        groups.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(sorted(g) for g in groups.values()) == want
