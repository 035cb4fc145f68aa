"""Single linkage against brute force, beyond the number of rows that the summaries of other linkages keep."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import single_linkage as module
from tessera.operators.agglomerative import agglomerative
from tessera.operators.single_linkage import single_linkage, spanning_forest


def _frame(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(8)


def _distances(x, metric):
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None]
        u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return np.maximum(1 - u @ u.T, 0)
    if metric in ("manhattan", "l1"):
        return np.abs(x[:, None] - x[None]).sum(-1)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def _tree(x, metric):
    """Prim's edges, one row of distances at a time."""
    n = len(x)
    best, seen, heights, at = np.full(n, np.inf), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        seen[at] = True
        d = _distances(np.vstack([x[at], x]), metric)[0, 1:] if metric == "cosine" else (np.abs(x - x[at]).sum(1) if metric in ("manhattan", "l1") else np.sqrt(((x - x[at]) ** 2).sum(1)))
        best = np.where(seen, np.inf, np.minimum(best, d))
        at = int(best.argmin())
        heights.append(best[at])
    return np.sort(heights)


def _groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster"], []).append(r["id"])
    return found


def _components(d, below):
    left, found = set(range(len(d))), []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [j for j in np.nonzero(d[i] < below)[0].tolist() if j not in seen]
        left -= seen
        found.append(sorted(seen))
    return sorted(found)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_forest_is_minimal(spark, metric):
    x = np.random.default_rng(3).normal(size=(300, 4))
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1)[:, None]
    edges = spanning_forest(_frame(spark, x), metric, block_rows=64)[0].collect()
    assert len(edges) == 299
    d = _distances(x, metric)
    assert all(r["a"] < r["b"] and d[r["a"], r["b"]] == pytest.approx(r["distance"], abs=1e-12) for r in edges)
    from_brute, seen, best, at = [], {0}, d[0].copy(), 0
    for _ in range(299):
        at = min((j for j in range(300) if j not in seen), key=lambda j: best[j])
        from_brute.append(best[at])
        seen.add(at)
        best = np.minimum(best, d[at])
    assert np.allclose(sorted(r["distance"] for r in edges), sorted(from_brute))


def test_beyond_5000_rows(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(loc=c, scale=0.2, size=(n, 2)) for c, n in (((0, 0), 3000), ((9, 0), 1800), ((0, 9), 700), ((30, 30), 1))])
    got = _groups(single_linkage(_frame(spark, x), "v", 4).collect())
    assert [len(got[c]) for c in range(4)] == [3000, 1800, 700, 1]
    assert sorted(got[2]) == list(range(4800, 5500)) and got[3] == [5500]
    heights = _tree(x, "euclidean")
    below = (heights[-12] + heights[-11]) / 2  # 11 edges are longer: 12 clusters
    assert len(_groups(single_linkage(_frame(spark, x), "v", distance_threshold=float(below)).collect())) == 12


@pytest.mark.parametrize("metric,below", [("euclidean", 1.0), ("cosine", 0.02)])
def test_thresholds_give_the_components_of_near_pairs(spark, metric, below):
    x = np.random.default_rng(8).normal(size=(150, 3))
    got = single_linkage(_frame(spark, x), "v", metric=metric, distance_threshold=below, block_rows=40).collect()
    assert sorted(sorted(g) for g in _groups(got).values()) == _components(_distances(x, metric), below)


def test_ties_on_a_grid(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)] + [[100, 100], [100, 101]], float)
    edges = spanning_forest(_frame(spark, x), block_rows=30)[0].collect()
    assert len(edges) == 145 and sorted(r["distance"] for r in edges)[-2] == 1.0
    got = _groups(single_linkage(_frame(spark, x), "v", 2).collect())
    assert [len(got[c]) for c in (0, 1)] == [144, 2]


def test_copies(spark):
    x = np.array([[1.0, 1.0]] * 40 + [[5.0, 5.0]] * 3 + [[9.0, 1.0]])
    got = _groups(single_linkage(_frame(spark, x), "v", 3).collect())
    assert [len(got[c]) for c in range(3)] == [40, 3, 1]
    more = _groups(single_linkage(_frame(spark, x), "v", 6).collect())  # more clusters than different vectors
    assert len(more) == 6 and sum(map(len, more.values())) == 44
    assert len(_groups(single_linkage(_frame(spark, x), "v", distance_threshold=0.0).collect())) == 44


def test_odd_rows(spark):
    rows = [("a", [1.0, 0.0], 1), ("a", [1.0, 0.1], 2), (None, [0.0, 3.0], 3), ("b", None, 4), ("c", [None, 1.0], 5), ("d", [0.0, 0.0], 6)]
    df = spark.createDataFrame(rows, "id string, v array<double>, comp int").withColumnRenamed("comp", "first")
    got = {r["first"]: r["cluster"] for r in agglomerative(df, "v", 3, "single", "cosine").collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: None, 5: None, 6: 1}
    assert agglomerative(df.limit(0), "v", 3, "single").count() == 0
    with pytest.raises(ValueError, match="single"):
        single_linkage(df, "v", metric="hamming").count()


@pytest.mark.parametrize("metric,below", [("euclidean", np.inf), ("cosine", 0.05), ("manhattan", 0.8)])
def test_a_pair_of_blocks_gives_its_own_forest(monkeypatch, metric, below):
    """Vectors meet once: a task gives all edges that the forest can need, not those of one round."""
    monkeypatch.setattr(module, "STRIP_VALUES", 70)
    x = np.random.default_rng(2).normal(size=(40, 3))
    x = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    table = lambda rows, s: pa.table({f"{s}id": rows, f"{s}v": [x[i].tolist() for i in rows]})
    d = _distances(x, metric)
    for left, right in ((range(40), range(40)), (range(15), range(15, 40))):
        got = module._block_forest(metric, below)(table(list(left), "l"), table(list(right), "r")).to_pylist()
        tied, want = list(range(40)), []
        for h, a, b in sorted((d[a, b], min(a, b), max(a, b)) for a in left for b in right if a != b):
            if h < below and tied[a] != tied[b]:
                want.append((a, b))
                tied = [tied[a] if c == tied[b] else c for c in tied]
        assert sorted((e["a"], e["b"]) for e in got) == sorted(want) and want
