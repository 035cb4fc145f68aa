"""Single linkage, exact at any number of rows (C2): a minimum spanning forest, cut afterwards.

Rows of equal vectors are one class.  Blocks of classes meet in pairs, once: the task of a pair of blocks makes the minimum
spanning forest of the distances it holds, by Boruvka rounds in memory, and gives back its edges, fewer than it has classes.
An edge of the whole forest is one in the task that holds it, so the rest is done over these edges only: the least edge of
each component joins the forest, and what it ties together becomes one component, so that their number halves at least.
The work is that of a full comparison, log2(classes) times at most, but no vector is sent more than once for each block.

A matrix product, a strip of rows at a time, finds the edges that can be least; only those are measured again, difference by
difference, so that a distance depends on its two vectors alone.  Edges are ordered by (distance, smaller class, larger class),
which has no ties.  Vectors stay in the tasks; the driver sees counts and one edge, the one at which the forest is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators.hot_join import hot_join
from tessera.operators.similarity import _blocks, _side
from tessera.session import reliable_checkpoint
from tessera.sources.keys import add_row_number

METRICS = ("cosine", "euclidean", "l2", "manhattan", "l1")
#: Distances of a strip of rows.
STRIP_VALUES = 1 << 20


def _rough(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all pairs; squared ones for the euclidean metric."""
    if metric == "cosine":
        return 1.0 - x @ y.T
    if metric in ("manhattan", "l1"):
        return np.stack([np.abs(y - row).sum(1) for row in x])
    a, b = (x * x).sum(1), (y * y).sum(1)
    return a[:, None] + b[None, :] - 2 * x @ y.T


def _slack(x: np.ndarray, y: np.ndarray, metric: str) -> float:
    """How far rough distances may be off."""
    if metric == "cosine":
        return 1e-12 * max(x.shape[1], 1)
    if metric in ("manhattan", "l1"):
        return 0.0
    return 1e-13 * max(x.shape[1], 1) * ((x * x).sum(1).max() + (y * y).sum(1).max())


def _exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of ``x`` and row i of ``y``, the same whichever comes first."""
    if metric == "cosine":
        return np.maximum(1.0 - (x * y).sum(1), 0.0)
    if metric in ("manhattan", "l1"):
        return np.abs(x - y).sum(1)
    return np.sqrt(((x - y) ** 2).sum(1))


def _least(comp, other, dist, a, b) -> pd.DataFrame:
    """The first edge of each component."""
    order = np.lexsort((b, a, dist, comp))
    comp = comp[order]
    first = np.ones(len(comp), bool)
    first[1:] = comp[1:] != comp[:-1]
    at = order[first]
    return pd.DataFrame({"comp": comp[first], "other": other[at], "distance": dist[at], "a": a[at], "b": b[at]})


def _outgoing(x, y, li, ri, lc, rc, comps: int, metric: str, below: float, slack: float) -> pd.DataFrame:
    """The least edge of each component (``lc``, ``rc``: numbers under ``comps``) to another one."""
    near = np.full(comps, np.inf)
    limit = (below * abs(below) if metric in ("euclidean", "l2") else below) + 2 * slack
    limit = np.inf if np.isinf(below) else limit * (1 + 1e-12)
    step = max(1, STRIP_VALUES // len(y))
    none = np.zeros(0, np.int64)
    kept = [_least(none, none, np.zeros(0), none, none)]
    for top in range(0, len(x), step):
        own = slice(top, top + step)
        rough = _rough(x[own], y, metric)
        rough[lc[own][:, None] == rc[None, :]] = np.inf
        np.minimum.at(near, lc[own], rough.min(1))
        np.minimum.at(near, rc, rough.min(0))
        may = np.minimum(near + 2 * slack, limit)
        i, j = np.nonzero(((rough <= may[lc[own]][:, None]) | (rough <= may[rc][None, :])) & np.isfinite(rough))
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + top, j[at : at + (1 << 16)]
            dist = _exact(x[p], y[q], metric)
            ok = dist < below
            p, q, dist = p[ok], q[ok], dist[ok]
            a, b = np.minimum(li[p], ri[q]), np.maximum(li[p], ri[q])
            kept.append(_least(np.concatenate([lc[p], rc[q]]), np.concatenate([rc[q], lc[p]]), np.tile(dist, 2), np.tile(a, 2), np.tile(b, 2)))
        if sum(map(len, kept)) > 4 * comps:
            kept = [_first(kept)]
    return _first(kept)


def _first(kept: list[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(kept)
    return _least(*(rows[c].to_numpy() for c in ("comp", "other", "distance", "a", "b")))


def _block_forest(metric: str, below: float):
    """Edges of the minimum spanning forest of the pairs of two blocks (or of one, with itself) that are nearer than ``below``."""

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            (li, x), (ri, y) = _side(left, "lid", "lv"), _side(right, "rid", "rv")
            li, ri = li.to_numpy(), ri.to_numpy()
            ids, node = np.unique(np.concatenate([li, ri]), return_inverse=True)
            label, slack = np.arange(len(ids)), _slack(x, y, metric)
            l, r = np.arange(len(li)), np.arange(len(ri))
            while len(l) and len(r):
                lc, rc = label[node[l]], label[node[len(li) + r]]
                best = _outgoing(x[l], y[r], li[l], ri[r], lc, rc, len(ids), metric, below, slack)
                if best.empty:
                    break
                for rows, c in zip(found, ("a", "b", "distance")):
                    rows.append(best[c].to_numpy())
                comp, every = best["comp"].to_numpy(), np.arange(len(ids))
                up = every.copy()
                up[comp] = best["other"].to_numpy()
                up = np.where((up[up] == every) & (every < up), every, up)  # the smaller of two that chose each other
                while (up != up[up]).any():
                    up = up[up]
                label = up[label]
                going = np.zeros(len(ids), bool)  # a component without such an edge never gets one
                going[comp] = True
                l, r = l[going[lc]], r[going[rc]]
        a, b, d = (np.concatenate(x) for x in found)
        one = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[one], "b": b[one], "distance": d[one]})

    return fn


def _up(found: DataFrame) -> DataFrame:
    """Pointers of pointers.  A root may hold most rows: they are the left side, which AQE splits."""
    up = found.select(F.col("comp").alias("root"), F.col("root").alias("_up"))
    return found.join(up, "root", "left").select("comp", F.coalesce("_up", "root").alias("root"))


def _contract(choice: DataFrame) -> DataFrame:
    """(comp, root) of ``choice`` (comp, other): pointers followed to the end; the smaller of two that chose each other is the
    root."""
    back = choice.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
    root = F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    found = reliable_checkpoint(choice.join(back, "other", "left").select("comp", root.alias("root")))
    while True:
        step = _up(_up(found)).withColumnRenamed("root", "_new")
        step = reliable_checkpoint(found.join(step, "comp").select("comp", F.col("_new").alias("root"), (F.col("_new") != F.col("root")).alias("_moved")))
        found = step.select("comp", "root")
        if step.where("_moved").isEmpty():
            return found


def spanning_forest(points: DataFrame, metric: str = "euclidean", below: float | None = None, block_rows: int = 2_048) -> tuple[DataFrame, DataFrame]:
    """Edges (``a``, ``b``, ``distance``, a < b) of the minimum spanning forest of ``points`` (``id`` long, unique; ``v``, unit
    vectors for cosine) over the pairs nearer than ``below``: one tree, n - 1 edges, without it.  And the trees: (``id``,
    ``comp``)."""
    if metric not in METRICS:
        raise ValueError(f"single linkage needs one of {METRICS}")
    points = reliable_checkpoint(points.select("id", "v"))
    blocks = _blocks(points, "v", block_rows)
    blk = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = points.select(F.col("id").alias("lid"), F.col("v").alias("lv"), blk.alias("bl")).withColumn("br", F.explode(F.sequence(F.col("bl"), F.lit(blocks - 1))))
    right = points.select(F.col("id").alias("rid"), F.col("v").alias("rv"), blk.alias("br")).withColumn("bl", F.explode(F.sequence(F.lit(0), F.col("br"))))
    near = left.groupBy("bl", "br").cogroup(right.groupBy("bl", "br")).applyInArrow(
        _block_forest(metric, np.inf if below is None else float(below)), "a long, b long, distance double")
    return _contracted(points.select("id"), near)


def _relabelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    joined = hot_join(nodes, roots, "comp", ["id"], "left")
    return joined.withColumn("comp", F.coalesce("root", "comp")).drop("root")


def _contracted(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of the minimum spanning forest of ``edges`` (``a``, ``b``, ``distance``), and the trees (``id``, ``comp``) of
    ``ids``: rounds in which the least edge of each component joins the forest, over the edges only."""
    nodes = reliable_checkpoint(ids.select("id", F.col("id").alias("comp")))
    edges = reliable_checkpoint(edges.select("a", "b", "distance", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = ids.sparkSession.createDataFrame([], "a long, b long, distance double")
    while not edges.isEmpty():
        ways = edges.select(F.col("ca").alias("comp"), F.col("cb").alias("other"), "distance", "a", "b").unionByName(
            edges.select(F.col("cb").alias("comp"), F.col("ca").alias("other"), "distance", "a", "b"))
        best = reliable_checkpoint(ways.groupBy("comp").agg(F.min(F.struct("distance", "a", "b", "other")).alias("e")).select("comp", "e.*"))
        forest = forest.unionByName(best.select("a", "b", "distance").distinct())  # at most log2(n) tables
        roots = reliable_checkpoint(_contract(best.select("comp", "other")))
        for end in ("ca", "cb"):
            named = roots.select(F.col("comp").alias(end), "root")
            edges = hot_join(edges, named, end, ["a", "b"], "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = reliable_checkpoint(edges.where("ca <> cb"))
        nodes = reliable_checkpoint(_relabelled(nodes, roots))
    return reliable_checkpoint(forest), nodes


def forest_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(``id``, ``comp``) of the trees that ``edges`` (``a``, ``b``, ``distance``; without cycles) make of ``ids``, by the same
    contraction, over the edges only."""
    return _contracted(ids, edges)[1]


def single_linkage(df: DataFrame, vec_col: str, k: int = 4, metric: str = "euclidean", id_col: str = "id", name: str = "cluster",
                   distance_threshold: float | None = None, block_rows: int = 2_048) -> DataFrame:
    """C2 with single linkage: labels for every row of ``df`` (null where the vector is null or holds a null): ``k`` clusters or,
    with a ``distance_threshold``, those left when no two are nearer than it.

    Equal vectors (with cosine: equal unit vectors, zero vectors among them) are at distance 0.  Among equal distances the
    pair of smaller row numbers is merged first, rows being numbered by (id, vector).  Ids may repeat, be null, or be of any
    type; an empty table stays empty.  Labels: clusters by size, then by smallest id, a null id last."""
    df = add_row_number(df.drop(name).withColumn("_vec", V.clean(vec_col)), [id_col, "_vec"], "_row", start=0)
    vec = V.normalize("_vec") if metric == "cosine" else F.col("_vec")
    rows = reliable_checkpoint(df.where("_vec IS NOT NULL").select(F.col("_row").alias("id"), F.col(id_col).alias("key"), vec.alias("v")))
    classes = reliable_checkpoint(rows.groupBy("v").agg(F.min("id").alias("first")))
    rows = reliable_checkpoint(hot_join(rows, classes, "v", ["id"]).select("id", "key", "first"))
    points = classes.select(F.col("first").alias("id"), "v")
    if distance_threshold is not None:  # copies, at distance 0, are merged below any threshold over 0
        _, comps = spanning_forest(points, metric, distance_threshold, block_rows)
        alone = F.lit(distance_threshold <= 0)
    else:
        forest, comps = spanning_forest(points, metric, None, block_rows)
        zero = rows.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"))
        order = [F.col(c).desc() for c in ("distance", "a", "b")]
        cut = None
        if k > 1:
            cut = forest.unionByName(zero).orderBy(*order).limit(k - 1).agg(F.min(F.struct("distance", "a", "b")).alias("e")).first()["e"]
        alone = F.lit(False)
        if cut is not None:
            at = F.struct(F.lit(cut["distance"]).alias("distance"), F.lit(cut["a"]).alias("a"), F.lit(cut["b"]).alias("b"))
            comps = forest_components(points.select("id"), forest.where(F.struct("distance", "a", "b") < at))
            alone = F.struct(F.lit(0.0).alias("distance"), F.col("first").alias("a"), F.col("id").alias("b")) >= at
    rows = hot_join(rows, comps.select(F.col("id").alias("first"), "comp"), "first", ["id"])
    rows = reliable_checkpoint(rows.withColumn("comp", F.when((F.col("id") != F.col("first")) & alone, F.col("id")).otherwise(F.col("comp"))))
    sizes = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("key").isNull(), "key", "id")).alias("least"))
    labels = add_row_number(sizes, [F.col("n").desc(), "least"], name, start=0).select("comp", F.col(name).cast("int").alias(name))
    labelled = hot_join(rows, labels, "comp", ["id"]).select(F.col("id").alias("_row"), name)
    return df.join(labelled, "_row", "left").drop("_row", "_vec")
