"""Agglomerative clustering at scale.

Two phases (as in BIRCH), the same at every number of rows:

1. compress the rows into at most ``micro`` micro-clusters: the rows of the ``micro`` smallest hashes are the first
   centres, and ``rounds`` Lloyd rounds over all rows follow, each one Spark aggregate (``lloyd.py``); sizes and vector sums are kept
   (m x d values).  ``micro`` is the caller's: where it is no less than the number of rows, every row is a first centre
   and stays alone, so the result is that of the exact algorithm;
2. merge the bounded summaries on the driver with exact linkage updates,
   then broadcast the micro -> cluster map back to the rows.

Linkages from summaries alone:

* ``average`` + ``cosine``: the mean cosine distance between groups A and B
  is ``1 - S_A . S_B / (|A| |B|)`` with S the sum of unit vectors -- exact;
* ``ward`` + ``euclidean``: merge cost ``|A||B|/(|A|+|B|) |mu_A - mu_B|^2`` -- exact;
* ``average`` / ``complete`` with euclidean or manhattan, and
  ``complete`` with cosine: Lance-Williams updates on micro-cluster
  centroid distances -- exact when every row is its own micro-cluster,
  approximate with fewer micro-clusters than rows.

``single`` linkage takes neither phase: ``tessera.operators.single_linkage`` is exact at any number of rows.

Labels are canonical: clusters ordered by size (descending), then smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators.lloyd import evenly, matrix, nearest, pack, sums_by_centre
from tessera.operators.single_linkage import single_linkage
from tessera.session import reliable_checkpoint

MAX_MICRO = 5_000


def _pairwise(c: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("euclidean", "l2"):
        sq = (c * c).sum(1)
        return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * c @ c.T, 0.0))
    if metric in ("manhattan", "l1"):
        return np.stack([np.abs(c - x).sum(1) for x in c])  # row by row: never m x m x d
    if metric == "cosine":
        nrm = np.linalg.norm(c, axis=1)
        u = np.divide(c, nrm[:, None], out=np.zeros_like(c), where=nrm[:, None] > 0)
        return 1.0 - u @ u.T
    raise ValueError(f"unknown metric {metric!r}")


def merge_summaries(sizes: np.ndarray, sums: np.ndarray, k: int, linkage: str, metric: str,
                    distance_threshold: float | None = None) -> np.ndarray:
    """Exact agglomeration of m weighted summaries down to k groups, or until
    the smallest linkage distance is ``distance_threshold`` or more (ward:
    the square root of twice the merge cost, as the reference's library has
    it); returns the group index of each summary."""
    m = len(sizes)
    n = sizes.astype(np.float64).copy()
    s = sums.astype(np.float64).copy()
    alive = np.ones(m, bool)
    group = np.arange(m)
    if linkage == "ward":
        if metric not in ("euclidean", "l2"):
            raise ValueError("ward linkage needs the euclidean metric")
        mu = s / n[:, None]
        sq = (mu * mu).sum(1)
        d = (n[:, None] * n[None, :] / (n[:, None] + n[None, :])) * np.maximum(
            sq[:, None] + sq[None, :] - 2 * mu @ mu.T, 0.0)
    elif linkage == "average" and metric == "cosine":
        d = 1.0 - (s @ s.T) / (n[:, None] * n[None, :])  # s holds sums of unit vectors
    else:
        d = _pairwise(s / n[:, None], metric)
    np.fill_diagonal(d, np.inf)
    for _ in range(m - k):
        flat = int(np.argmin(d))
        i, j = divmod(flat, m)
        if distance_threshold is not None:
            least = np.sqrt(2.0 * d[i, j]) if linkage == "ward" else d[i, j]
            if least >= distance_threshold:
                break
        if i > j:
            i, j = j, i
        ni, nj = n[i], n[j]
        # merge j into i
        if linkage == "ward":
            s[i] += s[j]
            n[i] = ni + nj
            mu_i = s[i] / n[i]
            others = s / n[:, None]
            new = (n[i] * n / (n[i] + n)) * ((others - mu_i) ** 2).sum(1)
        elif linkage == "average" and metric == "cosine":
            s[i] += s[j]
            n[i] = ni + nj
            new = 1.0 - (s @ s[i]) / (n * n[i])
        elif linkage == "average":
            new = (ni * d[i] + nj * d[j]) / (ni + nj)
            n[i] = ni + nj
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
            n[i] = ni + nj
        else:
            raise ValueError(f"unknown linkage {linkage!r}")
        alive[j] = False
        group[group == j] = i
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i, :] = new
        d[:, i] = new
        d[j, :] = np.inf
        d[:, j] = np.inf
    return group


def _labelled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(_id, _key, _m): ``rows`` (_id, _key, _own, _v) with the nearest centre."""
    bc = rows.sparkSession.sparkContext.broadcast(centres)

    def part(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = np.empty(len(batch), np.int32)
            for run, near, _ in nearest(matrix(batch.column(3)), bc.value, batch.column(2).to_numpy(zero_copy_only=False)):
                found[run] = near
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["_id", "_key", "_m"])

    key = rows.schema["_key"].dataType.simpleString()
    return rows.select("_id", "_key", "_own", "_v").mapInArrow(part, f"_id string, _key {key}, _m int")


def _compress(rows: DataFrame, micro: int, seed: int, rounds: int) -> tuple[DataFrame, list]:
    """Rows (_id, _key, _v) with their micro-cluster ``_m``, and (``_m``, size, smallest id, vector sum) of each, by ``_m``."""
    first = rows.orderBy(F.xxhash64(F.col("_key"), F.lit(seed)), "_key", "_id").limit(micro).collect()  # micro rows
    centres = np.array([r["_v"] for r in first], np.float64)
    owners = rows.sparkSession.createDataFrame([(r["_id"], i) for i, r in enumerate(first)], "_id string, _own int")
    rows = rows.join(F.broadcast(owners), "_id", "left").withColumn("_own", F.coalesce("_own", F.lit(-1)))
    rows = reliable_checkpoint(evenly(rows))
    packed = pack(rows, "_v", "_own")
    for i in range(rounds + 1):
        used = centres
        (size, total, _), = sums_by_centre(packed, [used], own=True)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], used)
        if np.array_equal(centres, used):  # a fixed point: further rounds give the same
            break
    labelled = reliable_checkpoint(_labelled(rows, used))
    least = labelled.groupBy("_m").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_id")).alias("_first")).collect()  # at most micro rows
    found = [{"_m": r["_m"], "_n": size[r["_m"]], "_first": r["_first"], "_s": total[r["_m"]]} for r in least]
    return labelled, sorted(found, key=lambda r: r["_m"])


def agglomerative(df: DataFrame, vec_col: str, k: int = 4, linkage: str = "average", metric: str = "cosine",
                  id_col: str = "id", micro: int = 2_000, seed: int = 7742, name: str = "cluster",
                  rounds: int = 10, distance_threshold: float | None = None) -> DataFrame:
    """Labels for every row of ``df`` (null where the vector is null or holds a null): ``k`` clusters or, with a
    ``distance_threshold``, those left when no two are nearer than it (``k`` isn't used then).

    ``micro``, ``rounds`` and ``seed`` have no part in single linkage.

    Rows are told apart by their place in a written copy, so ids may repeat or be null; an empty table stays empty."""
    if linkage == "single":
        return single_linkage(df, vec_col, k, metric, id_col, name, distance_threshold)
    if not 1 <= micro <= MAX_MICRO:
        raise ValueError(f"micro must be in 1..{MAX_MICRO}")
    vec = V.clean(vec_col)
    if linkage == "average" and metric == "cosine":
        vec = V.normalize(vec)
    df = reliable_checkpoint(df.drop(name))
    df = df.withColumn("_id", F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")))
    rows = df.select("_id", F.col(id_col).alias("_key"), vec.alias("_v")).where("_v IS NOT NULL")
    if rows.isEmpty():
        return df.drop("_id").withColumn(name, F.lit(None).cast("int"))
    micro_df, found = _compress(rows, micro, seed, rounds)
    m = len(found)
    mat = np.array([r["_s"] for r in found])
    size_arr = np.array([r["_n"] for r in found], np.float64)
    # a null id comes last
    first = [(r["_first"][0], 0 if r["_first"][1] is None else r["_first"][1], r["_first"][2]) for r in found]
    group = merge_summaries(size_arr, mat, min(k, m) if distance_threshold is None else 1, linkage, metric, distance_threshold)
    # canonical labels: group size desc, then smallest member id
    stats = {}
    for i, g in enumerate(group):
        cnt, mn = stats.get(g, (0, None))
        stats[g] = (cnt + size_arr[i], first[i] if mn is None else min(mn, first[i]))
    order = sorted(stats, key=lambda g: (-stats[g][0], stats[g][1]))
    label_of = {g: i for i, g in enumerate(order)}
    spark = df.sparkSession
    table = spark.createDataFrame([(r["_m"], int(label_of[group[i]])) for i, r in enumerate(found)], f"_m int, {name} int")
    labelled = micro_df.select("_id", "_m").join(F.broadcast(table), "_m").select("_id", name)
    return df.join(labelled, "_id", "left").drop("_id")
