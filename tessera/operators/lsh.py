"""Approximate nearest neighbours by random projections (M4 / D10, candidate option).

Several tables give every row a signature: the signs of random hyperplanes
(cosine), or the numbers of the slabs of random width that it lies in along
random directions (euclidean, manhattan).  In each table rows are put in the
order of their signatures, so rows of one bucket are neighbours, followed by
those of the nearest bucket that shares a beginning with it.  The order is cut into runs of
``run`` rows; a run is compared with itself and with the next one, all pairs
get their exact score, and every row keeps its ``k`` best.

The work is tables x n x 2 run comparisons whatever the data: a bucket with a
third of all rows is many runs, not one group.  Rows of equal vectors are one
row for the search, and are put back with their ids in order, so copies do
not fill the runs.  ``recall`` measures the result against exact neighbours of
a bounded number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators.similarity import METRICS, _scores
from tessera.session import reliable_checkpoint
from tessera.sources.keys import add_row_number

#: Tables, hash functions of a table, rows of a run.
TABLES, HASHES, RUN = 8, 16, 256
LSH_METRICS = ("cosine", "euclidean", "manhattan")


def _projections(width: int, tables: int, hashes: int, metric: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    draw = rng.standard_cauchy if metric == "manhattan" else rng.standard_normal
    return draw((width, tables * hashes))


def _signatures(rows: DataFrame, width: int, spread: list[float], metric: str, tables: int, hashes: int, seed: int) -> DataFrame:
    """(table, signature, id, v) of every row in every table.

    Hyperplanes pass through the origin (cosine); slabs have the width of a
    standard deviation of the projections, and start at a random offset."""
    planes = _projections(width, tables, hashes, metric, seed)
    offset = np.random.default_rng(seed + 1).random(tables * hashes)
    scale = np.sqrt(((planes * np.asarray(spread)[:, None]) ** 2).sum(0)) if metric != "manhattan" else (np.abs(planes) * np.asarray(spread)[:, None]).sum(0)
    scale = np.where(scale > 0, scale, 1.0)

    def sign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten()).reshape(b.num_rows, width)
            at = v @ planes
            cell = (at > 0).astype(np.uint8) if metric == "cosine" else np.clip(np.floor(at / scale + offset), -120, 120).astype(np.int16).view(np.uint16)
            if metric != "cosine":
                cell = (cell.astype(np.int32) + 128 & 0xFF).astype(np.uint8)
            cells = cell.reshape(b.num_rows, tables, hashes)
            for t in range(tables):
                keys = np.ascontiguousarray(cells[:, t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, t, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), b.column(0), b.column(1)],
                    ["tab", "sig", "id", "v"])

    return rows.select("id", "v").mapInArrow(sign, f"tab int, sig binary, id {dict(rows.dtypes)['id']}, v array<double>")


def _best(k: int, metric: str):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        first = pdf["own"].to_numpy()
        s = _scores(v, v, metric)
        s[np.arange(len(s)), np.arange(len(s))] = -np.inf
        s[np.ix_(~first, ~first)] = -np.inf  # the next run meets itself elsewhere
        kk = min(k, len(s) - 1)
        none = pd.DataFrame({"id": pdf["id"][:0], "nbr": pdf["id"][:0], "score": []})
        if kk < 1:
            return none
        near = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
        rows = np.repeat(np.arange(len(s)), kk)
        score = s[rows, near.reshape(-1)]
        keep = np.isfinite(score)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids[rows[keep]], "nbr": ids[near.reshape(-1)[keep]], "score": score[keep]})
    return fn


def _cleaned(vectors: DataFrame, id_col: str, vec_col: str, metric: str) -> tuple[DataFrame, int]:
    """Distinct usable vectors (id: the smallest of a vector's rows, v, ids of up
    to all its rows are in ``members``), and their width."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    if metric == "cosine":
        rows = rows.withColumn("v", V.normalize(F.col("v")))
    rows = reliable_checkpoint(rows)
    first = rows.select(F.size("v").alias("d")).first()
    return rows, first["d"] if first else 0


def approx_topk_neighbours(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, metric: str = "cosine",
                           tables: int = TABLES, hashes: int = HASHES, run: int = RUN, seed: int = 17) -> DataFrame:
    """M4 / D10 by candidates: ``id1, id2``, the exact score of each pair that
    was met, and ``rank``, in the form of ``topk_neighbours``.

    Rows of equal vectors are each other's nearest, by id; a class of copies
    passes its neighbours on to all its members.  Null vectors, vectors that hold
    nulls and null ids have and are no neighbours; ids are taken as unique; an
    empty table gives an empty result; other columns are not read.  More
    ``tables`` and longer runs raise recall; see ``recall``."""
    if metric not in LSH_METRICS:
        raise ValueError(f"metric must be one of {LSH_METRICS}")
    if k < 1 or run < 2 or tables < 1 or not 1 <= hashes <= 64:
        raise ValueError("k, tables, hashes (to 64) and run are too small or too large")
    kind = vectors.schema[id_col].dataType.simpleString()
    name = "cosine_similarity" if metric == "cosine" else "distance"
    rows, width = _cleaned(vectors, id_col, vec_col, metric)
    if not width:
        return rows.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias(name), F.lit(0).alias("rank")).limit(0)

    # copies: of a vector's rows only the k + 1 smallest ids can be a neighbour
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    heads = reliable_checkpoint(rows.groupBy("v").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    few = reliable_checkpoint(rows.withColumn("place", place).where(F.col("place") <= k + 1).join(heads, "v").select("head", "id", "n"))
    searched = heads.select(F.col("head").alias("id"), "v")

    stats = searched.select(Summarizer.metrics("variance").summary(array_to_vector("v")).alias("s")).select(vector_to_array("s.variance").alias("v")).first()
    spread = [x ** 0.5 for x in stats["v"]]
    signed = _signatures(searched, width, spread, metric, tables, hashes, seed)
    placed = add_row_number(signed, ["tab", "sig", "id"], "at", start=0)
    first = placed.groupBy("tab").agg(F.min("at").alias("first"))  # a row for each table
    placed = placed.join(F.broadcast(first), "tab").withColumn("at", F.floor((F.col("at") - F.col("first")) / run))
    both = placed.select("tab", F.explode(F.array(F.struct(F.col("at").alias("g"), F.lit(True).alias("own")), F.struct((F.col("at") - 1).alias("g"), F.lit(False).alias("own")))).alias("m"), "id", "v")
    met = both.where("m.g >= 0").select("tab", "m.g", "m.own", "id", "v")
    pairs = met.groupBy("tab", "g").applyInPandas(_best(k, metric), f"id {kind}, nbr {kind}, score double")
    pairs = pairs.groupBy("id", "nbr").agg(F.max("score").alias("score"))
    top = pairs.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "nbr"))).where(F.col("place") <= k)

    # classes to rows: other copies first, then the rows of neighbouring classes
    near = top.select(F.col("id").alias("head"), F.col("nbr"), "score").join(few.select(F.col("head").alias("nbr"), F.col("id").alias("id2")), "nbr").select("head", "id2", "score")
    own = few.where("n > 1").select("head", F.col("id").alias("id2"), F.lit(1.0 if metric == "cosine" else 0.0).alias("score"))
    if metric == "cosine":  # a zero vector is as far from its copies as from all
        zero = heads.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) == 0).select("head", F.lit(0.0).alias("zero"))
        own = own.join(F.broadcast(zero), "head", "left").select("head", "id2", F.coalesce("zero", "score").alias("score"))
    best = F.row_number().over(Window.partitionBy("head").orderBy(F.col("score").desc(), "id2"))
    lists = near.unionByName(own).withColumn("place", best).where(F.col("place") <= k + 1)  # one may be the row itself
    lists = lists.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "id2", "score"))).alias("list"))
    members = rows.join(heads.select("v", "head"), "v").select("id", "head")
    out = members.join(lists, "head")
    others = F.slice(F.filter("list", lambda x: x["id2"] != F.col("id")), 1, k)
    out = out.select("id", F.posexplode(others).alias("p", "x"))
    value = F.col("x.score") if metric == "cosine" else -F.col("x.score")
    return out.select(F.col("id").alias("id1"), F.col("x.id2").alias("id2"), value.alias(name), (F.col("p") + 1).cast("int").alias("rank"))


def recall(found: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, metric: str = "cosine", queries: int = 200, seed: int = 5) -> float | None:
    """Share of the exact ``k`` best scores that ``found`` (as
    ``approx_topk_neighbours`` gives it) reaches, for the ``queries`` rows of the
    smallest hashes: their vectors go to all tasks, which scan all rows once.
    A neighbour counts when its score is no worse than the exact one of its
    rank, so ties count whichever row was taken.  None without rows."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows, width = _cleaned(vectors, id_col, vec_col, metric)
    asked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries).collect()  # a bounded number of vectors
    if not asked:
        return None
    ids, q = [r["id"] for r in asked], np.array([r["v"] for r in asked], np.float64).reshape(len(asked), width)

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = _scores(q, np.asarray(b.column(1).flatten()).reshape(b.num_rows, width), metric)
            own = b.column(0).to_pylist()
            where = {x: i for i, x in enumerate(own)}
            for i, x in enumerate(ids):
                if x in where:
                    s[i, where[x]] = -np.inf
            kk = min(k, s.shape[1])
            near = -np.sort(-s, axis=1)[:, :kk]
            query = np.repeat(np.arange(len(ids)), kk)
            keep = np.isfinite(near.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(query[keep], pa.int32()), pa.array(near.reshape(-1)[keep])], ["q", "score"])

    best = rows.select("id", "v").mapInArrow(scan, "q int, score double")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("rank") <= k)
    exact = {(r["q"], r["rank"]): r["score"] for r in best.collect()}  # k rows for each query
    name = "cosine_similarity" if metric == "cosine" else "distance"
    value = F.col(name) if metric == "cosine" else -F.col(name)
    number = vectors.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), f"id1 {vectors.schema[id_col].dataType.simpleString()}, q int")
    got = {(r["q"], r["rank"]): r["score"] for r in found.join(F.broadcast(number), "id1").select("q", "rank", value.alias("score")).collect()}
    if not exact:
        return None
    return sum(got.get(key, -np.inf) >= s - 1e-9 for key, s in exact.items()) / len(exact)
