"""Clustering and cluster-quality scores.

Scores are exact closed forms over per-cluster summaries (k rows of size d,
counted and checked before they are broadcast):

* silhouette (cosine): the mean cosine distance from x to cluster C is
  ``1 - x_hat . S_C / |C|`` with S_C the sum of C's unit vectors, so one
  ``groupBy(cluster)`` replaces the n x n distance matrix.  Zero vectors are
  at distance 1 from everything; one-member clusters score 0.
* Calinski-Harabasz: between / within dispersion from centroids.
* Davies-Bouldin: mean euclidean distance to the centroid per cluster and the
  k x k centroid distances.

Labels are of any type.  Rows without a label, and rows whose vector is null or
holds a null, are in no score; without any other row a score is NULL.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators.lloyd import lloyd, pack
from tessera.operators.scale import with_constants
from tessera.session import reliable_checkpoint

MAX_CLUSTERS = 10_000


def _dense(col: str):
    return V.clean(col)


def _labelled(df: DataFrame, vec, cluster_col: str) -> DataFrame:
    """(_cl, _x): the label as a string and the vector of the rows that have both."""
    return df.select(F.col(cluster_col).cast("string").alias("_cl"), vec.alias("_x")).where("_cl IS NOT NULL AND _x IS NOT NULL")


def cluster_summaries(df: DataFrame, cluster_col: str, vec, with_unit: bool = False) -> list[dict]:
    """Per cluster: size, sum vector (or the sum of unit vectors ``u``), from
    one aggregate with map-side partial sums; k rows."""
    v = array_to_vector(V.normalize(vec) if with_unit else vec)
    rows = df.where(F.col(cluster_col).isNotNull() & vec.isNotNull()).groupBy(F.col(cluster_col).alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.metrics("sum").summary(v).alias("s")).select(
        "_k", "n", vector_to_array("s.sum").alias("s")).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    out = [{"label": r["_k"], "n": r["n"], "u" if with_unit else "s": r["s"]} for r in rows]
    return sorted(out, key=lambda x: x["label"])


def _with_summaries(df: DataFrame, summaries: list[dict], fields: list[str]) -> DataFrame:
    """Rows (_cl, _x) with parallel arrays of cluster sizes and vectors (k x d, checked), and ``_at``, the place (from 1) of
    the row's cluster in them."""
    one = {"_sizes": [float(s["n"]) for s in summaries]}
    for f in fields:
        one[f"_{f}"] = [[float(x) for x in s[f]] for s in summaries]
    place = F.array_position(F.lit([str(s["label"]) for s in summaries]), F.col("_cl")).cast("int")
    return with_constants(df.withColumn("_at", place), one)


def _no_score(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(None,)], f"{name} double")


def silhouette(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """Mean silhouette with cosine distance (one row ``silhouette``)."""
    vec = _dense(vec_col)
    rows = _labelled(df, vec, cluster_col)
    summ = cluster_summaries(rows, "_cl", F.col("_x"), with_unit=True)
    if not summ:
        return _no_score(df, "silhouette")
    j = _with_summaries(rows.withColumn("_x", V.normalize(F.col("_x"))), summ, ["u"])
    own_n = F.element_at("_sizes", F.col("_at"))
    xx = V.dot(F.col("_x"), F.col("_x"))
    dots = F.transform(F.col("_u"), lambda s: V.dot(F.col("_x"), s))
    own_dot = F.element_at(dots, F.col("_at"))
    a = F.try_divide((own_n - 1.0) - (own_dot - xx), own_n - 1.0)
    means = F.zip_with("_sizes", dots, lambda n, d: (n - d) / n)
    b = F.array_min(F.transform(means, lambda m, i: F.when(i + 1 != F.col("_at"), m)))
    # a row as near to its own cluster as to the next (a = b = 0: duplicates in two clusters) scores 0
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return j.select(s.alias("_s")).agg(F.avg("_s").alias("silhouette"))


def calinski_harabasz(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)) with euclidean dispersion."""
    rows = _labelled(df, _dense(vec_col), cluster_col)
    summ = cluster_summaries(rows, "_cl", F.col("_x"))
    if not summ:
        return _no_score(df, "calinski_harabasz")
    n, k = float(sum(s["n"] for s in summ)), len(summ)
    sizes, sums = np.array([s["n"] for s in summ], float), np.array([s["s"] for s in summ], float)
    centres = sums / sizes[:, None]
    between = float((sizes * ((centres - sums.sum(0) / n) ** 2).sum(1)).sum())
    for s, c in zip(summ, centres):
        s["c"] = c
    j = _with_summaries(rows, summ, ["c"])
    within = j.agg(F.sum(V.squared_euclidean(F.col("_x"), F.element_at("_c", F.col("_at")))).alias("w"))
    ch = F.when((F.col("w") > 0) & F.lit(k > 1), F.lit(between / max(k - 1, 1)) / (F.col("w") / F.lit(n - k)))
    return within.select(ch.otherwise(F.lit(1.0) if k > 1 else F.lit(None)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d_ij, s = mean euclidean
    distance to the centroid (not root-mean-square)."""
    rows = _labelled(df, _dense(vec_col), cluster_col)
    summ = cluster_summaries(rows, "_cl", F.col("_x"))
    if not summ:
        return _no_score(df, "davies_bouldin")
    centres = np.array([s["s"] for s in summ], float) / np.array([s["n"] for s in summ], float)[:, None]
    for s, c in zip(summ, centres):
        s["c"] = c
    j = _with_summaries(rows, summ, ["c"])
    found = j.groupBy("_at").agg(F.avg(V.euclidean(F.col("_x"), F.element_at("_c", F.col("_at")))).alias("s")).collect()  # k rows
    spread = np.zeros(len(summ))
    for r in found:
        spread[r["_at"] - 1] = r["s"]
    worst = []
    for i in range(len(summ)):
        apart = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        ratio = np.divide(spread + spread[i], apart, out=np.zeros(len(summ)), where=apart > 0)  # coincident centroids count 0
        worst.append(float(ratio.max()))
    return df.sparkSession.createDataFrame([(float(np.mean(worst)),)], "davies_bouldin double")


# --- k-means -------------------------------------------------------------------

def kmeans(df: DataFrame, vec_col: str, k: int = 4, n_init: int = 20, seed: int = 7742, max_iter: int = 300,
           id_col: str | None = None, name: str = "cluster", init: str = "k-means||"):
    """Best of ``n_init`` seeded k-means runs (lowest inertia), labels
    canonicalised: clusters ordered by size descending, then by the smallest
    member id.  Returns (labelled frame, centroids as a list).

    One path at every size: first centres by Spark ML, seeded over all rows
    (``init``: ``k-means||`` or ``random``), then Lloyd's rounds in which all
    restarts share one job (``tessera.operators.lloyd``), over vectors that
    are written once to the shared folder.  Rows whose vector is null
    or holds a null get a NULL label; without any vector there are no centroids."""
    if init not in ("k-means||", "random"):
        raise ValueError("init must be 'k-means||' or 'random'")
    df = df.drop(name)
    usable = _dense(vec_col).isNotNull()
    data = reliable_checkpoint(df.where(usable).withColumn("_features", array_to_vector(_dense(vec_col))))
    rest = df.where(~usable).withColumn(name, F.lit(None).cast("int"))
    if data.isEmpty():
        return rest, []

    vectors = data.select("_features").persist()  # else every restart would cache its own copy

    def first_centres(i):
        m = KMeans(k=k, seed=seed + i, maxIter=0, featuresCol="_features", predictionCol="_raw", initMode=init).fit(vectors)
        return np.array(m.clusterCenters())

    slots = df.sparkSession.sparkContext.defaultParallelism
    with ThreadPoolExecutor(max_workers=max(1, min(8, slots, int(n_init)))) as pool:
        starts = list(pool.map(first_centres, range(max(1, int(n_init)))))
    vectors.unpersist()
    packed = pack(data.select(vector_to_array("_features").alias("v")), "v")
    fits = lloyd(packed, starts, max_iter, 1e-4)
    centers = fits[min(range(len(fits)), key=lambda i: (fits[i][0], i))][1]
    pred = assign_nearest(data, vec_col, centers.tolist(), "_raw").drop("_features")
    order_key = F.min(F.col(id_col)) if id_col else F.lit(0)
    stats = pred.groupBy("_raw").agg(F.count(F.lit(1)).alias("_n"), order_key.alias("_first")).collect()  # k rows
    ranked = sorted(stats, key=lambda r: (-r["_n"], r["_first"] if r["_first"] is not None else 0, r["_raw"]))
    mapping = {r["_raw"]: i for i, r in enumerate(ranked)}
    centroids = [[float(x) for x in centers[raw]] for raw in mapping]
    label = F.coalesce(*[F.when(F.col("_raw") == raw, new) for raw, new in mapping.items()])
    return pred.withColumn(name, label.cast("int")).drop("_raw").unionByName(rest), centroids


def assign_nearest(df: DataFrame, vec_col: str, centroids: list[list[float]], name: str = "cluster",
                   metric: str = "euclidean") -> DataFrame:
    """Label new vectors with the nearest fitted centroid (original labels
    kept, any number of rows, no refit).  Centroids are a checked k x d list."""
    if len(centroids) > MAX_CLUSTERS:
        raise ValueError("too many centroids")
    j = with_constants(df, {"_cent": [[float(x) for x in c] for c in centroids]})
    if metric == "mean_cosine":
        # centroids hold mean unit vectors: 1 - x_hat . c is the mean cosine
        # distance to the cluster's members (average linkage to a new point)
        dist = lambda a, c: F.lit(1.0) - V.dot(V.normalize(a), c)
    else:
        dist = V.distance(metric)
    ds = F.transform(F.col("_cent"), lambda c, i: F.struct(dist(_dense(vec_col), c).alias("d"), i.alias("i")))
    return j.withColumn(name, F.when(_dense(vec_col).isNotNull(), F.array_min(ds)["i"]).cast("int")).drop("_cent")
