"""2-D UMAP layout (D7): fuzzy neighbourhood graph, then epochs of attraction along its edges and repulsion from samples.

1. the exact k-NN graph, k = min(n - 1, neighbours - 1): a row counts as its own first neighbour;
2. a membership exp(-(d - rho) / sigma) of each neighbour, where rho is the smallest positive distance and sigma gives the
   row's memberships, its own among them, the sum log2(neighbours) (bisection over the row's bounded list);
3. the fuzzy union a + b - a b of both directions, as an edge table;
4. PCA positions, spread to a range of 10;
5. epochs, each one Spark job over the edges, packed once as binary cells for runs of points: a task draws ``samples`` rows
   for each of its points by a hash of (seed, epoch, point), sums all forces on a point and gives back its place.

Up to ``MAX_POINTS`` points only the positions (n x 2 doubles) move between epochs, broadcast and collected, and nothing is
shuffled.  Beyond that positions are a table of the shared folder all along, joined to the edges on both ends and to the
samples, and the forces are summed for each point before the shuffle; a hub, the neighbour of many rows, then has its
edges spread over salts that are found once.  All edges act in every epoch by their weight,
where the sequential algorithm draws them in proportion to it, and a point's force is divided by the sum of its weights,
as its edges no longer act one after the other.  Coordinates are not comparable value by value with other implementations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import reduce as R
from tessera.operators.hot_join import hot_keys, salt_rows, salt_table
from tessera.operators.layout import MAX_POINTS, PACK_POINTS, pack_edges
from tessera.operators.similarity import METRICS, topk_neighbours
from tessera.session import reliable_checkpoint
from tessera.sources.keys import add_row_number


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) nearest in squares to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond, over
    [0, 3 spread]; by Gauss-Newton on their logarithms."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.zeros(2)

    def miss(q):
        return 1 / (1 + np.exp(q[0]) * x ** (2 * np.exp(q[1]))) - want

    for _ in range(200):
        r = miss(p)
        y = r + want
        inner = -y * (1 - y)
        jac = np.stack([inner, inner * 2 * np.exp(p[1]) * np.log(x)], 1)
        step = np.linalg.lstsq(jac, -r, rcond=None)[0]
        size = 1.0
        while size > 1e-8 and (miss(p + size * step) ** 2).sum() > (r * r).sum():
            size /= 2
        p = p + size * step
        if np.abs(size * step).max() < 1e-12:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _memberships(knn: DataFrame, total: float) -> DataFrame:
    """(i, j, w): each row's neighbours with their memberships, which sum to ``total``."""
    rows = knn.groupBy(F.col("id1").alias("i")).agg(F.collect_list(F.struct("id2", "distance")).alias("near"))  # k entries

    def part(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids = [np.array([x["id2"] for x in near]) for near in pdf["near"]]
            far = [np.array([x["distance"] for x in near], np.float64) for near in pdf["near"]]
            d = np.full((len(far), max(map(len, far))), np.inf)
            for r, own in enumerate(far):
                d[r, : len(own)] = own
            rho = np.where(d > 0, d, np.inf).min(1)
            rho = np.where(np.isfinite(rho), rho, 0.0)
            over = np.maximum(d - rho[:, None], 0.0)
            lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(64):
                much = np.exp(-over / sigma[:, None]).sum(1) > total
                hi, lo = np.where(much, sigma, hi), np.where(much, lo, sigma)
                sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
            mean = np.array([own.mean() for own in far])
            sigma = np.maximum(sigma, np.maximum(1e-3 * mean, 1e-12))  # many copies of a row: a floor
            w = np.exp(-over / sigma[:, None])
            yield pd.DataFrame({"i": np.repeat(pdf["i"].to_numpy(), [len(x) for x in ids]), "j": np.concatenate(ids),
                                "w": np.concatenate([w[r, : len(x)] for r, x in enumerate(ids)])})

    return rows.mapInPandas(part, "i long, j long, w double")


def fuzzy_graph(points: DataFrame, neighbours: int = 15, metric: str = "euclidean") -> DataFrame:
    """(``i``, ``j``, ``w``), both directions, of ``points`` (``id`` long, unique, not null; ``v``): the fuzzy union of the rows'
    memberships."""
    k = min(points.count(), neighbours) - 1
    knn = topk_neighbours(points, "id", "v", k, metric)
    if metric == "cosine":
        knn = knn.withColumn("distance", F.greatest(F.lit(0.0), 1 - F.col("cosine_similarity")))
    own = reliable_checkpoint(_memberships(knn, float(np.log2(k + 1))))
    both = own.select("i", "j", F.col("w").alias("there"), F.lit(0.0).alias("back")).unionByName(
        own.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("there"), F.col("w").alias("back")))
    united = both.groupBy("i", "j").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    return united.select("i", "j", (F.col("there") + F.col("back") - F.col("there") * F.col("back")).alias("w")).where("w > 0")


def umap_layout(vectors: DataFrame, id_col: str, vec_col: str, neighbours: int = 15, metric: str = "euclidean", min_dist: float = 0.1,
                epochs: int = 100, samples: int = 5, seed: int = 7742, out=("x_embed", "y_embed")) -> DataFrame:
    """2-D coordinates ``(id, x_embed, y_embed)`` of the rows that have a vector (not null, without nulls).

    ``metric`` is one of ``METRICS`` (hellinger needs non-negative vectors).  Ids may be of any type; rows are numbered, so
    repeated and null ids are points of their own.  Fewer than three rows are put at the origin; an empty table stays empty."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if neighbours < 2:
        raise ValueError("neighbours must be 2 or more")
    named = vectors.select(F.col(id_col).alias("_name"), V.clean(vec_col).alias("v")).where("v IS NOT NULL")
    named = add_row_number(named, ["_name", "v"], "id", start=0)
    n = named.count()
    if n < 3:
        return named.select(F.col("_name").alias(id_col), F.lit(0.0).alias(out[0]), F.lit(0.0).alias(out[1]))
    a, b = curve(min_dist)
    edges = reliable_checkpoint(fuzzy_graph(named.select("id", "v"), neighbours, metric))
    settings = dict(epochs=epochs, a=a, b=b, samples=samples, seed=seed)
    start = _start(named, n)
    at = (_packed_epochs if n <= MAX_POINTS else _joined_epochs)(start, edges, n, **settings)
    return named.select("id", "_name").join(at, "id").select(F.col("_name").alias(id_col), F.col("x").alias(out[0]), F.col("y").alias(out[1]))


def _packed_epochs(start: DataFrame, edges: DataFrame, n: int, epochs: int, a: float, b: float, samples: int, seed: int) -> DataFrame:
    """(id, x, y) after all epochs, positions broadcast."""
    spark = edges.sparkSession
    slots = spark.sparkContext.defaultParallelism
    points = min(PACK_POINTS, -(-n // (4 * slots)))
    packed = reliable_checkpoint(pack_edges(edges.withColumnRenamed("w", "p"), points))  # every row has neighbours, so every row has edges
    packed = packed.repartitionByRange(slots, "block").persist()
    placed = start.select("id", "x", "y").toArrow()
    pos = np.zeros((n, 2))
    pos[placed["id"].to_numpy()] = np.stack([placed["x"].to_numpy(), placed["y"].to_numpy()], 1)
    first = F.col("block").cast("long") * points
    every = F.sequence(first, F.least(first + points, F.lit(n)) - 1)
    for epoch in range(epochs):
        alpha, bc = 1.0 - epoch / epochs, spark.sparkContext.broadcast(pos)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos = bc.value
            for batch in batches:
                drawn = batch.column("drawn")
                for r, cells in enumerate(batch.select(list("imjp")).to_pylist()):
                    rows, m, j = (np.frombuffer(cells[c], np.int32) for c in "imj")
                    other = drawn.slice(r, 1).flatten().to_numpy().reshape(-1, samples)[rows - rows[0]]
                    found = _moved(pos, rows, m, j, np.frombuffer(cells["p"]), other, alpha, a, b)
                    yield pa.RecordBatch.from_arrays([pa.array([cells["i"]], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["i", "found"])

        # ids are 0 to n - 1 and each has edges, so the points of a block are the numbers from its first one on
        drawn = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: _draw(i, s, epoch, seed, n))))
        rows = packed.withColumn("drawn", drawn).select("i", "m", "j", "p", "drawn").mapInArrow(part, "i binary, found binary").toArrow()
        pos = np.zeros((n, 2))
        for i, found in zip(rows["i"].to_pylist(), rows["found"].to_pylist()):
            pos[np.frombuffer(i, np.int32)] = np.frombuffer(found).reshape(-1, 2)
        bc.destroy()
    packed.unpersist()
    return spark.createDataFrame(pa.table({"id": np.arange(n), "x": pos[:, 0], "y": pos[:, 1]}))


def _draw(i, s, epoch: int, seed: int, n: int):
    return F.pmod(F.xxhash64(i, s, F.lit(epoch), F.lit(seed)), F.lit(n))


def _moved(pos, rows, m, j, w, other, alpha: float, a: float, b: float) -> np.ndarray:
    """New positions of ``rows``, which have ``m`` edges each to ``j``, of weights ``w``, and meet the samples ``other``."""

    def clip(force, d):
        return np.clip(force[..., None] * d, -4.0, 4.0)

    own, at = pos[rows], np.repeat(np.arange(len(rows)), m)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = own[at] - pos[j]
        d2 = (d * d).sum(-1)
        pull = w[:, None] * clip(np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0.0), d)
        e = own[:, None] - pos[other]
        e2 = (e * e).sum(-1)
        push = clip(np.where((e2 > 0) & (other != rows[:, None]), 2 * b / ((0.001 + e2) * (1 + a * e2**b)), 0.0), e)
    degree = np.bincount(at, w, len(rows))
    pulled = np.stack([np.bincount(at, pull[:, c], len(rows)) for c in (0, 1)], 1)
    return own + alpha * (pulled / degree[:, None] + push.sum(1))


def _joined_epochs(start: DataFrame, edges: DataFrame, n: int, epochs: int, a: float, b: float, samples: int, seed: int) -> DataFrame:
    """(id, x, y) after all epochs, positions joined to the edges."""
    parts = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hubs = reliable_checkpoint(hot_keys(edges, "i", parts))  # fewer than ``parts`` rows; edges are symmetric: those of j too
    for end, other in (("i", "j"), ("j", "i")):
        named_hubs = hubs.withColumnRenamed("i", end)
        edges = salt_rows(edges, named_hubs, end, [other], parts).withColumnRenamed("_salt", f"_salt_{end}")
    degree = edges.groupBy("i").agg(F.sum("w").alias("degree")).withColumnRenamed("i", "id")
    edges = reliable_checkpoint(edges)
    at = start.join(degree, "id")  # every row has neighbours, so every row has edges
    at = reliable_checkpoint(at)
    for epoch in range(epochs):
        at = reliable_checkpoint(_epoch(at, edges, hubs, n, epoch, 1.0 - epoch / epochs, a, b, samples, seed))
    return at.select("id", "x", "y")


def _start(named: DataFrame, n: int) -> DataFrame:
    """(id, x, y): the first two principal components in a range of 10, and a little noise by hash, so that copies part."""
    two = named.where(F.size("v") > 1).isEmpty()
    pc = R.pca(named, "v", 1 if two else 2).transform(named, "v", "pc")
    pc = reliable_checkpoint(pc.select("id", F.col("pc")[0].alias("x"), (F.lit(0.0) if two else F.col("pc")[1]).alias("y")))
    widest = pc.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("m")).first()["m"] or 1.0

    def noise(salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0) * 0.01

    return pc.select("id", (F.col("x") * (10.0 / widest) + noise(1)).alias("x"), (F.col("y") * (10.0 / widest) + noise(2)).alias("y"))


def _epoch(at: DataFrame, edges: DataFrame, hubs: DataFrame, n: int, epoch: int, alpha: float, a: float, b: float, samples: int, seed: int) -> DataFrame:
    place = at.select("id", "x", "y")

    def end(name: str) -> DataFrame:
        table = salt_table(place.withColumnRenamed("id", name), hubs.withColumnRenamed("i", name), name)
        return table.select(name, F.col("_salt").alias(f"_salt_{name}"), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))

    def clip(c):
        return F.least(F.greatest(c, F.lit(-4.0)), F.lit(4.0))

    dx, dy = F.col("x_i") - F.col("x_j"), F.col("y_i") - F.col("y_j")
    d2 = dx * dx + dy * dy
    pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0)
    push = F.when(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))).otherwise(0.0)
    drawn = edges.join(end("i"), ["i", "_salt_i"]).join(end("j"), ["j", "_salt_j"])
    forces = drawn.select(F.col("i").alias("id"), *[(F.col("w") * clip(pull * d)).alias(f"f{c}") for c, d in (("x", dx), ("y", dy))], F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"))
    chance = at.select(F.col("id").alias("i"), F.col("x").alias("x_i"), F.col("y").alias("y_i"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s"))
    chance = chance.withColumn("j", _draw(F.col("i"), F.col("s"), epoch, seed, n))
    met = chance.join(place.select(F.col("id").alias("j"), F.col("x").alias("x_j"), F.col("y").alias("y_j")), "j").where("i <> j")
    apart = met.select(F.col("i").alias("id"), F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), clip(push * dx).alias("rx"), clip(push * dy).alias("ry"))
    sums = forces.unionByName(apart).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "rx", "ry")])
    moved = at.join(sums, "id", "left")

    def new(c):
        return (F.col(c) + alpha * (F.coalesce(F.col(f"f{c}"), F.lit(0.0)) / F.col("degree") + F.coalesce(F.col(f"r{c}"), F.lit(0.0)))).alias(c)

    return moved.select("id", new("x"), new("y"), "degree")
