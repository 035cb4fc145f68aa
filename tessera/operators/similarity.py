"""Cosine similarity between texts.

* Filtered matrices (M1-M3) first choose ``size`` ids (exact list,
  seeded hash order, or the focus id's nearest / farthest / hashed others
  found by one linear scan against the broadcast focus vector), and only then
  form the size x size pairs, by a join in parts.
* Unfiltered similarity is re-aimed as every row's top-k (M4, D10) and as a
  thresholded self-join (M5).  Both use exact blocked products: rows are
  hashed into B balanced blocks, each (left block, right block) task makes
  dense products in Arrow/numpy, a tile at a time (``cogroup().applyInArrow``),
  and a task emits only its per-row top-k or the pairs above the threshold.
  A pair is scored by itself once a tile has it within rounding of the
  row's k-th best (or of the threshold).  Per-row candidates (k per right block)
  are merged with a window over at most k x B rows per id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V

LCG_MOD = 2147483647
LCG_MUL = 48271


def hash_order(id_col: str, seed: int, numeric: bool = True):
    """Deterministic pseudo-random order key of an id (a Lehmer step of an
    integer, or of a string's CRC-32); the same arithmetic is expressible in
    any SQL engine."""
    key = F.col(id_col) if numeric else F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.pmod(F.pmod(key, F.lit(LCG_MOD)) * F.lit(LCG_MUL) + F.lit(int(seed)), F.lit(LCG_MOD))


def _numeric(df: DataFrame, id_col: str) -> bool:
    return df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")


def _check_size(size: int) -> int:
    if size < 1:
        raise ValueError("filter size must be at least 1")
    return int(size)


def cosine_pairs(vectors: DataFrame, id_col: str, vec_col: str, cluster_col: str | None = None,
                 blocks: int = 8) -> DataFrame:
    """M1: all ordered pairs (self pairs included) of an already filtered
    id set: ``id1, id2, cosine_similarity, cluster1, cluster2`` and the labels
    ``"<id>1: <id1>"`` / ``"<id>2: <id2>"``.  A zero vector has similarity 0
    with everything.

    The set is joined with itself in ``blocks`` parts: every left row goes to
    all parts, every right row to the part of its id, so no task gathers the
    set."""
    cl = F.col(cluster_col) if cluster_col else F.lit(None).cast("int")
    items = vectors.select(F.struct(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                                    cl.alias("c")).alias("it"))
    left = items.select(F.col("it").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_part"))
    right = items.select(F.col("it").alias("b"), F.pmod(F.xxhash64("it.id"), F.lit(blocks)).cast("int").alias("_part"))
    pairs = left.join(right, "_part")
    return pairs.select(
        F.col("a.id").alias("id1"), F.col("b.id").alias("id2"),
        V.cosine_similarity(F.col("a.v"), F.col("b.v")).alias("cosine_similarity"),
        F.col("a.c").alias("cluster1"), F.col("b.c").alias("cluster2"),
        F.concat(F.lit(f"{id_col}1: "), F.col("a.id").cast("string")).alias("label1"),
        F.concat(F.lit(f"{id_col}2: "), F.col("b.id").cast("string")).alias("label2"),
    )


def filter_exact(vectors: DataFrame, id_col: str, ids) -> DataFrame:
    """Keep the listed ids (semi join with a small id table)."""
    spark = vectors.sparkSession
    ids = list(ids)
    _check_size(len(ids))
    id_type = vectors.schema[id_col].dataType.simpleString()
    keep = spark.createDataFrame([(i,) for i in ids], f"{id_col} {id_type}")
    return vectors.join(F.broadcast(keep), id_col, "left_semi")


def filter_random(vectors: DataFrame, id_col: str, size: int, seed: int = 7) -> DataFrame:
    """P5: ``size`` ids in seeded hash order (without replacement)."""
    size = _check_size(size)
    return vectors.orderBy(hash_order(id_col, seed, _numeric(vectors, id_col)), F.col(id_col)).limit(size)


def filter_focused(vectors: DataFrame, id_col: str, vec_col: str, focus_id, mode: str = "most_similar",
                   size: int = 10, seed: int = 7) -> DataFrame:
    """The focus id plus its ``size - 1`` most similar, least similar
    or hash-chosen others (ties by id).  One linear scan against the focus
    vector, which is broadcast as a literal; an absent focus id gives no rows."""
    size = _check_size(size)
    focus = vectors.where(F.col(id_col) == F.lit(focus_id)).select(F.col(vec_col).cast("array<double>")).limit(1).collect()
    if not focus:
        return vectors.limit(0)
    fv = F.array(*[F.lit(float(x)) for x in focus[0][0]])
    others = vectors.where(F.col(id_col) != F.lit(focus_id))
    if mode == "most_similar":
        order = [V.cosine_similarity(F.col(vec_col).cast("array<double>"), fv).desc(), F.col(id_col)]
    elif mode == "least_similar":
        order = [V.cosine_similarity(F.col(vec_col).cast("array<double>"), fv).asc(), F.col(id_col)]
    elif mode == "random":
        order = [hash_order(id_col, seed, _numeric(vectors, id_col)), F.col(id_col)]
    else:
        raise ValueError("mode must be most_similar, least_similar or random")
    chosen = others.orderBy(*order).limit(size - 1)
    return vectors.where(F.col(id_col) == F.lit(focus_id)).unionByName(chosen)


METRICS = ("cosine", "euclidean", "manhattan", "chebyshev", "hellinger")


# --- exact blocked top-k / threshold join ---------------------------------

TASK_BYTES = 16 << 20  # vectors of one side of a block pair
TASK_ROWS = 32_768
JOIN_ROWS = 8_192  # a task of a threshold join also holds its pairs


def _blocks(vectors: DataFrame, vec_col: str, block_rows: int, most: int = TASK_ROWS) -> int:
    """Blocks of a table: no more than give every slot a few block pairs, unless a block would pass ``TASK_BYTES`` or ``most``
    rows.  Every row is sent to each block of the other side, so few blocks keep the shuffle small; the products are
    cut into tiles inside the task.  ``block_rows`` is the least number of rows worth a block."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(most, TASK_BYTES // (8 * max(width or 1, 1))))
    return max(1, math.ceil(n / rows), min(math.ceil(n / max(1, block_rows)), math.ceil(math.sqrt(4 * slots))))


def _prepare(vectors: DataFrame, id_col: str, vec_col: str, metric: str, n_blocks: int) -> DataFrame:
    v = V.clean(vec_col)
    if metric == "cosine":
        v = V.normalize(v)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int").alias("blk"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL")


def _block_pairs(prepared: DataFrame, n_blocks: int, upper: bool = False):
    """Left rows replicated to tasks (blk, j), right rows to tasks (i, blk);
    ``upper``: only tasks (i, j) with i <= j."""
    first, last = F.lit(0), F.lit(n_blocks - 1)
    to_right = F.sequence(F.col("blk") if upper else first, last)
    to_left = F.sequence(first, F.col("blk") if upper else last)
    # Distinct names per side: both sides derive from one frame, and shared
    # attribute ids would make the co-group drop a side's columns.
    left = prepared.select(F.col("id").alias("lid"), F.col("v").alias("lv"), F.col("blk").alias("bl"),
                           F.explode(to_right).alias("br"))
    right = prepared.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.explode(to_left).alias("bl"),
                            F.col("blk").alias("br"))
    return left.groupBy("bl", "br"), right.groupBy("bl", "br")


def _scores(lv: np.ndarray, rv: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return lv @ rv.T
    if metric in ("manhattan", "chebyshev"):  # row by row: a block of n x d differences at a time
        fold = np.sum if metric == "manhattan" else np.max
        return -np.stack([fold(np.abs(rv - x), axis=1) for x in lv])
    if metric == "hellinger":
        sl, sr = lv.sum(1), rv.sum(1)
        den = np.sqrt(sl[:, None] * sr[None, :])
        bc = np.sqrt(lv) @ np.sqrt(rv).T
        near = np.divide(bc, den, out=((sl[:, None] == 0) & (sr[None, :] == 0)).astype(float), where=den > 0)
        return -np.sqrt(np.maximum(1.0 - near, 0.0))
    sq = (lv * lv).sum(1)[:, None] + (rv * rv).sum(1)[None, :] - 2.0 * (lv @ rv.T)
    return -np.sqrt(np.maximum(sq, 0.0))  # higher is closer


def _side(table: pa.Table, id_col: str, vec_col: str) -> tuple[pa.Array, np.ndarray]:
    """Ids and the matrix of vectors of a block's rows."""
    vec = table.column(vec_col).combine_chunks()
    width = np.unique(vec.value_lengths().to_numpy(zero_copy_only=False))
    if len(width) > 1:
        raise ValueError("vectors must have one length")
    return table.column(id_col).combine_chunks(), vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), width[0])


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids: of the numbers themselves, of others as strings.  Ids of two types are numbered apart."""
    if left.type != right.type:
        return _codes(left, left)[0], _codes(right, right)[0]
    both = pa.concat_arrays([left, right])
    keys = both if pa.types.is_integer(both.type) or pa.types.is_floating(both.type) else both.cast(pa.string())
    code = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code[:len(left)], code[len(left):]


STRIP, TILE, FOLD = 256, 2_048, 512  # rows and columns of a tile of scores; columns of one fold over the dimensions
CHUNK = 1 << 22  # values of the pairs that are scored at once
WHOLE = 1 << 20  # pairs of blocks so small that all their scores are made at once


class _Tiles:
    """Scores of all pairs of two blocks, a tile at a time: ``tile`` gives numbers that order pairs as the metric does, up to
    ``slack`` of the left row; ``exact`` scores single pairs; ``floor`` turns a score into a number that no
    tile's entry of an equal or better pair is below.  Pairs whose score isn't finite have none: their rows are left out."""

    def __init__(self, lv: np.ndarray, rv: np.ndarray, metric: str):
        self.metric, self.lv, self.rv = metric, lv, rv
        d, eps = lv.shape[1], np.finfo(np.float64).eps
        with np.errstate(all="ignore"):
            if metric in ("manhattan", "chebyshev"):
                mid = _middle(rv)
                lc, rc = lv - mid, rv - mid
                self.scale = max(_largest(lc), _largest(rc)) or 1.0
                self.l, self.r = (lc / self.scale).astype(np.float32), np.ascontiguousarray((rc / self.scale).astype(np.float32).T)
                size, top, unit = np.abs(lc / self.scale).sum(1), np.abs(rc / self.scale).sum(1), 1.2e-7
                finite = np.isfinite(size), np.isfinite(top)
            elif metric == "euclidean":  # x.y - |y|^2 / 2
                mid = _middle(rv)
                lc, rc = lv - mid, rv - mid
                self.half = (lc * lc).sum(1)
                top = (rc * rc).sum(1)
                self.l, self.r = np.c_[lc, np.ones(len(lc))], np.c_[rc, -top / 2.0].T
                size, unit = self.half, 8 * eps
                finite = np.isfinite(size), np.isfinite(top)
            else:
                if metric == "hellinger":  # zero vectors are near each other
                    (self.ls, lq), (self.rs, rq) = ((x.sum(1), np.sqrt(x)) for x in (lv, rv))
                    lc, rc = (np.c_[np.divide(q, np.sqrt(t)[:, None], out=np.zeros_like(q), where=t[:, None] != 0), t == 0]
                              for q, t in ((lq, self.ls), (rq, self.rs)))
                else:
                    lc, rc = lv, rv
                self.l, self.r = lc, rc.T
                size, top = (lc * lc).sum(1), (rc * rc).sum(1)
                unit = 8 * eps
                finite = np.isfinite(size), np.isfinite(top)
        self.left, self.right = np.flatnonzero(finite[0]), np.flatnonzero(finite[1])
        self.slack = (d + 8) * unit * (size + (top[finite[1]].max() if finite[1].any() else 0.0))

    def tile(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if self.metric not in ("manhattan", "chebyshev"):
            return self.l[rows] @ self.r[:, cols]
        l, r = self.l[rows], self.r[:, cols]
        out = np.empty((len(rows), len(cols)), np.float32)
        runs = [(c, np.ascontiguousarray(r[:, c:c + FOLD])) for c in range(0, len(cols), FOLD)]
        gap, ones = [np.empty_like(y) for _, y in runs], np.ones(len(r), np.float32)
        for i, x in enumerate(l):
            wide = np.repeat(x, FOLD).reshape(len(x), FOLD)  # equal shapes: numpy's loops are fastest on them
            for (c, y), g in zip(runs, gap):
                np.subtract(y, wide[:, :y.shape[1]], out=g)
                np.abs(g, out=g)
                out[i, c:c + FOLD] = ones @ g if self.metric == "manhattan" else g.max(0, initial=0.0)
        return np.negative(out, out=out)

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        step = max(1, CHUNK // max(1, self.lv.shape[1]))
        parts = [self._exact(rows[a:a + step], cols[a:a + step]) for a in range(0, len(rows), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.lv[i], self.rv[j]
        if self.metric == "cosine":
            return np.einsum("ij,ij->i", x, y)
        if self.metric == "hellinger":
            den = np.sqrt(self.ls[i] * self.rs[j])
            bc = np.einsum("ij,ij->i", np.sqrt(x), np.sqrt(y))
            near = np.divide(bc, den, out=((self.ls[i] == 0) & (self.rs[j] == 0)).astype(float), where=den > 0)
            return -np.sqrt(np.maximum(1.0 - near, 0.0))
        gap = np.abs(x - y)
        if self.metric == "manhattan":
            return -gap.sum(1)
        if self.metric == "chebyshev":
            return -gap.max(1, initial=0.0)
        return -np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def floor(self, rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        if self.metric in ("manhattan", "chebyshev"):
            score = score / self.scale
        elif self.metric == "euclidean":
            score = (self.half[rows] - score * score) / 2.0
        elif self.metric == "hellinger":
            score = 1.0 - score * score
        return score - self.slack[rows]


def _middle(v: np.ndarray) -> np.ndarray:
    mean = v[np.isfinite(v).all(1)].mean(0) if np.isfinite(v).all(1).any() else np.zeros(v.shape[1])
    return np.where(np.isfinite(mean), mean, 0.0)


def _largest(v: np.ndarray) -> float:
    return float(np.abs(np.where(np.isfinite(v), v, 0.0)).max(initial=0.0))


def _near(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(close.reshape(-1)), max(1, close.shape[1]))


def _first_copies(code: np.ndarray, v: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """Rows in the order of their ids, of equal vectors only as many as can be among the ``k`` nearest of any row."""
    order = np.argsort(code, kind="stable")
    if not len(v) or not v.shape[1]:
        return order
    rows = np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * v.dtype.itemsize))).reshape(-1)
    same = np.unique(rows, return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.searchsorted(same[by], same[by])
    most = k + (np.unique(code, return_counts=True)[1].max() if exclude_self else 0)
    return order[rank < most]


def _nearest(lcode, lv, rcode, rv, k: int, metric: str, exclude_self: bool):
    """Rows, columns and scores of each left row's ``k`` best right rows, by score and then by id."""
    if len(lv) * len(rv) <= WHOLE:
        s = _scores(lv, rv, metric)
        if exclude_self:
            s = np.where(lcode[:, None] == rcode[None, :], -np.inf, s)
        kk = min(k, s.shape[1])
        cols = np.lexsort((np.broadcast_to(rcode, s.shape), -s), axis=1)[:, :kk].reshape(-1)
        rows = np.repeat(np.arange(len(lv)), kk)
        ok = np.isfinite(s[rows, cols])
        return [rows[ok], cols[ok], s[rows, cols][ok]]
    exclude_self = exclude_self and bool(np.isin(lcode, rcode).any())
    kept = _first_copies(rcode, rv, k, exclude_self)
    rcode, rv = rcode[kept], rv[kept]
    t = _Tiles(lv, rv, metric)
    out = []
    for a in range(0, len(t.left), STRIP):
        rows = t.left[a:a + STRIP]
        bi, bj, bs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(rows), -np.inf)
        for c in range(0, len(t.right), TILE):
            cols = t.right[c:c + TILE]
            s = t.tile(rows, cols)
            if exclude_self:
                s[lcode[rows][:, None] == rcode[cols][None, :]] = -np.inf
            cut = np.maximum(floor, np.finfo(s.dtype).min)
            if len(cols) > k and not np.isfinite(floor).all():
                kth = np.partition(s, len(cols) - k, axis=1)[:, len(cols) - k]
                cut = np.maximum(cut, kth - 2 * t.slack[rows])
            i, j = _near(s >= cut[:, None])
            if not len(i):
                continue
            bi, bj = np.r_[bi, i], np.r_[bj, cols[j]]
            bs = np.r_[bs, t.exact(rows[i], cols[j])]
            order = np.lexsort((rcode[bj], -bs, bi))
            first = np.searchsorted(bi[order], np.arange(len(rows) + 1))
            order = order[np.arange(len(order)) - first[bi[order]] < k]
            bi, bj, bs = bi[order], bj[order], bs[order]
            full = np.flatnonzero(np.diff(first) >= k)
            last = np.searchsorted(bi, full, side="right") - 1
            floor[full] = t.floor(rows[full], bs[last])
        ok = np.isfinite(bs)
        out.append((rows[bi[ok]], kept[bj[ok]], bs[ok]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _topk_fn(k: int, metric: str, exclude_self: bool):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left.column("lid")[:0], "nbr": right.column("rid")[:0], "score": pa.array([], pa.float64())})
        (lid, lv), (rid, rv) = _side(left, "lid", "lv"), _side(right, "rid", "rv")
        lcode, rcode = _codes(lid, rid)
        i, j, s = _nearest(lcode, lv, rcode, rv, k, metric, exclude_self)
        return pa.table({"id": lid.take(pa.array(i)), "nbr": rid.take(pa.array(j)), "score": pa.array(s)})
    return fn


def _merged(cand: DataFrame, k: int, metric: str) -> DataFrame:
    """The k best of each row's candidates of all blocks."""
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("nbr"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    val = F.col("score") if metric == "cosine" else -F.col("score")
    name = "cosine_similarity" if metric == "cosine" else "distance"
    return top.select(F.col("id").alias("id1"), F.col("nbr").alias("id2"), val.alias(name), "rank")


def topk_neighbours(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, metric: str = "cosine",
                    block_rows: int = 2048, exclude_self: bool = True) -> DataFrame:
    """Every row's ``k`` nearest rows, exact.

    ``metric`` is ``cosine`` (score = similarity) or another of ``METRICS``
    (score = distance, smallest first; hellinger needs non-negative vectors).  Ties by neighbour id.
    Rows with a null id, or whose vector is null or holds a null, have and are no neighbours.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    nb = _blocks(vectors, vec_col, block_rows)
    prepared = _prepare(vectors, id_col, vec_col, metric, nb)
    lg, rg = _block_pairs(prepared, nb)
    kind = vectors.schema[id_col].dataType.simpleString()
    return _merged(lg.cogroup(rg).applyInArrow(_topk_fn(k, metric, exclude_self), f"id {kind}, nbr {kind}, score double"), k, metric)


def topk_between(queries: DataFrame, id_col: str, vec_col: str, base: DataFrame, base_id: str, base_vec: str, k: int = 5,
                 metric: str = "euclidean", block_rows: int = 2048) -> DataFrame:
    """Every query's ``k`` nearest rows of another table, exact: ``id1`` (query), ``id2`` (base), score and ``rank`` as in
    ``topk_neighbours``.  A query meets every block of ``base``, and emits its k best of each.  Rows with a null id, or
    whose vector is null or holds a null, have and are no neighbours; an empty table on either side gives no rows."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    nl, nr = _blocks(queries, vec_col, block_rows), _blocks(base, base_vec, block_rows)
    left = _prepare(queries, id_col, vec_col, metric, nl)
    right = _prepare(base, base_id, base_vec, metric, nr)
    left = left.select(F.col("id").alias("lid"), F.col("v").alias("lv"), F.col("blk").alias("bl"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("br"))
    right = right.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("bl"), F.col("blk").alias("br"))
    kinds = queries.schema[id_col].dataType.simpleString(), base.schema[base_id].dataType.simpleString()
    cand = left.groupBy("bl", "br").cogroup(right.groupBy("bl", "br")).applyInArrow(_topk_fn(k, metric, False), f"id {kinds[0]}, nbr {kinds[1]}, score double")
    return _merged(cand, k, metric)


def _threshold_fn(threshold: float):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id1": left.column("lid")[:0], "id2": left.column("lid")[:0], "cosine_similarity": pa.array([], pa.float64())})
        (lid, lv), (rid, rv) = _side(left, "lid", "lv"), _side(right, "rid", "rv")
        lcode, rcode = _codes(lid, rid)
        own = left.column("bl")[0] == left.column("br")[0]  # a block with itself holds every pair twice
        t = _Tiles(lv, rv, "cosine")
        found = []
        for a in range(0, len(t.left), STRIP):
            rows = t.left[a:a + STRIP]
            cut = t.floor(rows, np.full(len(rows), threshold))
            for c in range(0, len(t.right), TILE):
                cols = t.right[c:c + TILE]
                i, j = _near(t.tile(rows, cols) >= cut[:, None])
                i, j = rows[i], cols[j]
                if own:
                    once = lcode[i] < rcode[j]
                    i, j = i[once], j[once]
                s = t.exact(i, j)
                found.append((i[s >= threshold], j[s >= threshold], s[s >= threshold]))
        i, j, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        swap = pa.array(lcode[i] > rcode[j])
        first, second = lid.take(pa.array(i)), rid.take(pa.array(j))
        return pa.table({"id1": pc.if_else(swap, second, first), "id2": pc.if_else(swap, first, second), "cosine_similarity": pa.array(s)})
    return fn


def cosine_join(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, block_rows: int = 2048) -> DataFrame:
    """M5: all pairs ``id1 < id2`` with cosine similarity >= ``threshold``, exact."""
    nb = _blocks(vectors, vec_col, block_rows, JOIN_ROWS)
    prepared = _prepare(vectors, id_col, vec_col, "cosine", nb)
    lg, rg = _block_pairs(prepared, nb, upper=True)
    kind = vectors.schema[id_col].dataType.simpleString()
    return lg.cogroup(rg).applyInArrow(_threshold_fn(float(threshold)),
                                       f"id1 {kind}, id2 {kind}, cosine_similarity double")
