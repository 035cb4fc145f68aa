"""Randomised SVD (D4) of a long-form matrix whose dense blocks no process should hold.

Documents are dealt to blocks of about ``BLOCK_VALUES / l`` entries, terms to as many blocks, both by hash.  A document block keeps its
entries as packed arrays in one row; a term block keeps its terms and which of them each document block holds.  A power step is

    term block  -> rows of Z that a document block needs (packed bytes, one row per pair of blocks)
    doc block   -> Y = A Z;  R of Y = QR;  its part of A^T Y, split by term block
    term block  -> sum of the parts

so that what moves is the rows of Z at the terms a block has, once in each direction, and a task holds one block.  Y stays in its
block and isn't orthonormalised there: with ``Y = Q S V^T`` from the blocks' R factors (l x l, the only thing the driver gets)
``A^T Q = (A^T Y) V S^-1``, which is applied when Z is sent next.

A term with a single entry, in document d with weight w, adds only ``w^2 Q[d]`` to ``Y[d]``: such terms never leave their block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

BLOCK_VALUES = 1 << 25  # entries times columns of a block, which bounds its rows of Z
CHUNK_VALUES = 1 << 22  # values of entries times columns that are multiplied at once


def _rows(data: bytes, l: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, l)


def _sums(n: int, to: np.ndarray, at: np.ndarray, w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(n, l): the sums of ``w * z[at]`` by ``to``, which is sorted."""
    out = np.zeros((n, z.shape[1]))
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(to)]
    step, a = max(1, CHUNK_VALUES // z.shape[1]), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, side="right")))
        s, e = starts[a], ends[b - 1]
        out[to[starts[a:b]]] = np.add.reduceat(z[at[s:e]] * w[s:e, None], starts[a:b] - s, axis=0)
        a = b
    return out


class _DocBlock:
    """The entries of a document block, by document and by term."""

    def __init__(self, row: dict, kept: np.ndarray | None):
        self.n = row["n"]
        doc, term = np.frombuffer(row["doc"], np.int32), np.frombuffer(row["at"], np.int32)
        w = np.frombuffer(row["w"], np.float64)
        self.tptr = np.frombuffer(row["tptr"], np.int64)
        self.all = doc, term, w
        if kept is not None:
            self.kept = kept
            self.place = np.cumsum(kept) - 1
            self.size = int(kept.sum())
            inside = kept[term]
            self.doc, self.at, self.w = doc[inside], self.place[term[inside]], w[inside]
            self.lone = np.bincount(doc[~inside], w[~inside] ** 2, self.n)

    def times(self, z: np.ndarray) -> np.ndarray:
        return _sums(self.n, self.doc, self.at, self.w, z)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        order = np.argsort(self.at, kind="stable")
        return _sums(self.size, self.at[order], self.doc[order], self.w[order], y)


def _pack_docs(blocks: int, kind: str):
    def fn(t: pa.Table) -> pa.Table:
        """One row for a document block: its documents, its terms in the order of their blocks, its entries by document."""
        ids = t.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        words = t.column("term").combine_chunks().dictionary_encode(null_encoding="encode")
        doc, term = ids.indices.to_numpy(), words.indices.to_numpy()
        first = np.zeros(len(words.dictionary), np.int64)
        first[term] = np.arange(len(term))
        h = t.column("h").to_numpy()[first]
        tb = np.mod(h, blocks)
        order = np.argsort(tb, kind="stable")
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order))
        count = np.bincount(new[term], minlength=len(order)).astype(np.int32)
        by = np.argsort(doc, kind="stable")
        row = {"b": [t.column("b")[0].as_py()], "n": [len(ids.dictionary)], "docs": pa.ListArray.from_arrays(pa.array([0, len(ids.dictionary)], pa.int32()), ids.dictionary),
               "terms": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), words.dictionary.take(pa.array(order))),
               "h": [h[order].astype(np.int64).tobytes()], "df": [count.tobytes()], "tptr": [np.searchsorted(tb[order], np.arange(blocks + 1)).astype(np.int64).tobytes()],
               "doc": [doc[by].astype(np.int32).tobytes()], "at": [new[term[by]].astype(np.int32).tobytes()], "w": [t.column("w").to_numpy()[by].astype(np.float64).tobytes()]}
        return pa.table({"b": pa.array(row["b"], pa.int32()), "n": pa.array(row["n"], pa.int32()), "docs": row["docs"], "terms": row["terms"],
                         **{c: pa.array(row[c], pa.binary()) for c in ("h", "df", "tptr", "doc", "at", "w")}})
    return fn, f"b int, n int, docs array<{kind}>, terms array<string>, h binary, df binary, tptr binary, doc binary, at binary, w binary"


def _needs(batches):
    """(t, b, terms, df): the terms of a document block in each term block."""
    for batch in batches:
        for i in range(batch.num_rows):
            tptr = np.frombuffer(batch.column("tptr")[i].as_py(), np.int64)
            terms, df = batch.column("terms")[i].values, np.frombuffer(batch.column("df")[i].as_py(), np.int32)
            for t in np.flatnonzero(np.diff(tptr)):
                s, e = int(tptr[t]), int(tptr[t + 1])
                part = terms.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), batch.column("b").slice(i, 1),
                                                  pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), pa.concat_arrays([part])), pa.array([df[s:e].tobytes()], pa.binary())], ["t", "b", "terms", "df"])


def _pack_terms(table: pa.Table) -> pa.Table:
    """One row for a term block: its terms of two entries or more, and where the terms of each document block are among them (-1:
    a single entry)."""
    lists = table.column("terms").combine_chunks()
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    total = np.bincount(words.indices.to_numpy(), np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("df")]), len(words.dictionary))
    kept = total >= 2
    place = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)[words.indices.to_numpy()]
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
    mine = words.dictionary.filter(pa.array(kept))
    return pa.table({"t": table.column("t").slice(0, 1), "terms": pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine),
                     "to": pa.array([table.column("b").to_numpy().astype(np.int32).tobytes()], pa.binary()), "ptr": pa.array([at.tobytes()], pa.binary()),
                     "place": pa.array([place.tobytes()], pa.binary())})


_MESSAGE = "b int, t int, kept binary, z binary"
_STATE = "t int, data binary, gram binary"


def _send(l: int, m: np.ndarray | None):
    """Term blocks (with their sums, if there are any yet) to messages for document blocks."""
    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                to, ptr, place = (np.frombuffer(batch.column(c)[i].as_py(), d) for c, d in (("to", np.int32), ("ptr", np.int64), ("place", np.int32)))
                z = None if m is None else _rows(batch.column("data")[i].as_py(), l) @ m
                for j, b in enumerate(to):
                    at = place[ptr[j]:ptr[j + 1]]
                    data = b"" if z is None else z[at[at >= 0]].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), batch.column("t").slice(i, 1), pa.array([(at >= 0).tobytes()], pa.binary()),
                                                      pa.array([data], pa.binary())], ["b", "t", "kept", "z"])
    return fn


def _step(l: int, m: np.ndarray | None, seed: int):
    """A document block and its messages to Y (at ``-1 - b``, with R and the Gram of its lone terms) and parts of A^T Y."""
    from tessera.operators.reduce import gaussian_block

    def fn(own: pa.Table, got: pa.Table) -> pa.Table:
        row = {c: own.column(c)[0].as_py() for c in own.column_names}
        t = got.column("t").to_numpy()
        order = [i for i in np.argsort(t, kind="stable") if t[i] >= 0]
        kept = np.concatenate([np.frombuffer(got.column("kept")[int(i)].as_py(), np.bool_) for i in order])
        block = _DocBlock(row, kept)
        if m is None:
            h = np.frombuffer(row["h"], np.int64)
            doc, term, w = block.all
            y = np.zeros((block.n, l))
            step = max(1, CHUNK_VALUES // l)
            for a in range(0, len(h), step):  # a strip of terms at a time
                inside = (term >= a) & (term < a + step)
                y += _sums(block.n, doc[inside], term[inside] - a, w[inside], gaussian_block(h[a:a + step], l, seed))
        else:
            z = np.concatenate([_rows(got.column("z")[int(i)].as_py(), l) for i in order])
            before = _rows(got.column("z")[int(np.flatnonzero(t < 0)[0])].as_py(), l)
            y = block.times(z) + block.lone[:, None] * (before @ m)
        part = block.transposed(y)
        ends = np.r_[0, np.cumsum(kept)][block.tptr]
        r = np.linalg.qr(y, mode="r")
        gram = np.concatenate([r.reshape(-1), (y.T @ (y * block.lone[:, None])).reshape(-1)])
        out = [(-1 - row["b"], y.tobytes(), gram.tobytes(), b"")]
        for j in np.flatnonzero(np.diff(block.tptr)):
            places = kept[block.tptr[j]:block.tptr[j + 1]]
            out.append((int(j), part[ends[j]:ends[j + 1]].tobytes(), b"", np.int32(row["b"]).tobytes() + places.tobytes()))
        return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate((("t", pa.int32()), ("data", pa.binary()), ("gram", pa.binary()), ("place", pa.binary())))})
    return fn


def _collect_parts(l: int):
    """The sums of a term block's parts; Y of a document block goes through."""
    def fn(own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows:
            return got.select(["t", "data", "gram"])
        to, ptr, place = (np.frombuffer(own.column(c)[0].as_py(), d) for c, d in (("to", np.int32), ("ptr", np.int64), ("place", np.int32)))
        where = {int(b): j for j, b in enumerate(to)}
        total = np.zeros((int(place.max(initial=-1)) + 1, l))
        parts = sorted((int(np.frombuffer(got.column("place")[i].as_py()[:4], np.int32)[0]), i) for i in range(got.num_rows))
        for b, i in parts:  # in one order, so that sums don't depend on arrival
            at = place[ptr[where[b]]:ptr[where[b] + 1]]
            total[at[at >= 0]] += _rows(got.column("data")[i].as_py(), l)
        return pa.table({"t": own.column("t").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary()), "gram": pa.array([(total.T @ total).tobytes()], pa.binary())})
    return fn


def _whitening(rs: list[np.ndarray]) -> np.ndarray:
    """V S^-1 of the whole Y from the R factors of its blocks; directions of no size get zeros."""
    _, s, vt = np.linalg.svd(np.linalg.qr(np.concatenate(rs), mode="r"), full_matrices=False)
    return vt.T * np.where(s > 1e-12 * max(s[0], 1e-300), 1.0 / np.where(s > 0, s, 1.0), 0.0)


def _extremes(keys: pa.Array, x: np.ndarray) -> list[tuple]:
    """(column, size, key, value) of each column's entry of largest absolute value, ties: the smallest key."""
    if not len(x):
        return []
    size = np.abs(np.round(x, 12))
    found = []
    for j, top in enumerate(size.max(0)):
        names = [(keys[int(i)].as_py() or "", int(i)) for i in np.flatnonzero(size[:, j] == top)]
        key, i = min(names)
        found.append((j, float(top), key, float(x[i, j])))
    return found


def _extreme_frame(rows: list[tuple]):
    kinds = (("j", pa.int32()), ("size", pa.float64()), ("key", pa.string()), ("x", pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [c for c, _ in kinds])


def block_svd(a: DataFrame, k: int, l: int, n_iter: int, seed: int):
    """Singular values, term loadings ``(term, comp)`` and document scores ``(doc_id, reduced)`` of ``a`` = (doc_id, term, w)."""
    from tessera.operators.reduce import spark_parallelism

    blocks = max(math.ceil(a.count() * l / BLOCK_VALUES), min(spark_parallelism(a), 4))
    kind = a.schema["doc_id"].dataType.simpleString()
    pack, schema = _pack_docs(blocks, kind)
    rows = a.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("b"), "doc_id", "term", "w", F.xxhash64("term").alias("h"))
    docs = reliable_checkpoint(rows.groupBy("b").applyInArrow(pack, schema))
    needs = docs.select("b", "terms", "df", "tptr").mapInArrow(_needs, "t int, b int, terms array<string>, df binary")
    terms = reliable_checkpoint(needs.groupBy("t").applyInArrow(_pack_terms, "t int, terms array<string>, to binary, ptr binary, place binary"))
    routes = terms.select("t", "to", "ptr", "place")
    entries = docs.select("b", "n", "h", "tptr", "doc", "at", "w")

    state, m = None, None
    for _ in range(n_iter + 1):
        if state is None:
            messages = routes.mapInArrow(_send(l, None), _MESSAGE)
            own = entries
        else:
            messages = routes.join(state.where("t >= 0").select("t", "data"), "t").mapInArrow(_send(l, m), _MESSAGE)
            ys = state.where("t < 0").select((F.lit(-1) - F.col("t")).cast("int").alias("b"), F.lit(-1).alias("t"), F.lit(b"").alias("kept"), F.col("data").alias("z"))
            messages = messages.unionByName(ys)
            own = entries.withColumn("h", F.lit(b""))
        parts = own.groupBy("b").cogroup(messages.groupBy("b")).applyInArrow(_step(l, m, seed), f"{_STATE}, place binary")
        state = reliable_checkpoint(routes.groupBy("t").cogroup(parts.groupBy("t")).applyInArrow(_collect_parts(l), _STATE))
        grams = [(r.t, np.frombuffer(bytes(r.gram), np.float64)) for r in state.select("t", "gram").collect()]  # a few l x l for each block
        m = _whitening([_own_r(g, l) for t, g in sorted(grams, key=lambda x: x[0]) if t < 0])

    # B B^T of B = Q^T A: the terms of the term blocks, and the lone ones of the document blocks
    g = sum(x[1].reshape(l, l) if x[0] >= 0 else x[1][-l * l:].reshape(l, l) for x in sorted(grams, key=lambda x: x[0]))
    evals, evecs = np.linalg.eigh(m.T @ g @ m)
    order = np.argsort(evals)[::-1][:k]
    svals = np.sqrt(np.maximum(evals[order], 0.0))
    ub = evecs[:, order]
    mu = m @ ub
    ub = ub * _signs(terms, docs, state, l, mu)[None, :]
    inv = np.where(svals > 0, 1.0 / np.where(svals > 0, svals, 1.0), 0.0)
    return svals, _loadings(terms, docs, state, l, m @ (ub * inv[None, :])), _scores(docs, state, l, m @ (ub * svals[None, :]), kind)


def _own_r(g: np.ndarray, l: int) -> np.ndarray:
    return g[:-l * l].reshape(-1, l)


def _with_y(docs: DataFrame, state: DataFrame) -> DataFrame:
    return docs.join(state.where("t < 0").select((F.lit(-1) - F.col("t")).cast("int").alias("b"), "data"), "b")


def _lone(batch: pa.RecordBatch, i: int, l: int, m: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of one entry in the whole corpus that a document block holds (marked in ``lone``), and their rows of A^T Y m."""
    doc, at = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("doc", "at"))
    w, lone = np.frombuffer(batch.column("w")[i].as_py(), np.float64), np.frombuffer(batch.column("lone")[i].as_py(), np.bool_)
    y = _rows(batch.column("data")[i].as_py(), l) @ m
    inside = np.flatnonzero(lone[at])
    return batch.column("terms")[i].values.take(pa.array(at[inside])), y[doc[inside]] * w[inside, None]


def _marked(terms: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """Document blocks with Y and a mark for each of their terms that has no other entry."""
    def fn(own: pa.Table, got: pa.Table) -> pa.Table:
        t = got.column("t").to_numpy()
        kept = np.concatenate([np.frombuffer(got.column("kept")[int(i)].as_py(), np.bool_) for i in np.argsort(t, kind="stable")])
        return own.append_column("lone", pa.array([(~kept).tobytes()], pa.binary()))

    messages = terms.select("t", "to", "ptr", "place").mapInArrow(_send(1, None), _MESSAGE)
    own = _with_y(docs.select("b", "terms", "doc", "at", "w"), state)
    return own.groupBy("b").cogroup(messages.groupBy("b")).applyInArrow(fn, "b int, terms array<string>, doc binary, at binary, w binary, data binary, lone binary")


def _signs(terms: DataFrame, docs: DataFrame, state: DataFrame, l: int, m: np.ndarray) -> np.ndarray:
    """+1 or -1 for each component, so that the term entry of largest absolute value (ties: the smallest term) is positive."""
    def shared(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _extreme_frame(_extremes(batch.column("terms")[i].values, _rows(batch.column("data")[i].as_py(), l) @ m))

    def lone(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _extreme_frame(_extremes(*_lone(batch, i, l, m)))

    schema = "j int, size double, key string, x double"
    both = terms.select("t", "terms").join(state.where("t >= 0").select("t", "data"), "t").mapInArrow(shared, schema)
    rows = both.unionByName(_marked(terms, docs, state).mapInArrow(lone, schema)).collect()  # a row for each block and component
    best: dict = {}
    for r in rows:
        if r.j not in best or (-r.size, r.key) < best[r.j][:2]:
            best[r.j] = (-r.size, r.key, r.x)
    return np.array([1.0 if best[j][2] >= 0 else -1.0 for j in range(m.shape[1])])


def _vectors(names: pa.Array, x: np.ndarray, key: str, out: str) -> pa.RecordBatch:
    ptr = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.RecordBatch.from_arrays([pa.concat_arrays([names]), pa.ListArray.from_arrays(ptr, pa.array(np.ascontiguousarray(x).reshape(-1)))], [key, out])


def _loadings(terms: DataFrame, docs: DataFrame, state: DataFrame, l: int, m: np.ndarray) -> DataFrame:
    def shared(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _vectors(batch.column("terms")[i].values, _rows(batch.column("data")[i].as_py(), l) @ m, "term", "comp")

    def lone(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _vectors(*_lone(batch, i, l, m), "term", "comp")

    schema = "term string, comp array<double>"
    both = terms.select("t", "terms").join(state.where("t >= 0").select("t", "data"), "t").mapInArrow(shared, schema)
    return both.unionByName(_marked(terms, docs, state).mapInArrow(lone, schema))


def _scores(docs: DataFrame, state: DataFrame, l: int, m: np.ndarray, kind: str) -> DataFrame:
    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _vectors(batch.column("docs")[i].values, _rows(batch.column("data")[i].as_py(), l) @ m, "doc_id", "reduced")

    return _with_y(docs.select("b", "docs"), state).select("b", "docs", "data").mapInArrow(fn, f"doc_id {kind}, reduced array<double>")
