"""Language-model scoring by context-tree weighting over bytes.

Every byte is decomposed into 8 binary decisions.  For each decision (a prefix of the byte's bits) there is a tree whose
nodes are the contexts of 0 to ``depth`` preceding bytes, with a Krichevsky-Trofimov estimate in each node.  A node's
weighted probability is half its own estimate and half the product of its children's; the posterior of "stop here" along
the path of contexts mixes the estimates of all depths into one prediction.  Counts come from the training texts.

On Spark:

1. Blocks of texts list their distinct byte (depth + 1)-grams and words, with training counts, by bucket.  A bucket holds
   all grams whose last two context bytes it was dealt, so every node of depth 2 or more lies in one bucket.
2. Buckets sum the counts over all blocks and weight their subtrees up to depth 2.  What they pass on for depths 1 and 0
   is at most 65,536 rows, whatever the corpus; these are weighted and sent back.
3. Buckets answer every block with the log probability of each gram that it asked for, and the count of each word.
4. Texts and answers of a block meet, and the texts are scored.

Everything that grows with the corpus (grams, word counts, answers) moves through shuffles as packed lists; nothing of it
is broadcast or collected.  A text starts after ``depth`` marks and ends with one (byte 0xFF, which UTF-8 never uses).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, arrange, buckets, buffers, column, mix, pack, runs, slices, unpack
from tessera.session import reliable_checkpoint

DEPTH = 4
MARK = 0xFF
#: The hash that stands for the end of a text among words.
END = np.uint64(0x51ED270B1F3C5A77)
_LN2, _LN_PI = math.log(2), math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: the recurrence up to x + 8, then Stirling's series."""
    y, shift = x + 8, np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - _LN_PI


def byte_grams(col: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the lower-cased texts and the mark at their ends: (context bytes, byte) as one number, the byte
    lowest; and where the grams of each text begin."""
    raw, at = buffers(col)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    flat = np.full(len(raw) + (depth + 1) * n, MARK, U64)
    flat[np.arange(len(raw)) + depth * (row + 1) + row] = Words.LOWER[raw]
    code = np.zeros(max(len(flat) - depth, 0), U64)
    for i in range(depth + 1):
        code = (code << U64(8)) | flat[i : i + len(code)]
    ends = at + np.arange(n + 1)  # a mark more for each text
    inside = np.arange(len(raw) + n) + depth * np.repeat(np.arange(n), np.diff(ends))
    return code[inside], ends


def _nodes(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bit prefix) nodes of full depth, sorted, with their zeros and ones."""
    context, byte = gram >> U64(8), gram & U64(0xFF)
    keys, bits = [], []
    for k in range(8):
        keys.append((context << U64(8)) | (U64(1 << k) | (byte >> U64(8 - k))))
        bits.append((byte >> U64(7 - k)) & U64(1))
    key, index = np.unique(np.concatenate(keys), return_inverse=True)
    bit, n = np.concatenate(bits).astype(bool), np.tile(count, 8).astype(np.float64)
    ones = np.bincount(index, np.where(bit, n, 0), len(key))
    return key, np.bincount(index, n, len(key)) - ones, ones


class Level:
    """Nodes of one depth: sorted keys, counts, log weighted probability, and the posterior weight of stopping there."""

    def __init__(self, key, n0, n1, below=None):
        own = log_kt(n0, n1)
        self.key, self.n0, self.n1 = key, n0, n1
        self.weighted = own if below is None else np.logaddexp(own, below) - _LN2
        self.stop = np.ones(len(key)) if below is None else np.exp(own - _LN2 - self.weighted)

    def sums(self, depth: int) -> tuple:
        """By context of ``depth`` bytes: keys, summed counts, and the log product of the children's probabilities."""
        key, index = np.unique(self.key & U64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        total = lambda x: np.bincount(index, x, len(key)).astype(np.float64)
        return key, total(self.n0), total(self.n1), total(self.weighted)

    def parents(self, depth: int) -> Level:
        """The level of contexts of ``depth`` bytes above this one."""
        return Level(*self.sums(depth))


def subtree(gram: np.ndarray, count: np.ndarray, depth: int, top: int = 2) -> list[Level]:
    """Levels from ``depth`` up to ``top`` of the grams that were seen in training."""
    seen = count > 0
    levels = [Level(*_nodes(gram[seen], count[seen]))]
    for d in range(depth - 1, top - 1, -1):
        levels.append(levels[-1].parents(d))
    return levels


def log10_probability(gram: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 of the mixed probability of each gram's byte after its context; ``levels`` from depth 0 to full depth."""
    out = np.zeros(len(gram))
    context, byte = gram >> U64(8), gram & U64(0xFF)
    for k in range(8):
        prefix, one = U64(1 << k) | (byte >> U64(8 - k)), ((byte >> U64(7 - k)) & U64(1)).astype(bool)
        p, rest = np.zeros(len(gram)), np.ones(len(gram))
        for d, level in enumerate(levels):
            key = ((context & U64((1 << (8 * d)) - 1)) << U64(8)) | prefix
            at = np.minimum(np.searchsorted(level.key, key), max(len(level.key) - 1, 0))
            found = level.key[at] == key if len(level.key) else np.zeros(len(gram), bool)
            if len(level.key):
                n0, n1, stop = level.n0[at], level.n1[at], level.stop[at]
                kt = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
                p += np.where(found, rest * stop * kt, rest * 0.5)
                rest = np.where(found, rest * (1 - stop), 0.0)
            else:
                p, rest = p + rest * 0.5, np.zeros(len(gram))
        out += np.log10(p + rest * 0.5)
    return out


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    key, index = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(index, np.concatenate(counts).astype(np.float64), len(key)).astype(np.int64)


def _parts(block: int, n: int, lists: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A row for each bucket: lists by name are (bucket, key, count)."""
    cut = {}
    for name, (bucket, key, count) in lists.items():
        order = np.lexsort((key, bucket))
        ends = np.searchsorted(bucket[order], np.arange(n + 1))
        cut[name] = (key[order], count[order], ends)
    for b in range(n):
        cells = {}
        for name, (key, count, ends) in cut.items():
            i, j = ends[b], ends[b + 1]
            cells[name] = pack(key=key[i:j], n=count[i:j]) if j > i else None
        if any(cells.values()):
            yield {"bucket": b, "block": block, **cells}


def _read(cells: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for c in cells:
        t = unpack(c.as_py()) if c.is_valid else pa.table({"key": pa.array([], pa.uint64()), "n": pa.array([], pa.int64())})
        out.append((column(t, "key").to_numpy(), column(t, "n").to_numpy()))
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, n_buckets: int | None = None) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the log10 probability of the lower-cased text's bytes and its end, so -score / log10(2) / bytes is the
    code length per byte.  Null and empty texts consist of the end alone; a null id counts as an empty one when rows are
    held out; repeated rows stay and count as often; with no training rows every bit has probability 1/2; an empty table
    gives an empty result; other columns are not read.  Words are matched by a 64-bit hash."""
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7")
    spark, n = docs.sparkSession, buckets(docs, n_buckets)
    src = arrange(docs, {id_col: "id", text_col: "text"}).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "block", held_out(F.col("id")).alias("out"))
    kind = dict(src.dtypes)["id"]
    listed = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("words", pa.binary())])

    def ask(batches):
        for block, slices_of in runs(batches):
            grams, words = ([], []), ([], [])
            for b in slices_of:
                t = pa.Table.from_batches([b])
                train = ~column(t, "out").to_numpy(zero_copy_only=False)
                code, at = byte_grams(column(t, "text"), depth)
                w = Words(column(t, "text"), Words.SPACED)
                tokens = np.concatenate([w.hashes, np.full(len(w), END)])
                for (keys, counts), found, of in ((grams, code, np.repeat(train, np.diff(at))), (words, tokens, np.concatenate([np.repeat(train, np.diff(w.row_at)), train]))):
                    a, na = np.unique(found[of], return_counts=True)
                    o = np.unique(found[~of])
                    keys += [a, o]
                    counts += [na, np.zeros(len(o), np.int64)]
            (g, ng), (w, nw) = _sum_by_key(*grams), _sum_by_key(*words)
            deal = lambda x: (mix(x) % U64(n)).astype(np.int64)
            rows = list(_parts(block, n, {"grams": (deal((g >> U64(8)) & U64(0xFFFF)), g, ng), "words": (deal(w), w, nw)}))
            yield from pa.Table.from_pylist(rows, listed).to_batches()

    asked = reliable_checkpoint(src.mapInArrow(ask, "bucket int, block long, grams binary, words binary"))

    def climb(t: pa.Table) -> pa.Table:
        g, ng = _sum_by_key(*zip(*_read(t.column("grams")), strict=True))
        _, nw = _sum_by_key(*zip(*_read(t.column("words")), strict=True))
        key, n0, n1, below = subtree(g, ng, depth)[-1].sums(1)
        words = {"key": pa.array([-1], pa.int64()), "n0": [float(nw.sum())], "n1": [float((nw > 0).sum())], "below": [0.0]}
        return pa.concat_tables([pa.table({"key": key.astype(np.int64), "n0": n0, "n1": n1, "below": below}), pa.table(words)])

    tops = asked.groupBy("bucket").applyInArrow(climb, "key long, n0 double, n1 double, below double")
    found = tops.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).orderBy("key").toPandas()  # at most 65,537 rows
    total = found[found["key"] == -1]
    train_tokens, distinct = (int(total["n0"].iloc[0]), int(total["n1"].iloc[0])) if len(total) else (0, 0)
    found = found[found["key"] >= 0]
    one = Level(found["key"].to_numpy().astype(U64), found["n0"].to_numpy(), found["n1"].to_numpy(), found["below"].to_numpy())
    sent = spark.sparkContext.broadcast([one.parents(0), one])

    def answer(t: pa.Table) -> pa.Table:
        grams, words = _read(t.column("grams")), _read(t.column("words"))
        g, ng = _sum_by_key(*zip(*grams, strict=True))
        w, nw = _sum_by_key(*zip(*words, strict=True))
        p = log10_probability(g, [*sent.value, *reversed(subtree(g, ng, depth))], depth)
        cells = [pack(key=k, p=p[np.searchsorted(g, k)]) for k, _ in grams]
        counted = [pack(key=k, n=nw[np.searchsorted(w, k)]) for k, _ in words]
        return pa.table({"block": t.column("block"), "grams": pa.array(cells, pa.binary()), "words": pa.array(counted, pa.binary())})

    def shrink(batches):
        for block, parts in runs(batches):
            t = pa.Table.from_batches(parts)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(id=t.column("id"), text=t.column("text"), out=t.column("out"))], pa.binary())], ["block", "texts"])

    def lookup(cells: pa.ChunkedArray, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = [unpack(c.as_py()) for c in cells]
        key = np.concatenate([column(x, "key").to_numpy() for x in got])
        order = np.argsort(key, kind="stable")
        return key[order], np.concatenate([column(x, value).to_numpy() for x in got])[order]

    def measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
        gram, p = lookup(answers.column("grams"), "p")
        word, count = lookup(answers.column("words"), "n")
        gain = np.log10((count + 1) / (train_tokens + 1 * (distinct + 1)))
        out = []
        for cell in texts.column("texts"):
            for b in slices(unpack(cell.as_py()).to_batches()):
                t = pa.Table.from_batches([b])
                sums = lambda x, at: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[at])
                code, at = byte_grams(column(t, "text"), depth)
                scores = sums(p[np.searchsorted(gram, code)], at)
                w = Words(column(t, "text"), Words.SPACED)
                where, end = np.searchsorted(word, w.hashes), int(np.searchsorted(word, END))
                known = sums(count[where] > 0, w.row_at).astype(np.int64) + int(count[end] > 0)
                base = sums(gain[where], w.row_at) + gain[end]
                out.append(pa.table({
                    "id": t.column("id"), "held_out": t.column("out"), "n_tokens": np.diff(w.row_at).astype(np.int64) + 1, "n_known": known, "base_score": base, "score": scores}))
        return pa.concat_tables(out)

    answered = asked.groupBy("bucket").applyInArrow(answer, "block long, grams binary, words binary")
    shrunk = src.mapInArrow(shrink, "block long, texts binary")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = shrunk.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(measure, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
