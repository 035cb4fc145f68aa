"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of ``window`` consecutive item words (an item with fewer words is one window).  A document contains a
window only if it contains all of its shingles, so it is enough to look for one: the necessary prefix of a window is its
rarest shingle, by counts over all documents.  An occurrence of that shingle at word p of a document fixes where the window
would begin; bounds on that position and on the length are tested first, then the words are compared one by one, by their
hashes and at last by their bytes.

The benchmark side is the small one.  It is cut by a hash of the item into parts of at most ``PART_BYTES`` of text, so
what is sent to the executors is bounded for a benchmark of any size; documents pass all parts one after the other, whole
and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, column, same_spans, shingle_hashes, slices

WINDOW, SHINGLE = 10, 3
#: Benchmark text in one part, and candidates that a task compares at a time.
PART_BYTES, AT_ONCE = 8 << 20, 1 << 20


@dataclass
class Part:
    """Windows of one part of the benchmark."""

    names: list[str]
    #: words of all items; by window: its first word there, its length and its item
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    item: np.ndarray
    #: by shingle width: sorted shingles, and for each of them which windows (from - to) have it where
    tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: the items' bytes, and where the words lie in them
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return shingle_hashes(words, k) if len(words) >= k else np.empty(0, U64)


def _windows(rows: list, window: int) -> tuple[list[str], Words, np.ndarray, np.ndarray, np.ndarray]:
    w = Words(pa.array([r["text"] for r in rows], pa.string()), Words.LETTERS)
    named: dict[str, int] = {}
    first, size, item = [], [], []
    for i, r in enumerate(rows):
        a, b = int(w.row_at[i]), int(w.row_at[i + 1])
        if b > a:
            n = min(window, b - a)
            first.append(np.arange(a, b - n + 1))
            size.append(np.full(b - a - n + 1, n))
            item.append(np.full(b - a - n + 1, named.setdefault(r["item_id"] or "", len(named))))
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return list(named), w, join(first), join(size), join(item)


def _count(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each wanted shingle occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        total = {k: np.zeros(len(t), np.int64) for k, t in sent.value.items()}
        for b in slices(batches):
            w = Words(column(pa.Table.from_batches([b]), "text"), Words.LETTERS)
            for k, t in sent.value.items():
                s = _shingles(w.hashes, k)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                total[k] += np.bincount(at[t[at] == s], minlength=len(t))
        for k, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k), pa.int32()), pa.array(found, pa.int32()), pa.array(n[found])], ["k", "i", "n"])

    out = {k: np.zeros(len(t), np.int64) for k, t in wanted.items()}
    for r in docs.select("text").mapInArrow(count, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # at most a row for each shingle of the part
        out[r["k"]][r["i"]] = r["n"]
    sent.destroy()
    return out


def _index(docs: DataFrame, rows: list, window: int, shingle: int) -> Part:
    names, w, first, size, item = _windows(rows, window)
    words = w.hashes
    width = np.minimum(size, shingle)
    by_width = {int(k): shingle_hashes(words, int(k)) for k in np.unique(width)}
    wanted = {k: np.unique(s) for k, s in by_width.items()}
    counts = _count(docs, wanted)
    tokens = {}
    for k, s in by_width.items():
        own = np.flatnonzero(width == k)
        n = counts[k][np.searchsorted(wanted[k], s)]
        best, at = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
        for off in range(int(size[own].max()) - k + 1):  # the rarest shingle of each window, the first of equals
            fits = off <= size[own] - k
            here = np.where(fits, n[np.minimum(first[own] + off, len(n) - 1)], np.iinfo(np.int64).max)
            at = np.where(here < best, off, at)
            best = np.minimum(best, here)
        token = s[first[own] + at]
        order = np.argsort(token, kind="stable")
        distinct, begin = np.unique(token[order], return_index=True)
        tokens[k] = (distinct, np.append(begin, len(order)), own[order], at[order])
    return Part(names, words, first, size, item, tokens, w.data, w.starts, w.ends)


def _occurrences(part: Part, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and window numbers of all occurrences of the part's windows in the texts."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k, (token, to, window, offset) in part.tokens.items():
        s = _shingles(w.hashes, k)
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        place = np.flatnonzero(token[at] == s)
        each = to[at[place] + 1] - to[at[place]]
        total = np.concatenate([[0], np.cumsum(each)])
        cut = 0
        while cut < len(place):  # a frequent shingle may stand for many windows
            end = max(cut + 1, int(np.searchsorted(total, total[cut] + AT_ONCE, side="right")) - 1)
            p = np.repeat(place[cut:end], each[cut:end])
            e = np.arange(total[end] - total[cut]) - np.repeat(total[cut:end] - total[cut], each[cut:end]) + np.repeat(to[at[place[cut:end]]], each[cut:end])
            begin, win = p - offset[e], window[e]
            doc = np.searchsorted(w.row_at, p, side="right") - 1
            keep = (begin >= w.row_at[doc]) & (begin + part.size[win] <= w.row_at[doc + 1])
            begin, win = begin[keep], win[keep]
            for j in range(int(part.size[win].max()) if len(win) else 0):
                last = part.size[win] - 1
                same = w.hashes[begin + np.minimum(j, last)] == part.words[part.first[win] + np.minimum(j, last)]
                begin, win = begin[same], win[same]
            for j in range(int(part.size[win].max()) if len(win) else 0):
                last = part.size[win] - 1
                d, i = begin + np.minimum(j, last), part.first[win] + np.minimum(j, last)
                same = same_spans(w.data, w.starts[d], w.ends[d], part.data, part.starts[i], part.ends[i])
                begin, win = begin[same], win[same]
            found.append((begin, win))
            cut = end
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` with, in front, ``n_words``, ``hit_spans`` (bounds of the word runs that lie in occurrences
    of windows: first, end, first, end, ...) and ``items`` (ids, as strings, of the items of those windows, each once).

    ``benchmark`` has item_id and text.  Words are runs of digits, a-z and what is not ASCII, after lower-casing A-Z.
    Null texts have no words; an item without words has no window; items of equal id count as one, a null id as an empty
    string; an empty benchmark hits nothing; repeated rows stay; of columns that have one of the new names, the new one
    stays."""
    new = ["n_words", "hit_spans", "items"]
    rest = [c for c in docs.columns if c not in new]
    text = F.col(f"`{text_col}`")
    others = [c for c in rest if c != text_col or dict(docs.dtypes)[c] != "string"]  # a text that is a string is sent to the workers once
    if not others:
        others = rest
    src = docs.select(
        (F.coalesce(text.cast("string"), F.lit("")) if len(others) == len(rest) else text).alias("text"), F.lit(None).cast("array<int>").alias("hit_spans"),
        F.array().cast("array<string>").alias("items"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    schema = f"text string, hit_spans array<int>, items array<string>, row {src.schema['row'].dataType.simpleString()}, n_words long"
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))

    out = src.withColumn("n_words", F.lit(0).cast("long"))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()  # one part of the benchmark
        sent = docs.sparkSession.sparkContext.broadcast(_index(src, rows, window, shingle))

        def match(batches, sent=sent):
            part = sent.value
            for b in slices(batches):
                t = pa.Table.from_batches([b])
                w = Words(column(t, "text"), Words.LETTERS)
                begin, win = _occurrences(part, w)
                up, down = np.zeros(len(w.hashes) + 1, np.int64), np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(up, begin, 1)
                np.add.at(down, begin + part.size[win], 1)
                before = t.column("hit_spans").to_pylist()
                spans, names = [None] * len(w), t.column("items").to_pylist()
                doc = np.searchsorted(w.row_at, begin, side="right") - 1
                for d, it in np.unique(np.stack([doc, part.item[win]], 1), axis=0).tolist():
                    names[d].append(part.names[it])
                for d in np.unique(doc).tolist():
                    names[d] = list(dict.fromkeys(names[d]))  # an item's texts may lie in several parts
                for d in {*doc.tolist(), *(d for d, x in enumerate(before) if x)}:
                    a, e = int(w.row_at[d]), int(w.row_at[d + 1])
                    change = up[a:e] - down[a:e]
                    change[:1] = up[a:e][:1]  # what ends there is the text's before
                    hit = np.append(np.cumsum(change) > 0, False)
                    for s, f in zip((before[d] or [])[::2], (before[d] or [])[1::2], strict=True):
                        hit[s:f] = True
                    spans[d] = np.flatnonzero(np.diff(np.concatenate([[False], hit]))).tolist()
                cols = [t.column("text"), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), t.column("row"), pa.array(np.diff(w.row_at), pa.int64())]
                yield from pa.table(cols, ["text", "hit_spans", "items", "row", "n_words"]).to_batches()

        out = out.mapInArrow(match, schema)
    return out.select("n_words", F.coalesce("hit_spans", F.array().cast("array<int>")).alias("hit_spans"), "items", *[(F.col(f"row.`{c}`") if c in others else F.col("text")).alias(c) for c in rest])


def n_hit(spans):
    """Words in the runs that ``hit_spans`` bounds."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")
