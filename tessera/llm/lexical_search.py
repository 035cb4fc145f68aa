"""Ranked lexical search through bags of words that documents share.

1. Items (the queries) are few words each; their vocabulary goes to the tasks, in parts of bounded size.
2. One pass over the documents counts N, L and, for the words of the vocabulary, document frequencies.
3. A document matters only through its bag: its counts of vocabulary words and m, a number of its length.  Bags are written
   as bytes; documents are dealt by the bag's hash and sorted by the bag's bytes and the id, so that equal bags are verified
   and lie next to one another.  Before the shuffle every task keeps, of each of its bags, the ``top`` smallest ids only, as
   no others can be in a list of ``top``.
4. A task scores each distinct bag once against all items, blocks of bags at a time, and expands bags by ascending id into
   its ``top`` lists; the lists of tasks are merged in two levels.

Everything in 4 is exact: impacts are integers below 2**53.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, arrange, column, slices
from tessera.session import reliable_checkpoint

TOP = 50
#: Bytes of items in one part, documents' bags that a task gathers before it sends them, and bags scored at a time.
PART_BYTES, HELD_BYTES, BLOCK = 4 << 20, 32 << 20, 4096
#: What stands for a null id: it comes last.
NO_ID = np.iinfo(np.int64).max
#: Parts into which the lists of one item are dealt for the first level of merging.
SALTS = 16


@dataclass
class Part:
    """Items of one part: the vocabulary, and the words of item i, words[at[i]:at[i + 1]]."""

    vocabulary: pa.Array
    words: np.ndarray
    at: np.ndarray


def _part(texts: list[str]) -> Part:
    w = Words(pa.array(texts, pa.string()), Words.LETTERS)
    coded = w.listed().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = [np.unique(index[w.row_at[i] : w.row_at[i + 1]]) for i in range(len(w))]
    return Part(coded.dictionary, np.concatenate([*own, np.empty(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64))


def _found(w: Words, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vocabulary numbers of the words that are in the vocabulary."""
    index = pc.index_in(w.listed(), value_set=vocabulary)
    known = np.flatnonzero(index.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(w)), np.diff(w.row_at))
    return row[known], index.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(src: DataFrame, sent) -> dict[int, int]:
    """Documents that hold each vocabulary word; at -1 the documents with words, at -2 all words with repeats."""
    def count(batches):
        vocabulary = sent.value.vocabulary
        total = np.zeros(len(vocabulary) + 2, np.int64)
        for b in slices(batches):
            w = Words(column(pa.Table.from_batches([b]), "text"), Words.LETTERS)
            row, word = _found(w, vocabulary)
            once = np.unique(row * max(len(vocabulary), 1) + word) % max(len(vocabulary), 1)
            total[: len(vocabulary)] += np.bincount(once, minlength=len(vocabulary))[: len(vocabulary)]
            total[-1] += (np.diff(w.row_at) > 0).sum()
            total[-2] += len(w.starts)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(found < len(vocabulary), found, found - len(total))), pa.array(total[found])], ["word", "n"])

    rows = src.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the part
    return {r["word"]: r["n"] for r in rows}


def word_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def bags(src: DataFrame, sent, n: int, length: int, top: int) -> DataFrame:
    """(bag, ids) of the documents that hold a vocabulary word.  A bag is m (8 bytes), the bytes of a count, word numbers
    and counts; ids are those of some of its documents, the smallest, at most ``top`` (8 bytes each)."""
    def gather(batches):
        vocabulary = sent.value.vocabulary
        held: dict[bytes, list[int]] = {}
        size = 0

        def send():
            rows = [(bag, np.sort(-np.array(ids, np.int64)).tobytes()) for bag, ids in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["bag", "ids"])

        for b in slices(batches):
            t = pa.Table.from_batches([b])
            w = Words(column(t, "text"), Words.LETTERS)
            ids = column(t, "id").fill_null(NO_ID).to_numpy()
            row, word = _found(w, vocabulary)
            each, count = np.unique(row * max(len(vocabulary), 1) + word, return_counts=True)
            row, word = each // max(len(vocabulary), 1), (each % max(len(vocabulary), 1)).astype("<u4")
            begin = np.searchsorted(row, np.arange(len(w) + 1)).tolist()
            for i in np.unique(row).tolist():
                own, tf = word[begin[i] : begin[i + 1]], count[begin[i] : begin[i + 1]]
                kind = "<u1" if tf.max() < 1 << 8 else "<u4"
                m = 100 - 50 + (50 * int(w.row_at[i + 1] - w.row_at[i]) * n) // length
                bag = m.to_bytes(8, "little") + bytes([int(kind[2])]) + own.tobytes() + tf.astype(kind).tobytes()
                if (listed := held.get(bag)) is None:
                    held[bag] = [-int(ids[i])]  # a heap whose root is the largest id
                    size += len(bag) + 200
                elif len(listed) < top:
                    heapq.heappush(listed, -int(ids[i]))
                    size += 40
                else:
                    heapq.heappushpop(listed, -int(ids[i]))
            if size > HELD_BYTES:
                yield send()
                held.clear()
                size = 0
        if held:
            yield send()

    return src.select("id", "text").mapInArrow(gather, "bag binary, ids binary")


def _read_bag(bag: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    width = bag[8]
    n = (len(bag) - 9) // (4 + width)
    return int.from_bytes(bag[:8], "little"), np.frombuffer(bag, "<u4", n, 9), np.frombuffer(bag, f"<u{width}", n, 9 + 4 * n)


class Lists:
    """The ``top`` best (score, id) of every item so far, by score down and id up."""

    def __init__(self, part: Part, weight: np.ndarray, top: int):
        self.part, self.weight, self.top = part, weight, top
        none = np.empty(0, np.int64)
        self.score, self.id = [none] * (len(part.at) - 1), [none] * (len(part.at) - 1)

    def add(self, listed: list[tuple[bytes, np.ndarray]]) -> None:
        """Scores distinct bags with their ascending ids, once for every item, and expands those that can be in a list."""
        if not listed:
            return
        read = [_read_bag(bag) for bag, _ in listed]
        sizes = np.fromiter((len(x[1]) for x in read), np.int64, len(read))
        owner = np.repeat(np.arange(len(read)), sizes)
        word, tf = np.concatenate([x[1] for x in read]).astype(np.int64), np.concatenate([x[2].astype(np.int64) for x in read])
        m = np.array([x[0] for x in read], np.int64)
        order = np.argsort(word, kind="stable")
        word, owner, tf = word[order], owner[order], tf[order]
        impact = (self.weight[word] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))).astype(np.float64)
        begin = np.searchsorted(word, np.arange(len(self.weight) + 1))
        first = np.array([ids[0] for _, ids in listed], np.int64)
        for item in range(len(self.part.at) - 1):
            words = self.part.words[self.part.at[item] : self.part.at[item + 1]]
            spans = [(i, j) for i, j in zip(begin[words].tolist(), begin[words + 1].tolist(), strict=True) if j > i]
            if not spans:
                continue
            total = np.bincount(np.concatenate([owner[i:j] for i, j in spans]), np.concatenate([impact[i:j] for i, j in spans]), len(read))
            full = len(self.score[item]) == self.top
            least, last = (self.score[item][-1], self.id[item][-1]) if full else (1, NO_ID)
            able = np.flatnonzero(total >= max(least, 1))
            score = total[able].astype(np.int64)
            if full:
                fits = (score > least) | (first[able] < last)
                able, score = able[fits], score[fits]
            if not len(able):
                continue
            best = np.lexsort((first[able], -score))[: self.top]  # a bag behind ``top`` others is behind ``top`` documents
            ids = [listed[c][1] for c in able[best].tolist()]
            scores = np.concatenate([self.score[item], np.repeat(score[best], [len(x) for x in ids])])
            ids = np.concatenate([self.id[item], *ids])
            keep = np.lexsort((ids, -scores))[: self.top]
            self.score[item], self.id[item] = scores[keep], ids[keep]


def _search_part(src: DataFrame, rows: list, item_type: T.DataType, top: int) -> DataFrame:
    spark = src.sparkSession
    part = _part([r["text"] for r in rows])
    sent = spark.sparkContext.broadcast(part)
    counted = _frequencies(src, sent)
    n, length = counted.get(-1, 0), max(counted.get(-2, 0), 1)
    weight = word_weights(np.array([counted.get(i, 0) for i in range(len(part.vocabulary))], np.int64), n)
    weights = spark.sparkContext.broadcast(weight)

    def search(batches):
        lists, block, bag, ids = Lists(sent.value, weights.value, top), [], None, []

        def close():
            if bag is not None:
                block.append((bag, np.sort(np.concatenate(ids))[:top]))

        for b in batches:
            for cell, own in zip(b.column(0), b.column(1), strict=True):
                if (new := cell.as_py()) != bag:
                    close()
                    bag, ids = new, []
                    if len(block) >= BLOCK:
                        lists.add(block)
                        block.clear()
                ids.append(np.frombuffer(own.as_py(), "<i8"))
                if len(ids) > 64:
                    ids = [np.sort(np.concatenate(ids))[:top]]
        close()
        lists.add(block)
        size = [len(x) for x in lists.id]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size), pa.int64()), pa.array(np.concatenate(lists.score)), pa.array(np.concatenate(lists.id))], ["item", "score", "id"])

    dealt = bags(src, sent, n, length, top).withColumn("deal", F.xxhash64("bag")).repartition("deal").sortWithinPartitions("deal", "bag").select("bag", "ids")
    found = dealt.mapInArrow(search, "item long, score long, id long")
    # the same document is in several rows where the table repeats it, so ties are told apart by their number
    order = [F.col("score").desc(), F.col("id")]
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("score", "id"), F.lit(SALTS)))
    few = dealt.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top).drop("salt", "place")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
    doc = F.when(F.col("id") != NO_ID, F.col("id"))
    return best.join(F.broadcast(named), "item").select("item_id", "rank", doc.alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_id, ``rank`` (from 1), doc_id and ``score`` of the ``top`` best documents of each row of ``items``.

    Only scores above 0 count; equal scores are ranked by ascending id, null ids last; ids are taken as long (2**63 - 1
    stands for null).  Null and empty texts have no words and are found by, or find, nothing.  Repeated documents are
    ranked one by one; items of equal id each have a list of their own.  An empty table gives an empty result; other
    columns are not read.  A single item of more than ``PART_BYTES`` bytes is refused, as its words are sent to all tasks."""
    src = arrange(docs, {id_col: "id", text_col: "text"}).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = reliable_checkpoint(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text is not null"))
    size = listed.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (size[1] or 0) > PART_BYTES:
        raise ValueError(f"an item of {size[1]} bytes; at most {PART_BYTES} are sent to the executors")
    out = None
    n = max(1, -(-2 * (size[0] or 0) // PART_BYTES))
    for i in range(n):
        rows = listed.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()  # one part of the items
        if rows or out is None and i == n - 1:
            found = _search_part(src, rows, listed.schema["item_id"].dataType, top)
            out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})
