"""Values of terms brought to blocks of documents, instead of documents' terms to the values.

Documents are packed once, a run of them as one row: their ids, the distinct terms of the block, and for each document its terms
as places in that list with their counts.  A term is then looked up once for a block, not once for a document: only (block,
place, term) meets the table of terms, and only the values found go back to the block, where the rest is done in numpy.  A
common term is looked up as often as there are blocks, so no term is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

#: Pairs of document and term in a block, at most (or one document).
BLOCK_PAIRS = 1 << 19


def pack_documents(runs: DataFrame, stop: list[str] = ()) -> DataFrame:
    """(``block``, ``ids``, ``sizes``, ``places``, ``tf``, ``terms``) of (``doc_id``, ``_runs``), written once, without the terms
    of ``stop``.  ``sizes``, ``places`` and ``tf`` are int32 cells: the number of each document's terms, and those terms."""
    stop = sorted(set(stop))

    def cell(x: np.ndarray) -> pa.Array:
        return pa.array([x.astype(np.int32).tobytes()], pa.binary())

    def one(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        ids, found = batch.column(0), batch.column(1)
        owner = np.repeat(np.arange(len(batch)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        term, tf = found.flatten().flatten()
        keep = pc.is_valid(term)
        if stop:
            keep = pc.and_(keep, pc.invert(pc.is_in(term, value_set=pa.array(stop, term.type))))
        keep = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
        coded = term.take(pa.array(keep)).dictionary_encode()
        sizes = np.bincount(owner[keep], minlength=len(batch))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array([block]), whole(ids), cell(sizes), cell(coded.indices.to_numpy()),
                                           cell(tf.to_numpy(zero_copy_only=False)[keep]), whole(coded.dictionary)], names)

    names = ["block", "ids", "sizes", "places", "tf", "terms"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            before = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(batch):
                done = before[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(before, done + BLOCK_PAIRS, "right")))
                yield one(batch.slice(a, b - a), block)
                a, block = b, block + 1

    kind = runs.schema["doc_id"].dataType.simpleString()
    return reliable_checkpoint(runs.select("doc_id", "_runs").mapInArrow(
        part, f"block long, ids array<{kind}>, sizes binary, places binary, tf binary, terms array<string>"))


def _cells(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], np.int32) for c in ("sizes", "places", "tf")]


def block_frequency(packed: DataFrame) -> DataFrame:
    """(``term``, ``df``, ``ctf``) over all documents; a block sends one row for each of its terms."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                terms = batch.column("terms").slice(r, 1).flatten()
                _, places, tf = _cells(batch.select(["sizes", "places", "tf"]).slice(r, 1).to_pylist()[0])
                ctf = np.bincount(places, tf, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(places, minlength=len(terms))), pa.array(ctf)], ["term", "df", "ctf"])

    rows = packed.mapInArrow(part, "term string, df long, ctf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def wanted(packed: DataFrame) -> DataFrame:
    """(``of``, ``place``, ``term``): the terms of each block, which is named once more as it meets ``packed`` again."""
    return packed.select(F.col("block").alias("of"), F.posexplode("terms").alias("place", "term"))


def counts_of(packed: DataFrame) -> DataFrame:
    """(``doc_id``, ``term``, ``tf``) again, a row for each document and term."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                sizes, places, tf = _cells(batch.select(["sizes", "places", "tf"]).slice(r, 1).to_pylist()[0])
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(r, 1).flatten().take(owner), batch.column("terms").slice(r, 1).flatten().take(pa.array(places)),
                                                  pa.array(tf.astype(np.int64))], ["doc_id", "term", "tf"])

    return packed.mapInArrow(part, f"doc_id {kind}, term string, tf long")


def ids_repeat(packed: DataFrame) -> bool:
    """Whether any two documents have the same id, or two have none."""
    ids = packed.select(F.explode("ids").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return not ids.where("n > 1").isEmpty()


def weigh(packed: DataFrame, idf: DataFrame, norm: str | None, scale) -> DataFrame:
    """(``doc_id``, ``term``, ``tf``, ``weight``): ``scale(tf) * idf``, divided by the document's norm.  ``idf``: (``of``,
    ``place``, ``idf``); other terms drop out."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, term string, tf long, weight double"

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        terms, ids = left["terms"].chunk(0).flatten(), left["ids"].chunk(0).flatten()
        sizes, places, tf = _cells(left.select(["sizes", "places", "tf"]).to_pylist()[0])
        known, value = np.zeros(len(terms), bool), np.zeros(len(terms))
        at = right["place"].to_numpy()
        known[at], value[at] = True, right["idf"].to_numpy()
        keep = np.flatnonzero(known[places])
        owner, places, tf = np.repeat(np.arange(len(sizes)), sizes)[keep], places[keep], tf[keep]
        w = value[places] * scale(tf.astype(np.float64))
        if norm:
            size = np.bincount(owner, np.abs(w) if norm == "l1" else w * w, len(sizes))[owner]
            size = size if norm == "l1" else np.sqrt(size)
            w = np.divide(w, size, out=np.zeros_like(w), where=size > 0)
        return pa.table({"doc_id": ids.take(pa.array(owner)), "term": terms.take(pa.array(places)), "tf": pa.array(tf.astype(np.int64)), "weight": pa.array(w)})

    return packed.groupBy("block").cogroup(idf.groupBy("of")).applyInArrow(fn, schema)


def vector_sums(packed: DataFrame, found: DataFrame) -> DataFrame:
    """(``doc_id``, ``s``, ``w``) of each document with a known term: the sum of ``tf * scale * v`` and of ``tf`` over ``found``
    (``of``, ``place``, ``v``, ``scale``), which may hold a place more than once."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        ids, n_terms = left["ids"].chunk(0).flatten(), left["n_terms"][0].as_py()
        sizes, places, tf = _cells(left.select(["sizes", "places", "tf"]).to_pylist()[0])
        at = right["place"].to_numpy()
        times = np.bincount(at, minlength=n_terms).astype(np.float64)
        w = np.bincount(np.repeat(np.arange(len(sizes)), sizes), tf * times[places], len(sizes)).astype(np.float64)  # of no terms at all it is int
        held = right.filter(pc.is_valid(right["v"])).combine_chunks()
        sums = np.zeros((len(sizes), 0))
        if held.num_rows:
            v = held["v"].chunk(0)
            lengths = v.value_lengths().to_numpy()
            if (lengths != lengths[0]).any():
                raise ValueError("word vectors of different lengths")
            v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1) * held["scale"].to_numpy()[:, None]
            at, owner = held["place"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            sums = np.stack([np.bincount(owner, tf * np.bincount(at, column, n_terms)[places], len(sizes)) for column in v.T], 1)
        has = np.flatnonzero(w > 0)
        return pa.table({"doc_id": ids.take(pa.array(has)), "s": pa.array(list(sums[has]), pa.list_(pa.float64())), "w": pa.array(w[has])})

    own = packed.select("block", "ids", "sizes", "places", "tf", F.size("terms").alias("n_terms"))  # the terms needn't cross again
    return own.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(fn, f"doc_id {kind}, s array<double>, w double")
