"""Target-distribution importance resampling by array-scored weights and a distributed quickselect.

1. Features are the runs of one or two consecutive words, hashed into ``cells`` buckets by CRC-32.  Every task counts its
   own features in an array; the sums of all documents and of the target are two arrays of ``cells`` numbers.
2. An array of gains (floored log ratios of the two) scores every document: its weight is the floored mean of the gains of
   its features.  A Gumbel number drawn from the id's SHA-256 is added, so that the highest scores are a sample without
   replacement whose odds are the weights.
3. The draw keeps the k highest.  The k-th composite key (score, id, place of the row) is found by a distributed
   quickselect: a few random pivot keys, exact counts of the keys between, at and beyond them, and on with the part that
   holds the k-th; each part is written once, so later rounds read only what is left.
4. Only the winners are sorted and ranked, by a range-partitioned sort.

What the driver holds is two arrays of ``cells`` numbers and the pivots of a round.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, arrange, column, slices
from tessera.session import reliable_checkpoint
from tessera.sources.keys import add_row_number

CELLS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Random pivot keys of a round.
PIVOTS = 16
#: Words over so many bytes get their checksums one by one.
LONG_WORD = 64
KEY = ("low", "no_id", "id", "row_file", "row_no")


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32 (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def _zeros_table(longest: int) -> np.ndarray:
    """[n, i, v]: what n zero bytes make of a register whose byte i is v; the register is linear, so bytes add up."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = _CRC[out[n] & 0xFF] ^ (out[n] >> 8)
    return out


_ZEROS = _zeros_table(LONG_WORD + 1)


def _after(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _ZEROS[n, 0, register & 0xFF] ^ _ZEROS[n, 1, (register >> 8) & 0xFF] ^ _ZEROS[n, 2, (register >> 16) & 0xFF] ^ _ZEROS[n, 3, register >> 24]


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of every span."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int((left > LONG_WORD).sum())
    for j in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # spans of more than j bytes
        here = c[long:n]
        c[long:n] = _CRC[(here ^ data[at[long:n] + j]) & 0xFF] ^ (here >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = c
    return out


def feature_crcs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word; of each two neighbouring words of a text, joined by a space; and the index of their first."""
    one = span_crc32(w.data, w.starts, w.ends)
    first = np.ones(len(w.starts) + 1, bool)
    first[: len(w.starts)] = False
    first[w.row_at] = True
    lead = np.flatnonzero(~first[1:])  # words that another of the same text follows
    size = (w.ends - w.starts)[lead + 1]
    n = np.minimum(size, LONG_WORD)
    two = _after(one[lead], n + 1) ^ _after(np.full(len(lead), zlib.crc32(b" "), np.uint32), n) ^ one[lead + 1]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        j = lead[i]
        two[i] = zlib.crc32(w.data[w.starts[j + 1] : w.ends[j + 1]].tobytes(), zlib.crc32(b" ", int(one[j])))
    return one, two, lead


def cell_counts(texts: DataFrame, text_col: str = "text", cells: int = CELLS) -> np.ndarray:
    """How many features of all texts fall into each cell (null texts have none)."""
    def count(batches):
        total = np.zeros(cells, np.int64)
        for b in slices(batches):
            one, two, _ = feature_crcs(Words(column(pa.Table.from_batches([b]), "text"), Words.LETTERS))
            total += np.bincount(one % cells, minlength=cells) + np.bincount(two % cells, minlength=cells)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    listed = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").mapInArrow(count, "cell int, n long")
    for r in listed.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most ``cells`` rows
        out[r["cell"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of the target's share of a cell to the documents'), in doubles."""
    cells, s_all, t_all = len(documents), float(documents.sum()), float(target.sum())
    ratio = [((float(t) + 1) * (s_all + cells)) / ((float(s) + 1) * (t_all + cells)) for s, t in zip(documents.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row_file, row_no, n_words, n_features and weight."""
    src = arrange(docs, {id_col: "id", text_col: "text"}).select("id", "row_file", "row_no", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cells = len(gain)

    def weight(batches):
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            w = Words(column(t, "text"), Words.LETTERS)
            one, two, lead = feature_crcs(w)
            each = gain[one % cells]
            np.add.at(each, lead, gain[two % cells])
            total = np.diff(np.concatenate([[0], np.cumsum(each)])[w.row_at])
            words = np.diff(w.row_at).astype(np.int64)
            n = words + np.maximum(words - 1, 0)
            out = [*(column(t, c) for c in ("id", "row_file", "row_no")), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(out, ["id", "row_file", "row_no", "n_words", "n_features", "weight"])

    return src.mapInArrow(weight, f"id {dict(src.dtypes)['id']}, row_file string, row_no long, n_words long, n_features long, weight long")


def smallest(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest (from 1) of the rows of ``keys``, which compare column by column, nulls first."""
    kinds = [f.dataType for f in keys.schema.fields]
    key = F.struct(*[F.col(f"`{c}`") for c in keys.columns])
    inside, turn = keys, 0
    while True:
        of = [F.col(f"`{c}`") for c in keys.columns]
        slot = F.pmod(F.xxhash64(*of, F.lit(turn)), F.lit(pivots))
        drawn = inside.groupBy(slot.alias("slot")).agg(F.min_by(key, F.xxhash64(*of, F.lit(~turn))).alias("p")).collect()  # a row for each pivot
        if not drawn:
            raise ValueError("fewer keys than k")
        order = sorted((tuple(r["p"]) for r in drawn), key=lambda p: tuple((v is not None, v if v is not None else 0) for v in p))
        listed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(p, kinds, keys.columns, strict=True)]) for p in order])
        # the part of a key: 2 i + 1 is pivot i itself, 2 i lies before it and after pivot i - 1
        part = F.size(F.filter(listed, lambda p: p < key)) + F.size(F.filter(listed, lambda p: p <= key))
        counted = {r["part"]: r["n"] for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 pivots + 1 rows
        for p in sorted(counted):
            if k <= counted[p]:
                break
            k -= counted[p]
        else:
            raise ValueError("fewer keys than k")
        if p % 2:
            return order[p // 2]
        inside = reliable_checkpoint(inside.where(part == p))
        turn += 1


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, cells: int = CELLS,
) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null for rows
    that are not drawn).  Of the N rows with ``least`` words or more, floor(percent N / 100) are drawn: the highest scores,
    of equal ones the smaller id, of rows of one id the first in place.

    Null and empty texts have no features and weight 0; a null id counts as an empty one where the Gumbel number is drawn,
    and comes after all others; repeated rows are rows of their own; an empty target leaves the documents' own
    distribution as the only evidence; an empty table gives an empty result; other columns are not read."""
    gain = gains(cell_counts(docs, text_col, cells), cell_counts(target, target_col, cells))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel)
    rows = reliable_checkpoint(rows.withColumns({"low": -F.col("score"), "no_id": F.col("id").isNull(), "open": F.col("n_words") >= least}))
    k = rows.where("open").count() * percent // 100
    names = ["id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*names, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", id_col)
    last = smallest(rows.where("open").select(*KEY), k)
    of = F.struct(*[F.col(c) for c in KEY])
    drawn = F.col("open") & (of <= F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(last, KEY, strict=True)]))
    winners = add_row_number(rows.where(drawn).select(*names, *[c for c in KEY if c != "id"]), list(KEY), "rank").select(*names, "rank")
    return winners.unionByName(rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", id_col)
