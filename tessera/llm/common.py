"""Helpers shared by the operators of this subpackage.

* ``arrange`` gives every row a stable locator (file, row number in the file) and a block of neighbouring rows, so two
  passes over the same input agree on blocks without a shuffle of the texts.
* ``pack`` / ``unpack`` turn a small Arrow table into one compressed binary cell (Arrow IPC with zstd), which keeps
  shuffles of word and n-gram lists narrow.
* ``Words`` finds words in UTF-8 buffers with numpy and gives each a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

#: Rows of one file that form a block, and the text bytes from which a document is a block of its own.
BLOCK_ROWS, LONG_TEXT = 4096, 256 << 10
#: Texts are worked on in slices of about so many bytes, which bounds the numpy arrays of a task.
SLICE_BYTES = 512 << 10
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrange(docs: DataFrame, cols: dict[str, str], block_rows: int = BLOCK_ROWS, text: str | None = "text") -> DataFrame:
    """``cols`` (source column -> new name) of ``docs``, plus ``row_file`` and ``row_no`` (the place of the row in its
    parquet file) and ``block``.  A frame that is not a plain parquet scan is first written to the shared folder.
    Columns not named in ``cols`` are left behind, so extra columns can't clash."""
    picked = [F.col(f"`{c}`").alias(n) for c, n in cols.items()]
    place = [F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_no")]
    try:
        out = docs.select(*picked, *place)
    except AnalysisException:
        landed = reliable_checkpoint(docs.select(*picked))
        out = landed.select(*cols.values(), *place)
    own = F.lit(None).cast("long")
    if text is not None:
        own = F.when(F.octet_length(F.col(cols[text])) > LONG_TEXT, F.col("row_no"))
    return out.withColumn("block", F.xxhash64("row_file", (F.col("row_no") / block_rows).cast("long"), own))


def lower_az(c):
    """Lower-case A-Z only. A text of one byte per character has no other letters that lower() would touch."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def pack(level: int = 1, **arrays) -> bytes:
    t = pa.table({k: a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for k, a in arrays.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(cell) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(cell)).read_all().combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the offsets of its rows (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[i]:at[i + 1]] for each i of ``which``, joined, and where each begins."""
    size = at[which + 1] - at[which]
    to = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    return values[np.repeat(at[which] - to[:-1], size) + np.arange(to[-1])], to


def slices(batches, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes; a longer text comes alone.  Arrow's pool keeps what was freed,
    and workers are used again: before the first and after the last row it gives that back."""
    pa.default_memory_pool().release_unused()
    for b in batches:
        if not b.num_rows:
            continue
        _, at = buffers(b.column(b.schema.get_field_index(text)))
        i, n = 0, b.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            j = min(j, n)
            yield b.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()


def runs(batches, text: str = "text") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Slices gathered while they lie in one block: (block, slices). A block that ends in another task, or that other
    blocks interrupt, comes in several runs."""
    held: list[pa.RecordBatch] = []
    at, size = None, 0
    for b in slices(batches, text):
        ids = b.column(b.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (int(ids[i]) != at or size > 32 * SLICE_BYTES):
                yield at, held
                held, size = [], 0
            at = int(ids[i])
            part = b.slice(i, j - i)
            held.append(part)
            size += int(buffers(part.column(part.schema.get_field_index(text)))[1][-1])
    if held:
        yield at, held


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Spans over so many bytes are hashed by BLAKE2b, shorter ones 8 bytes at a time.
LONG_SPAN = 128
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def _eights(units: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as a number (zeros after the end)."""
    padded = np.concatenate([units, np.zeros(8, np.uint8)])
    return np.ndarray((len(units) + 1,), "<u8", padded, 0, (1,))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes units[start:end] of every span, equal for equal contents.

    The state has two lanes of 64 bits; every 8 bytes go through the finaliser of ``mix`` in both, so that no sum or
    product of the text's own pattern cancels out.  What must hold exactly is compared by bytes (``same_spans``)."""
    eights, size = _eights(units), (ends - starts).astype(np.int64)
    a, b = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15)), mix(size.astype(U64) ^ U64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        a[i], b[i] = np.frombuffer(hashlib.blake2b(units[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    at = np.flatnonzero(size <= LONG_SPAN)
    place, left = starts[at], size[at]
    while len(at):
        chunk = eights[place] & _TAIL[np.minimum(left, 8)]
        a[at] = mix(a[at] ^ chunk)
        b[at] = mix((b[at] + chunk) * U64(0xD6E8FEB86659FD93))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    return mix(a ^ (b << U64(29)) ^ (b >> U64(35)))


def same_spans(x: np.ndarray, x_start: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_start: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of the spans of x are those of the spans of y, one by one."""
    size = x_end - x_start
    out = size == y_end - y_start
    xs, ys = _eights(x), _eights(y)
    at = np.flatnonzero(out)
    i, j, left = x_start[at], y_start[at], size[at]
    while len(at):
        same = ((xs[i] ^ ys[j]) & _TAIL[np.minimum(left, 8)]) == 0
        out[at[~same]] = False
        more = same & (left > 8)
        at, i, j, left = at[more], i[more] + 8, j[more] + 8, left[more] - 8
    return out


class Words:
    """Words of a column of texts: maximal runs of bytes for which ``inside`` holds, after lower-casing A-Z."""

    #: [^\x20\x09-\x0D]+
    SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
    #: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and what is not ASCII
    LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
    LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def __init__(self, col: pa.Array, inside: np.ndarray):
        raw, at = buffers(col)
        self.data, self.at = self.LOWER[raw], at
        w = inside[self.data]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        first, last = w.copy(), w.copy()
        if len(w):
            first[1:] &= ~w[:-1] | edge[1:-1]
            last[:-1] &= ~w[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of row i are those from row_at[i] to row_at[i + 1]
        self.row_at = np.searchsorted(self.starts, at)
        self._inside = w

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def listed(self) -> pa.Array:
        """The words themselves as an Arrow column."""
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=at[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(self.data[self._inside])])

    def __len__(self) -> int:
        return len(self.row_at) - 1

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.row_at[i] : self.row_at[i + 1]]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; a shorter sequence (not an empty one) is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        out = mix(out * U64(0x2545F4914F6CDD1D) + words[j : j + len(out)])
    return out


def buckets(df: DataFrame, n: int | None = None) -> int:
    """How many groups a global exchange is dealt into: the session's shuffle partitions unless given."""
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def landed(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have places in parquet files, else the same rows written to the shared folder."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return reliable_checkpoint(docs)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (see ``landed``) whose place is in ``kept`` (row_file, row_no), with all their columns."""
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_no"))
    return placed.join(kept.select("row_file", "row_no"), ["row_file", "row_no"], "left_semi").select("row.*")
