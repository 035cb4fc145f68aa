"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each block of documents is split into pre-tokens with positions; its distinct words go, as one packed list per block
   and bucket, to the bucket of their hash.
2. A bucket gathers the words of all blocks, encodes each distinct word once by its merges, and answers every block.
3. Documents and answers of a block meet again: ids are joined back by the word itself and put together by position.

Only packed word lists, packed answers and compressed texts are shuffled.  A word that is in every document is in a
bucket once per block, and a block holds at most ``BLOCK_ROWS`` rows, so neither grows with how common a word is.
Decoding looks ids up in the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, arrange, buckets, buffers, column, gather, pack, runs, slices, span_hashes, unpack

#: Bytes of tokens that are sent to all executors.
MAX_VOCABULARY = 64 << 20
#: Words that are merged before their ids are put into arrays, and text bytes that are assembled at a time.
MERGED, AT_ONCE = 1 << 14, 2 << 20
#: The characters of White_Space, and the endings that the pattern takes off after an apostrophe.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= len(parts) or len(left) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = left + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(pair := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(pair)))
    return [ranks[p] for p in parts if p is not None]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of every code point, by Unicode category."""
    out = np.zeros(0x110000, np.uint8)
    for start in range(0, len(out)):
        c = unicodedata.category(chr(start))[0]
        if c == "L":
            out[start] = LETTER
        elif c == "N":
            out[start] = NUMBER
    out[WHITE] = SPACE
    return out


def token_starts(points: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin (bool for each code point).

    ``public_tokenizers.PATTERN`` takes runs of letters, numbers, or other marks, with one space before them if there is
    one; of white space before such a run the last character is apart, the rest is one token; after an apostrophe that
    begins a token the usual English endings are cut off."""
    n = len(points)
    kind = _kinds()[points]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[doc_at] = True
    fresh = np.zeros(n + 1, bool)
    fresh[doc_at] = True
    after_space = np.flatnonzero(start[1:n] & ~fresh[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after_space - 1] = True
    start[after_space[points[after_space - 1] == 0x20]] = False

    # an apostrophe that begins a token and is followed by letters of the same text
    quote = np.flatnonzero((points == 0x27) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    if len(quote):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        first, second = wide[quote + 1], wide[quote + 2]
        second = np.where(fresh[np.minimum(quote + 2, n)], 0, second)
        cut = np.zeros(len(quote), np.int64)
        for e in reversed(ENDINGS):
            cut[(first == ord(e[0])) & ((second == ord(e[1])) if len(e) > 1 else True)] = len(e)
        quote, cut = quote[cut > 0], cut[cut > 0]
        start[quote + 1] = False
        start[quote + 1 + cut] = True
    return start[:n]


class PreTokens:
    """Pre-tokens of a column of texts; ``starts`` and ``ends`` are byte positions in ``raw``."""

    def __init__(self, col: pa.Array):
        self.raw, self.at = buffers(col)
        points = np.frombuffer(self.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((self.raw & 0xC0) != 0x80)
        begins = lead[token_starts(points, np.searchsorted(lead, self.at))] if len(points) else lead
        self.starts, self.ends = begins, np.append(begins[1:], len(self.raw)) if len(begins) else begins
        self.row_at = np.searchsorted(self.starts, self.at)

    def words(self) -> pa.Array:
        """The pre-tokens as an Arrow column; they follow one another without gaps."""
        ends = np.append(self.starts, len(self.raw)) if len(self.starts) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.raw)])


def _small(spark: SparkSession, ranks: dict[bytes, int]):
    if (size := sum(map(len, ranks))) > MAX_VOCABULARY:
        raise ValueError(f"tokens of {size} bytes; at most {MAX_VOCABULARY} are sent to the executors")
    return spark.sparkContext.broadcast(ranks)


def _token_bytes(spark: SparkSession, ranks: dict[bytes, int]):
    """The token-byte table: all tokens' bytes in the order of their ids, and where each begins."""
    by_id = {i: t for t, i in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    if (size := sum(map(len, tokens))) > MAX_VOCABULARY:
        raise ValueError(f"tokens of {size} bytes; at most {MAX_VOCABULARY} are sent to the executors")
    return spark.sparkContext.broadcast((b"".join(tokens), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)))


def _look_up(table: tuple[bytes, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Bytes of the tokens of every row; row i has ids[ends[i]:ends[i + 1]]."""
    found, to = gather(np.frombuffer(table[0], np.uint8), table[1], ids.astype(np.int64))
    found, to = found.tobytes(), to[ends].tolist()
    return [found[i:j] for i, j in zip(to[:-1], to[1:], strict=True)]


def encode(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None, decoded: bool = False,
) -> DataFrame:
    """One row per input row: the id and ``ids``, the token ids as little-endian unsigned 32-bit integers (binary); if
    asked for, also ``decoded``, the bytes that the ids stand for, looked up in the same task as ``decode`` does.

    Null and empty texts have no ids (empty binary); a null id stays null; repeated rows stay; an empty table gives an
    empty result; other columns are not read.  ``ranks`` must hold all 256 single bytes."""
    n = buckets(docs, n_buckets)
    sent = _small(docs.sparkSession, ranks)
    src = arrange(docs, {id_col: "id", text_col: "text"}).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "block")
    kind = dict(src.dtypes)["id"]
    table = _token_bytes(docs.sparkSession, ranks) if decoded else None
    narrow = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32

    def ask(batches):
        for block, parts in runs(batches):
            found = [pc.unique(PreTokens(column(pa.Table.from_batches([b]), "text")).words()) for b in parts]
            listed = pc.unique(pa.chunked_array(found, pa.large_binary())).cast(pa.binary())
            if not len(listed):
                continue
            raw, at = buffers(listed)
            bucket = (span_hashes(raw, at[:-1], at[1:]) % U64(n)).astype(np.int64)
            in_order = pc.sort_indices(listed).to_numpy()  # neighbours share their beginnings, which packs well
            listed = listed.take(pa.array(in_order[np.argsort(bucket[in_order], kind="stable")]))
            ends = np.cumsum(np.bincount(bucket, minlength=n))
            rows = [(k, pack(9, word=listed.slice(i, j - i))) for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r for _, r in rows], pa.binary())],
                ["bucket", "block", "words"])

    def answer(t: pa.Table) -> pa.Table:
        lists = [column(unpack(c.as_py()), "word") for c in t.column("words")]
        whole = pa.concat_arrays(lists).dictionary_encode()
        flat, sizes = [], []
        for i in range(0, len(whole.dictionary), MERGED):
            ids = [merge(w, sent.value) for w in whole.dictionary.slice(i, MERGED).to_pylist()]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), narrow, int(sizes[-1].sum())))
        flat, at = np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        index = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out, i = [], 0
        for words in lists:
            own, own_at = gather(flat, at, index[i : i + len(words)])
            out.append((pack(3, size=np.diff(own_at).astype(np.uint32)), pack(3, id=own)))
            i += len(words)
        return pa.table({"block": t.column("block"), "words": t.column("words"), "sizes": pa.array([s for s, _ in out], pa.binary()), "ids": pa.array([i for _, i in out], pa.binary())})

    def shrink(batches):
        for block, parts in runs(batches):
            t = pa.Table.from_batches(parts)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(9, id=t.column("id"), text=t.column("text"))], pa.binary())], ["block", "texts"])

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
        listed = pa.chunked_array([column(unpack(c.as_py()), "word") for c in answers.column("words")], pa.binary()).cast(pa.large_binary())
        at = np.concatenate([[0], np.cumsum(join([column(unpack(c.as_py()), "size").to_numpy() for c in answers.column("sizes")], np.int64))])
        flat = join([column(unpack(c.as_py()), "id").to_numpy() for c in answers.column("ids")], narrow)
        to_id, out, again = [], [], []
        for cell in texts.column("texts"):
            for b in slices(unpack(cell.as_py()).to_batches(), most=AT_ONCE):
                t = pa.Table.from_batches([b])
                p = PreTokens(column(t, "text"))
                where = pc.index_in(p.words(), value_set=listed).to_numpy().astype(np.int64)
                ids, ids_at = gather(flat, at, where)
                data = ids.astype("<u4").tobytes()
                ends = (ids_at[p.row_at] * 4).tolist()
                out += [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                if decoded:
                    again += _look_up(table.value, ids, ids_at[p.row_at])
                to_id.append(column(t, "id"))
        named = pa.chunked_array(to_id) if to_id else pa.array([], unpack(texts.column("texts")[0].as_py()).schema.field("id").type if len(texts) else pa.int64())
        return pa.table({"id": named, "ids": pa.array(out, pa.binary())} | ({"decoded": pa.array(again, pa.binary())} if decoded else {}))

    asked = src.mapInArrow(ask, "bucket int, block long, words binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block long, words binary, sizes binary, ids binary")
    shrunk = src.mapInArrow(shrink, "block long, texts binary")
    out = shrunk.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(assemble, f"id {kind}, ids binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes that its ``ids`` stand for (null ids: null)."""
    sent = _token_bytes(encoded.sparkSession, ranks)
    fields = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes)

    def look_up(batches):
        for b in slices(batches, "ids"):
            ids = column(pa.Table.from_batches([b]), "ids")
            raw, ends = buffers(ids)
            found = _look_up(sent.value, np.frombuffer(raw.tobytes(), "<u4"), ends // 4)
            texts = [None if x else t for x, t in zip(ids.is_null().to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(look_up, f"{fields}, decoded binary")
