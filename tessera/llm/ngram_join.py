"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document is the set of its word shingles (64-bit hashes).  Documents of equal sets are one class (a 128-bit digest of
the set).  Shingles have a global order, rare ones first: a fixed-size sketch counts all shingles of all documents,
shingles are ordered by the count of their cell, and one whose cell is well above the mean is *frequent*.  Any order
gives the same result; this one keeps groups small.

Sets x and y link when their Jaccard similarity is at least t = 3/4, so they share at least 3 (|x| + |y|) / 7 shingles.

* Rare class, single tokens.  The first |x| - ceil(t |x|) + 1 shingles of x hold the first shingle that x and y share.  If
  it is rare, both index it.
* Frequent class, combinations of two.  Else x and y share frequent shingles only.  Put a mark before and after the
  ordered frequent shingles of x and pair neighbours: of the gaps between shared shingles each shingle that is not shared
  breaks one, so at least |x| / 2 + 1 + (rare shingles of x) neighbour pairs are in both.  Of x's pairs, in the order of
  their hashes, a prefix of that bound is indexed.

Single tokens meet in buckets as packed lists; their groups are small, as frequent shingles are not among them.
Combinations may be common, so their groups are handled by joins and aggregates that split.  In each group every class is
compared with one leader, confirmed links are merged to components, and only classes of one group that are still in
different components are compared with each other, first by signatures.  Where those allow few pairs, all are checked; in
a dense group a spanning forest is, and then the sets of what is still apart and may link come to one task.  So copies of
one text, however many, cost one comparison each, what leaves a group grows with its size, and no link between components
is missed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, arrange, buckets, column, mix, pack, runs, shingle_hashes, slices, unpack
from tessera.session import reliable_checkpoint

#: Words of a shingle, and the similarity in hundredths from which documents link.
SHINGLE, PERCENT = 5, 75
#: Cells of the sketch of shingle counts (a byte each), its parts, and words of 64 bits of the filter of wanted rows.
CELLS, PARTS, FILTER_WORDS = 1 << 24, 128, 1 << 19
#: The level of a cell that is as full as the count above which shingles are frequent.
EVEN = 128
#: Keys are cut to 48 bits: they only propose pairs.
KEY = U64((1 << 48) - 1)
BEGIN, END = U64(0x2B992DDFA23249D6), U64(0x6A09E667F3BCC909)
#: Leaders are changed while the pairs left to compare are more than so many times the rows that make them, and each
#: change at least halves them; then all that are left are compared.
LEFT, ROUNDS = 20, 6
#: Classes of one group that are compared with each other in one task.
WIDTH = 1024
#: Pairs for each class of a meeting that leave it one by one.
FEW = 2
#: Kinds of rows that buckets give.
STAR, GROUP, COMMON = range(3)


def _sets(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    w = Words(column(pa.Table.from_batches([b]), "text"), Words.SPACED)
    return [np.unique(shingle_hashes(w.row(i), k)) for i in range(len(w))]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def prefix_keys(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set, in the global order, is indexed: single rare shingles, and pairs of frequent ones."""
    n, of = len(s), frequent
    rare, common = s[~of], s[of]
    p = n - -(-percent * n // 100) + 1
    if len(rare) >= p:
        return rare[:p], np.empty(0, U64)
    line = np.concatenate([[BEGIN], common, [END]]).astype(U64)
    pairs = np.sort(mix(mix(line[:-1]) + line[1:]))
    # shared pairs: 3 o + 1 - |frequent x| - |frequent y|, o >= q (|x| + |y|), |y| >= t |x|
    t = percent / 100
    q = t / (1 + t)
    shared = math.ceil((3 * q - 1) * (1 + t) * n + 1 + len(rare) - 1e-9) if 3 * q >= 1 else 1
    return rare, pairs[: max(1, len(pairs) - max(shared, 1) + 1)]


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _signature(s: np.ndarray) -> bytes:
    """Parity bits: bit i tells whether an odd number of elements fall on i. Twice the size's power of two."""
    bits = 1 << max(8, min(16, (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _may_link(x: bytes, n_x: int, y: bytes, n_y: int, percent: int) -> bool:
    """Whether sets of these signatures and sizes can be similar: every differing bit needs an element that only one of
    them has, so they share at most half of what is left."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    shared = min((n_x + n_y - int(np.bitwise_count(x ^ y).sum())) // 2, n_x, n_y)
    return 100 * shared >= percent * (n_x + n_y - shared)


def _rarity(sketch: DataFrame) -> tuple[np.ndarray, int]:
    """Level of every cell, a byte that grows with its count, and the level above which shingles are frequent."""
    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, np.int64)
        for c in t.column("counts"):
            total += column(unpack(c.as_py()), "n").to_numpy()
        cell = pack(3, n=np.minimum(total, 2**31 - 1).astype(np.int32))
        return pa.table({"part": t.column("part").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([cell], pa.binary())})

    added = reliable_checkpoint(sketch.groupBy("part").applyInArrow(add, "part int, total long, counts binary"))
    mean = (added.agg(F.sum("total")).first()[0] or 0) / CELLS
    limit = mean + 4 * math.sqrt(mean) + 8

    def level(batches):
        for b in batches:
            cells = [np.minimum(column(unpack(c.as_py()), "n").to_numpy() * (EVEN / limit), 255).astype(np.uint8).tobytes() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary())], ["part", "levels"])

    out, width = np.zeros(CELLS, np.uint8), CELLS // PARTS
    for r in added.select("part", "counts").mapInArrow(level, "part int, levels binary").toLocalIterator():  # PARTS rows of fixed size
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out, EVEN


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): alternating large and small stars until each node has one edge to a
    smaller one that has none; the component is its smallest node."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = reliable_checkpoint(small.distinct())
        roles = e.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        roles = roles.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        if not roles.where("low + high > 1").agg(F.count(F.lit(1))).first()[0]:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merged(whole: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the edges that gave ``whole`` (node, component) and of ``links`` (a, b) together: only the
    components that links join are contracted again."""
    of = lambda c: whole.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = reliable_checkpoint(components(named.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))))
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = whole.join(new, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return old.unionByName(joined.join(whole, "node", "left_anti"))


def _pairs_that(pairs: DataFrame, of: DataFrame, test) -> DataFrame:
    """The pairs (a, b, and where they are known the places a_place, b_place of their rows) of classes whose rows in ``of``
    (cls, place, n, data) pass the test, with the places.  A class that is in many pairs stands as a, so it is joined last."""
    by = lambda c: [c, f"{c}_place"] if f"{c}_place" in pairs.columns else [c]
    side = lambda c: of.select(F.col("cls").alias(c), F.col("place").alias(f"{c}_place"), F.struct("n", "data").alias(f"{c}_row"))
    met = pairs.join(side("b"), by("b")).join(side("a"), by("a")).select("a", "b", "a_place", "b_place", "a_row", "b_row")

    def check(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            left, right = column(t, "a_row"), column(t, "b_row")
            rows = zip(left.field("data"), left.field("n").to_pylist(), right.field("data"), right.field("n").to_pylist(), strict=True)
            keep = [test(x.as_buffer(), n_x, y.as_buffer(), n_y) for x, n_x, y, n_y in rows]
            yield from t.select(["a", "b", "a_place", "b_place"]).filter(pa.array(keep, pa.bool_())).to_batches()

    return met.mapInArrow(check, "a binary, b binary, a_place long, b_place long")


class _Forest:
    """Components of numbered things, joined one link at a time."""

    def __init__(self, parts: np.ndarray):
        first = np.unique(parts, return_index=True)[1]
        self.up = first[np.unique(parts, return_inverse=True)[1]].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _meetings(t: pa.Table):
    """The meetings (rows of one key, lo and hi) of a bucket, one after the other."""
    t = t.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending")]).combine_chunks()
    ids = np.stack([column(t, c).to_numpy() for c in ("key", "lo", "hi")])
    cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), len(t)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield t.slice(i, j - i).combine_chunks()


def _passing(t: pa.Table, percent: int, part: np.ndarray):
    """(i, others, their bounds) of the pairs of a meeting that are in different components and may link by signatures."""
    n, own = column(t, "n").to_numpy(), column(t, "own").to_numpy()
    apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
    data = [np.frombuffer(x.as_buffer(), np.uint8) for x in column(t, "data")]
    length = np.fromiter(map(len, data), np.int64, len(data))
    for size in np.unique(length):
        same, double = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)  # others differ too much in size
        rows = np.stack([data[i] for i in same])
        folded = np.stack([data[i][:size] ^ data[i][size:] for i in double]) if len(double) else rows[:0]
        for k, i in enumerate(same):
            for those, bits in ((same[k + 1 :], rows[k + 1 :]), (double, folded)):
                fits = (part[those] != part[i]) & (np.minimum(n[those], n[i]) * 100 >= percent * np.maximum(n[those], n[i]))
                if apart:
                    fits &= own[those] != own[i]
                if fits.any():
                    those = those[fits]
                    total = n[those] + n[i]
                    shared = np.minimum((total - np.bitwise_count(bits[fits] ^ rows[k]).sum(1, dtype=np.int64)) // 2, np.minimum(n[those], n[i]))
                    near = 100 * shared >= percent * (total - shared)
                    if near.any():
                        yield int(i), those[near], shared[near] / (total - shared)[near]


def _dealt(rest: DataFrame, marks: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of groups (key, cls, n, component, size) with their signatures, dealt into meetings: a group is cut into blocks
    of about ``WIDTH`` classes, and every two blocks meet in some bucket, which holds many meetings."""
    blocks = F.ceil(F.col("size") / WIDTH).cast("int")
    dealt = rest.join(marks.select("cls", "place", "data"), "cls").withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    dealt = dealt.select("key", "cls", "place", "n", "component", "data", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cls", "place", "n", "component", "data", "own")
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(n_buckets)))


def _proposed(rest: DataFrame, marks: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """Pairs (a, b) of classes of one group that are in different components and whose signatures allow a link: of each
    meeting all, if they are at most ``FEW`` for each class, else a spanning forest, the most similar pairs first, and the
    group's ``key`` in a row of its own."""
    def bucket(t: pa.Table) -> pa.Table:
        found, dense = [], set()
        for m in _meetings(t):
            part = column(m, "component").dictionary_encode().indices.to_numpy()
            near = list(_passing(m, percent, part))
            if near:
                i = np.concatenate([np.full(len(x), a) for a, x, _ in near])
                j, bound = np.concatenate([x for _, x, _ in near]), np.concatenate([x for _, _, x in near])
                if len(i) > FEW * len(m):
                    dense.add(m.column("key")[0].as_py())
                    forest = _Forest(part)
                    kept = [k for k in np.argsort(-bound, kind="stable").tolist() if forest.join(int(i[k]), int(j[k]))]
                    i, j = i[kept], j[kept]
                cls = column(m, "cls")
                found.append(pa.table({"a": cls.take(pa.array(i)), "b": cls.take(pa.array(j))}))
        none = pa.nulls(len(dense), pa.binary())
        pairs = pa.concat_tables(found).group_by(["a", "b"]).aggregate([]) if found else pa.table({"a": none[:0], "b": none[:0]})
        pairs = pairs.append_column("key", pa.nulls(len(pairs), pa.int64()))
        return pa.concat_tables([pairs.select(["a", "b", "key"]), pa.table({"a": none, "b": none, "key": pa.array(list(dense), pa.int64())})])

    return _dealt(rest, marks, n_buckets).groupBy("bucket").applyInArrow(bucket, "a binary, b binary, key long").distinct()


def _verified(rest: DataFrame, marks: DataFrame, fetch, percent: int, n_buckets: int) -> DataFrame:
    """Links (a, b) of classes of one group that are in different components, all of them but for those between classes
    that other links of the same meeting join.  Classes that are in no pair whose signatures allow a link stay behind; the
    sets of the others come to their meetings."""
    def involved(t: pa.Table) -> pa.Table:
        found = []
        for m in _meetings(t):
            used = np.zeros(len(m), bool)
            for i, those, _ in _passing(m, percent, column(m, "component").dictionary_encode().indices.to_numpy()):
                used[i] = used[those] = True
            found.append(m.filter(pa.array(used)))
        return pa.concat_tables(found).select(kept)

    def bucket(t: pa.Table) -> pa.Table:
        found = []
        for m in _meetings(t):
            part = column(m, "component").dictionary_encode().indices.to_numpy()
            sets, n, cls, forest = column(m, "elements"), column(m, "n").to_pylist(), column(m, "cls"), _Forest(part)
            for i, those, _ in _passing(m, percent, part):
                for j in those.tolist():
                    if forest.root(i) != forest.root(j) and _similar(sets[i].as_buffer(), n[i], sets[j].as_buffer(), n[j], percent):
                        forest.join(i, j)
                        found.append((cls[i].as_py(), cls[j].as_py()))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    dealt = _dealt(rest, marks, n_buckets)
    kept = dealt.columns
    left = reliable_checkpoint(dealt.groupBy("bucket").applyInArrow(involved, dealt.schema))
    sets = fetch(left.select("place"))
    both = left.join(sets.select("cls", "place", F.col("data").alias("elements")), ["cls", "place"])
    return both.groupBy("bucket").applyInArrow(bucket, "a binary, b binary").distinct()


def _similar(x, n_x: int, y, n_y: int, percent: int) -> bool:
    """Whether two sorted sets link."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return 100 * shared >= percent * (n_x + n_y - shared)


def _fetch(src: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """(cls, place, n, data) with the sorted sets of the rows named in ``places`` (place).  A fixed-size filter of places
    goes to the tasks, which make sets of the rows that pass.  Other rows pass by chance: join by class and place."""
    bit = F.pmod(F.col("place"), F.lit(FILTER_WORDS * 64))
    mask = F.expr(f"shiftleft(1L, cast(pmod(pmod(place, {FILTER_WORDS * 64}), 64) as int))")
    got = places.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask")).toPandas()  # at most FILTER_WORDS rows
    marks = np.zeros(FILTER_WORDS, np.int64)
    marks[got["word"]] = got["mask"]
    passes = src.sparkSession.sparkContext.broadcast(marks.view(np.uint64))

    def fetch(batches):
        for b in slices(batches):
            bit = np.mod(b.column(b.schema.get_field_index("place")).to_numpy(), FILTER_WORDS * 64).astype(np.int64)
            hit = (passes.value[bit // 64] >> (bit % 64).astype(U64)) & U64(1)
            b = b.filter(pa.array(hit.astype(bool)))
            sets = _sets(b, shingle) if b.num_rows else []
            here = [i for i, s in enumerate(sets) if len(s)]
            place = b.column(b.schema.get_field_index("place")).take(pa.array(here, pa.int64()))
            cols = [pa.array([_digest(sets[i]) for i in here], pa.binary()), place, pa.array([len(sets[i]) for i in here], pa.int64()), pa.array([sets[i].astype("<u8").tobytes() for i in here], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["cls", "place", "n", "data"])

    out = reliable_checkpoint(src.select("text", "place").mapInArrow(fetch, "cls binary, place long, n long, data binary"))
    passes.destroy()
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, n_buckets: int | None = None) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``component``, ``row_file``, ``row_no``, ``cls``.

    ``component_id`` is the smallest id that links lead to; ``component`` names the component itself (null for a set
    without shingles), also where ids are null or repeated.  A text of fewer words than a shingle is one shingle; null and
    empty texts and texts without words have none and link with nothing.  A null id is never the smallest unless all ids
    of a component are null.  Repeated rows link with each other.  An empty table gives an empty result.  Other columns
    are not read."""
    if not 50 < percent <= 100:
        raise ValueError("percent is 51 to 100")
    spark, n = docs.sparkSession, buckets(docs, n_buckets)
    src = arrange(docs, {id_col: "id", text_col: "text"}).select(
        "id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "block", "row_file", "row_no", F.xxhash64("row_file", "row_no").alias("place"))
    kind = dict(src.dtypes)["id"]

    # 1. classes of documents, and the sketch of shingle counts
    def classify(batches):
        sketch = np.zeros(CELLS, np.uint8)  # a task counts to 255
        null = lambda n, t: pa.nulls(n, t)
        id_type = None
        names = ["id", "row_file", "row_no", "place", "n", "cls", "bits", "part", "counts"]
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            sets = _sets(b, shingle)
            id_type = column(t, "id").type
            digests = [_digest(s) if len(s) else None for s in sets]
            for s in {d: s for d, s in zip(digests, sets, strict=True) if d}.values():
                at = _cells(s)
                sketch[at] += sketch[at] < 255
            yield pa.RecordBatch.from_arrays(
                [*(column(t, c) for c in names[:4]), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                 null(len(sets), pa.int32()), null(len(sets), pa.binary())], names)
        if id_type is not None:
            cells = [pack(3, n=x) for x in sketch.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays(
                [null(PARTS, id_type), null(PARTS, pa.string()), null(PARTS, pa.int64()), null(PARTS, pa.int64()), null(PARTS, pa.int64()), null(PARTS, pa.binary()), null(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(cells, pa.binary())], names)

    first = reliable_checkpoint(src.mapInArrow(classify, f"id {kind}, row_file string, row_no long, place long, n long, cls binary, bits binary, part int, counts binary"))
    rows = first.where("part is null").select("id", "row_file", "row_no", "place", "n", "cls", "bits")
    rarity = spark.sparkContext.broadcast(_rarity(first.where("part is not null").select("part", "counts")))

    # 2. prefixes: packed keys by bucket; combinations are only carried along
    def index(batches):
        counts, limit = rarity.value
        for block, parts in runs(batches):
            seen, keys, owner, combos, combo_owner = {}, [], [], [], []
            for b in parts:
                for s in _sets(b, shingle):
                    if not len(s) or (d := _digest(s)) in seen:
                        continue
                    c = counts[_cells(s)]
                    order = np.lexsort((s, c))
                    single, pairs = prefix_keys(s[order], c[order] > limit, percent)
                    i = len(seen)
                    seen[d] = len(s)
                    keys.append(mix(single) & KEY)
                    owner.append(np.full(len(single), i, np.int32))
                    combos.append(pairs & KEY)
                    combo_owner.append(np.full(len(pairs), i, np.int32))
            if not seen:
                continue
            names, size = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            out = []
            for which, (ks, os) in enumerate(((keys, owner), (combos, combo_owner))):
                ks, os = np.concatenate(ks), np.concatenate(os)
                where = (ks % U64(n)).astype(np.int64) if which == 0 else np.full(len(ks), -1 - block % n)
                order = np.lexsort((ks, where))
                ks, os, where = ks[order], os[order], where[order]
                cuts = np.flatnonzero(np.diff(where)) + 1
                for k, o, w in zip(np.split(ks, cuts), np.split(os, cuts), np.split(where, cuts), strict=True):
                    if len(k):
                        used, local = np.unique(o, return_inverse=True)
                        step = np.diff(k, prepend=U64(0))
                        out.append((int(w[0]), pack(step=step, doc=local.astype(np.int32)), pack(cls=pa.array([names[u] for u in used], pa.binary()), n=size[used])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "keys", "docs"])

    def meet(t: pa.Table) -> pa.Table:
        keys, owner, cls, size, at = [], [], [], [], 0
        for k, d in zip(t.column("keys"), t.column("docs"), strict=True):
            k, d = unpack(k.as_py()), unpack(d.as_py())
            keys.append(np.cumsum(column(k, "step").to_numpy()))
            owner.append(column(k, "doc").to_numpy().astype(np.int64) + at)
            cls.append(column(d, "cls"))
            size.append(column(d, "n").to_numpy())
            at += len(d)
        named = pa.concat_arrays(cls).dictionary_encode()
        number = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.zeros(len(named.dictionary), np.int64)
        sizes[number] = np.concatenate(size)
        key, who = np.concatenate(keys), number[np.concatenate(owner)]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        names = named.dictionary

        def give(kind, k, w, lead=None):
            w = np.asarray(w, np.int64)
            return pa.table({
                "kind": pa.array(np.full(len(w), kind), pa.int32()), "key": pa.array(np.asarray(k, U64).astype(np.int64)), "cls": names.take(pa.array(w)),
                "n": sizes[w], "leader": pa.nulls(len(w), pa.binary()) if lead is None else names.take(pa.array(np.asarray(lead, np.int64)))})

        if t.column("bucket")[0].as_py() < 0:
            return give(COMMON, key, who)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(begin, len(key)))
        many = np.flatnonzero(count > 1)
        lead = np.repeat(who[begin], count)
        star = np.repeat(count > 1, count) & (who != lead)
        small = np.minimum(sizes[who], sizes[lead]) * 100 >= percent * np.maximum(sizes[who], sizes[lead])
        pairs = np.unique(np.stack([lead[star & small], who[star & small]], 1), axis=0)
        groups = {}  # groups of the same classes are one
        for g in many[count[many] > 2].tolist():
            members = who[begin[g] : begin[g] + count[g]]
            groups.setdefault(members.tobytes(), (key[begin[g]], members))
        kept = list(groups.values())
        return pa.concat_tables([
            give(STAR, np.zeros(len(pairs)), pairs[:, 1], pairs[:, 0]),
            give(GROUP, np.concatenate([np.full(len(m), k) for k, m in kept]) if kept else [], np.concatenate([m for _, m in kept]) if kept else [])])

    found = reliable_checkpoint(src.mapInArrow(index, "bucket int, keys binary, docs binary").groupBy("bucket").applyInArrow(meet, "kind int, key long, cls binary, n long, leader binary"))
    rarity.destroy()
    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # 3. groups of combinations
    common = found.where(f"kind = {COMMON}").groupBy("key", "cls").agg(F.max("n").alias("n"))
    heads = common.groupBy("key").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    common = reliable_checkpoint(common.join(heads, "key"))
    groups = found.where(f"kind = {GROUP}").select("key", "cls", "n").unionByName(common.where("members > 2").select(F.bitwise_not("key").alias("key"), "cls", "n"))
    stars = found.where(f"kind = {STAR}").select(F.col("leader").alias("a"), F.col("cls").alias("b")).unionByName(common.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")))
    stars = reliable_checkpoint(stars.distinct())

    # 4. links among pairs: first by signatures, then by the sets of what is left
    wanted = stars.select(F.col("a").alias("cls")).unionByName(stars.select(F.col("b").alias("cls"))).unionByName(groups.select("cls")).distinct()
    places = rows.where("cls is not null").groupBy("cls").agg(F.min("place").alias("place")).join(wanted, "cls")
    marks = reliable_checkpoint(rows.select("cls", "place", "n", F.col("bits").alias("data")).join(places, ["cls", "place"]))
    places = marks.select("cls", "place")

    def linked(pairs: DataFrame) -> DataFrame:
        return confirmed(_pairs_that(pairs, marks, lambda x, n_x, y, n_y: _may_link(x, n_x, y, n_y, percent)))

    def placed(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(places.select(F.col("cls").alias(c), F.col("place").alias(f"{c}_place")), c)
        return pairs

    def confirmed(left: DataFrame) -> DataFrame:
        left = reliable_checkpoint(left)
        if left.isEmpty():
            return left.select("a", "b")
        sets = _fetch(src, left.select(F.col("a_place").alias("place")).unionByName(left.select(F.col("b_place").alias("place"))), shingle)
        return reliable_checkpoint(_pairs_that(left, sets, lambda x, n_x, y, n_y: _similar(x, n_x, y, n_y, percent)).select("a", "b"))

    # 5. links and components
    whole = reliable_checkpoint(components(linked(stars)))
    before, turn, stage = math.inf, 0, "leaders"
    while True:
        named = groups.join(whole.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        open_keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("square")).where("parts > 1")
        rest = reliable_checkpoint(named.join(open_keys, "key"))
        left = rest.groupBy("key").agg(F.first("size").alias("size"), F.first("square").alias("square")).agg(F.sum(F.col("size") * F.col("size") - F.col("square")), F.sum("size")).first()
        if not left[0]:
            break
        if stage == "leaders" and (turn == ROUNDS or left[0] <= LEFT * left[1] or left[0] > before / 2):
            stage = "proposals"
        before = left[0]
        if stage == "leaders":  # another leader for each group
            heads = rest.groupBy("key").agg(F.max_by(F.struct("cls", "n", "component"), F.xxhash64("cls", F.lit(turn))).alias("head"))
            pairs = rest.join(heads, "key").where((F.col("component") != F.col("head.component")) & close(F.col("n"), F.col("head.n"))).select(F.col("head.cls").alias("a"), F.col("cls").alias("b"))
            more = linked(pairs.distinct())
        elif stage == "proposals":  # most of what signatures allow is a link, so little of dense groups is left for the last turn
            asked = reliable_checkpoint(_proposed(rest, marks, percent, n))
            more, dense = confirmed(placed(asked.where("key is null").select("a", "b"))), asked.where("key is not null").select("key")
        else:
            more = reliable_checkpoint(_verified(rest, marks, lambda places: _fetch(src, places, shingle), percent, n))
        if not more.isEmpty():
            whole = reliable_checkpoint(merged(whole, more))
        groups = rest.select("key", "cls", "n")  # components only grow, so a group in one component stays so
        if stage == "verified" or stage == "proposals" and dense.isEmpty():
            break
        if stage == "proposals":
            groups = reliable_checkpoint(groups.join(dense, "key", "left_semi"))
        turn, stage = turn + 1, "leaders" if stage == "leaders" else "verified"

    # 6. documents
    full = rows.where("cls is not null").join(whole.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = full.groupBy("component").agg(F.min("id").alias("component_id"))
    full = full.join(smallest, "component").select("id", "n", "component_id", "component", "row_file", "row_no", "cls")
    none = rows.where("cls is null").select("id", "n", F.col("id").alias("component_id"), F.col("cls").alias("component"), "row_file", "row_no", "cls")
    return full.unionByName(none).withColumnsRenamed({"id": id_col, "n": "n_shingles"})
