"""Best-fit packing by a grouping genetic algorithm on islands.

1. Documents are encoded in Arrow batches: pre-tokens of a batch are made distinct, new ones go through the tokenizer once,
   and the ids of a document are cut into pieces of at most ``CAPACITY``; only its first piece may be shorter.
2. Full pieces are sequences of their own.  The others are dealt to islands of about ``ISLAND`` pieces.
3. An island holds a population of packings.  Crossover injects whole well-filled sequences of one parent into the other,
   removes the sequences that hold any of the same documents, and puts the displaced documents back by best fit; mutation
   dissolves badly filled sequences.  After each epoch an island's elite migrates: the best-filled sequences of its best
   packing go, as lists of lengths, to another island, which rebuilds them from documents of its own of these lengths.
4. The emptiest sequences of every island are opened again, and their documents are dealt to fewer islands, until one is left.

An island is one row of packed arrays of bounded size, whatever the number of documents; the driver counts rows.  Every
epoch is written to the shared folder.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import PreTokens
from tessera.llm.common import arrange, column, gather, pack, slices, unpack
from tessera.session import reliable_checkpoint

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Pieces of an island, its packings, children of an epoch, epochs; sequences with more room than this share are opened
#: again, the emptiest first, half of an island's at most.
ISLAND, POPULATION, CHILDREN, EPOCHS, ROOM = 8192, 5, 40, 3, 1 / 64
#: Pre-tokens whose ids a worker remembers, those that go through the tokenizer as one text, and text bytes worked on at a time.
REMEMBERED, LINES, AT_ONCE = 1 << 19, 512, 2 << 20


@lru_cache(1)
def _tokenizer(config: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(config)
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


class Encoder:
    """Ids of pre-tokens, each through the tokenizer once as long as it is remembered."""

    def __init__(self, config: str):
        self.tokenizer = _tokenizer(config)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _as_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without white space but for a space in front, as lines of one text: a line's end is a pre-token of its
        own there, and its id is in no other."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else []
        if len(cut) != len(words) - 1:
            return self._one_by_one(words)
        return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

    def distinct(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words, whose ids are ids[at[number]:at[number + 1]]."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = words
        if new:
            texts = [w.decode() for w in new]
            blank = [w for w in texts if w.isspace()]
            plain = [w for w in texts if not w.isspace()]
            got = [self._as_lines(plain[i : i + LINES]) for i in range(0, len(plain), LINES)] + [self._one_by_one(blank)] * bool(blank)
            self.known |= {w.encode(): i for i, w in enumerate(plain + blank, len(self.known))}
            self.ids = np.concatenate([self.ids, *(x for x, _ in got)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([n for _, n in got]))])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin."""
        p = PreTokens(texts)
        coded = p.words().dictionary_encode()
        numbers = self.distinct(coded.dictionary.to_pylist())
        ids, at = gather(self.ids, self.at, numbers[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, at[p.row_at]


@lru_cache(1)
def _encoder(config: str) -> Encoder:
    """One for each Python worker, whose tasks follow one another."""
    return Encoder(config)


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these sizes: document, number of the piece, where it starts, and its length."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = sizes - (n - 1) * capacity
    return doc, piece, np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity), np.where(piece == 0, first[doc], capacity)


def pieces(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the id, row_file, row_no, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for,
    ``ids`` (little-endian unsigned 32-bit integers).  ``config`` is a tokenizer's JSON whose pre-tokens are those of
    ``public_tokenizers.PATTERN``.  Null and empty texts consist of the end alone."""
    src = arrange(docs, {id_col: "id", text_col: "text"}).select("id", "row_file", "row_no", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(config)

    def cut(batches):
        encoder = _encoder(sent.value)
        for b in slices(batches, most=AT_ONCE):
            t = pa.Table.from_batches([b])
            ids, at = encoder.encode(column(t, "text"))
            own = np.diff(at)
            whole = np.full(len(ids) + len(own), end, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own)] = ids
            doc, piece, start, length = cuts(own + 1, capacity)
            begin = (at[:-1] + np.arange(len(own)))[doc] + start
            data = memoryview(whole.tobytes())
            parts = [data[4 * i : 4 * (i + n)] for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
            out = t.select(["id", "row_file", "row_no"]).take(pa.array(doc))
            cols = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([bytes(x) for x in parts], pa.binary())
            for name, c in cols.items():
                out = out.append_column(name, c)
            yield from out.combine_chunks().to_batches()

    kind = dict(src.dtypes)["id"]
    out = src.mapInArrow(cut, f"id {kind}, row_file string, row_no long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


class Island:
    """Packings of one island's documents; a packing gives every document the number of its sequence."""

    def __init__(self, size: np.ndarray, capacity: int, seed: int):
        self.size, self.capacity, self.rng = size, capacity, np.random.default_rng(seed)
        self.bound = -(-int(size.sum()) // capacity)
        self.order = np.argsort(-size, kind="stable")

    def best_fit(self, items: np.ndarray, fill: list[int], where: np.ndarray) -> np.ndarray:
        """Puts documents, in this order, each into the sequence of least room that holds it, else into a new one."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r: some sequence has room r
        for b, f in enumerate(fill):
            if f < self.capacity:
                by_room[self.capacity - f].append(b)
                rooms |= 1 << (self.capacity - f)
        for i, z in zip(items.tolist(), self.size[items].tolist(), strict=True):
            if large := rooms >> z:
                room = z + (large & -large).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, b = self.capacity, len(fill)
                fill.append(0)
            where[i] = b
            fill[b] += z
            if room := room - z:
                by_room[room].append(b)
                rooms |= 1 << room
        return where

    def fills(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, self.size).astype(np.int64)

    def worth(self, where: np.ndarray) -> tuple[int, int]:
        """Less is better: the number of sequences, then how evenly they are filled."""
        f = self.fills(where)
        return len(f), -int((f * f).sum())

    def begin(self, population: int) -> list[np.ndarray]:
        """The first packing is best-fit decreasing; the others take the documents in a disturbed order."""
        out = []
        for k in range(population):
            order = self.order if k == 0 else np.argsort(-self.size * (1 + 0.1 * k * self.rng.random(len(self.size))), kind="stable")
            out.append(self.best_fit(order, [], np.empty(len(self.size), np.int32)))
            if len(self.fills(out[0])) == self.bound:
                break
        return out

    def inject(self, host: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The host with the groups (-1: none) as sequences: those of its sequences that hold a document of a group go,
        and their other documents are put back by best fit."""
        guest = group >= 0
        gone = np.zeros(int(host.max()) + 1, bool)
        gone[host[guest]] = True
        loose = gone[host] & ~guest
        label = np.where(guest, int(host.max()) + 1 + group, host)
        where = np.empty(len(host), np.int32)
        stay = ~loose
        where[stay] = np.unique(label[stay], return_inverse=True)[1]
        fill = np.bincount(where[stay], self.size[stay]).astype(np.int64).tolist() if stay.any() else []
        return self.best_fit(self.order[loose[self.order]], fill, where)

    def cross(self, host: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Injects well-filled sequences of ``other`` whose documents the host packs less well."""
        fill, there = self.fills(other), self.fills(host)
        gain = fill - np.bincount(other, there[host] * self.size) / np.maximum(fill, 1)
        gain = np.where(fill >= np.quantile(fill, 0.5), gain, -1) + self.rng.random(len(fill)) * self.capacity / 64
        n = max(1, len(fill) // 16)
        chosen = np.full(len(fill), -1)
        chosen[np.argsort(-gain)[:n]] = np.arange(n)
        return self.inject(host, chosen[other])

    def mutate(self, where: np.ndarray) -> np.ndarray:
        """Dissolves the emptiest sequences and some others."""
        fill = self.fills(where)
        n = max(1, len(fill) // 32)
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill, kind="stable")[:n]] = True
        gone[self.rng.integers(0, len(fill), n)] = True
        loose, out = gone[where], np.empty(len(where), np.int32)
        out[~loose] = np.unique(where[~loose], return_inverse=True)[1]
        kept = np.bincount(out[~loose], self.size[~loose]).astype(np.int64).tolist() if (~loose).any() else []
        return self.best_fit(self.order[loose[self.order]], kept, out)

    def settle(self, host: np.ndarray, bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rebuilds sequences of another island (numbers and lengths) from own documents, those of the emptiest first."""
        order = np.lexsort((self.fills(host)[host], self.size))
        lengths, begin = np.unique(self.size[order], return_index=True)
        stop = np.append(begin[1:], len(order)).tolist()
        begin, place = begin.tolist(), {z: i for i, z in enumerate(lengths.tolist())}
        group, made = np.full(len(host), -1), 0
        for one in np.split(sizes, np.flatnonzero(np.diff(bins)) + 1):
            taken = []
            for z in one.tolist():
                i = place.get(z, -1)
                if i < 0 or begin[i] == stop[i]:
                    break
                taken.append(order[begin[i]])
                begin[i] += 1
            if len(taken) == len(one):
                group[taken] = made
                made += 1
        return self.inject(host, group) if made else host

    def evolve(self, packings: list[np.ndarray], children: int) -> list[np.ndarray]:
        """The packings after so many children, best first; a child takes the place of the worst if it is better."""
        ranked = sorted(((self.worth(p), p) for p in packings), key=lambda x: x[0])
        for _ in range(children):
            if ranked[0][0][0] == self.bound:
                break
            a, b = ranked[int(self.rng.integers(0, max(1, len(ranked) // 2)))][1], ranked[int(self.rng.integers(0, len(ranked)))][1]
            child = self.mutate(a) if a is b else self.cross(a, b)
            worth = self.worth(child)
            if all(worth != w for w, _ in ranked) and worth < ranked[-1][0]:
                ranked = sorted([*ranked[:-1], (worth, child)], key=lambda x: x[0])
        return [p for _, p in ranked]

    def elite(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best-filled quarter of the sequences: number and length of each document."""
        fill = self.fills(where)
        best = np.zeros(len(fill), bool)
        best[np.argsort(-fill, kind="stable")[: max(1, len(fill) // 4)]] = True
        at = np.flatnonzero(best[where])
        at = at[np.argsort(where[at], kind="stable")]
        return where[at], self.size[at]


def _evolved(rows: DataFrame, names: list[str], n: int, level: int, capacity: int) -> DataFrame:
    """One row per island (island, kind, cell): its documents with their sequences in the best packing."""
    def state(island: int, t: pa.Table, packings: list[np.ndarray]) -> tuple:
        return island, "state", pack(**{f"c{i}": column(t, f"c{i}") for i in range(len(names))}, size=column(t, "size"), **{f"p{i}": p for i, p in enumerate(packings)})

    def turn(island: int, t: pa.Table, packings: list[np.ndarray], guests: list[pa.Table], epoch: int) -> list[tuple]:
        here = Island(column(t, "size").to_numpy(), capacity, level << 40 ^ island << 8 ^ epoch)
        packings = packings or here.begin(POPULATION)
        if here.worth(packings[0])[0] > here.bound:
            packings = packings[: max(1, POPULATION - len(guests))] + [here.settle(packings[0], column(g, "bin").to_numpy(), column(g, "size").to_numpy()) for g in guests]
            packings = here.evolve(packings, CHILDREN)
        if epoch == EPOCHS - 1 or n == 1:
            return [state(island, t, packings[:1])]
        bins, sizes = here.elite(packings[0])
        return [state(island, t, packings), ((island + 1 + epoch) % n, "guests", pack(bin=bins.astype(np.int32), size=sizes.astype(np.int32)))]

    def table(out: list[tuple]) -> pa.Table:
        return pa.table({"island": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.string()), "cell": pa.array([x[2] for x in out], pa.binary())})

    def found(t: pa.Table) -> pa.Table:
        return table(turn(t.column("island")[0].as_py(), t, [], [], 0))

    def again(t: pa.Table, epoch: int) -> pa.Table:
        island, held, guests = t.column("island")[0].as_py(), None, []
        for kind, cell in zip(t.column("kind").to_pylist(), t.column("cell"), strict=True):
            if kind == "state":
                held = unpack(cell.as_py())
            else:
                guests.append(unpack(cell.as_py()))
        if held is None:  # an island without documents
            return table([])
        packings = [column(held, c).to_numpy() for c in held.column_names if c.startswith("p")]
        return table(turn(island, held, packings, guests, epoch))

    def in_epoch(epoch: int):
        return lambda t: again(t, epoch)

    schema = "island long, kind string, cell binary"
    out = reliable_checkpoint(rows.groupBy("island").applyInArrow(found, schema))
    for epoch in range(1, EPOCHS if n > 1 else 1):
        out = reliable_checkpoint(out.groupBy("island").applyInArrow(in_epoch(epoch), schema))
    return out


def pack_rows(rows: DataFrame, length_col: str = "length", capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """The columns of ``rows`` with ``sequence_id`` and ``offset``: rows of one sequence lie one after the other from 0 on,
    and their lengths sum up to ``capacity`` at most.

    Lengths are 1 to ``capacity``; a null or other length is an error.  Equal rows are packed one by one; an empty table
    gives an empty result; of columns that have one of the new names, the new one stays."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    fields = [rows.schema[c].dataType.simpleString() for c in names]
    size = F.col(f"`{length_col}`").cast("int")
    bad = F.when(~F.coalesce(size.between(1, capacity), F.lit(False)), F.raise_error(F.lit(f"a length that is not 1 to {capacity}"))).cast("int")
    rows = reliable_checkpoint(rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(bad, size).alias("size")))
    own = [f"c{i}" for i in range(len(names))]
    full = rows.where(F.col("size") == capacity).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    done, rest, level, n = [full], rows.where(F.col("size") < capacity), 0, None
    while count := rest.count():
        n = max(1, min(-(-count // island), n // 2 if n else count))
        # the number of a row only spreads rows; a hash of all columns would send copies to one island
        dealt = rest.withColumn("island", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(n)))

        def settle(batches, level=level, n=n):
            for b in batches:
                for number, kind, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if kind != "state":
                        continue
                    t = unpack(cell.as_py())
                    here = Island(column(t, "size").to_numpy(), capacity, 0)
                    where = column(t, "p0").to_numpy()
                    fill = here.fills(where)
                    order = np.argsort(where, kind="stable")
                    ahead = np.cumsum(here.size[order]) - here.size[order]
                    begin = np.concatenate([[0], np.cumsum(fill)])
                    offset = np.empty(len(where), np.int64)
                    offset[order] = ahead - begin[where[order]]
                    opened = np.zeros(len(fill), bool)
                    if n > 1:
                        bad = int((capacity - fill > capacity * ROOM).sum())
                        opened[np.argsort(fill, kind="stable")[: max(1, min(bad, len(fill) // 2))]] = True
                    sequence = pa.array((level << 52) + (number << 16) + where.astype(np.int64), mask=opened[where])
                    out = t.select([*own, "size"]).append_column("sequence_id", sequence).append_column("offset", pa.array(offset))
                    yield from out.combine_chunks().to_batches()

        schema = ", ".join([*(f"{c} {k}" for c, k in zip(own, fields, strict=True)), "size int, sequence_id long, offset long"])
        placed = reliable_checkpoint(_evolved(dealt.select("island", *own, "size"), names, n, level, capacity).mapInArrow(settle, schema))
        done.append(placed.where("sequence_id is not null").select(*own, "sequence_id", "offset"))
        rest = placed.where("sequence_id is null").select(*own, "size")
        level += 1
        if n == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnsRenamed(dict(zip(own, names, strict=True)))


def pack_documents(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, island: int = ISLAND) -> DataFrame:
    """One row per piece of a document: the id, row_file, row_no, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.

    Null and empty texts are one piece, their end; a null id stays null; repeated rows are packed one by one; texts longer
    than a sequence are cut; an empty table gives an empty result; other columns are not read."""
    return pack_rows(pieces(docs, config, id_col, text_col, capacity, end), "length", capacity, island)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """sequence_id, ``documents`` and ``ids`` of each sequence of ``packed``; ``with_ids`` are its pieces with their ids."""
    place = ["row_file", "row_no", "piece"]
    rows = packed.select(*place, "sequence_id", "offset").join(with_ids.select(*place, "ids"), place)
    listed = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))  # at most ``capacity`` ids
    return rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("documents"), F.unhex(F.array_join(F.transform(listed, lambda x: x["ids"]), "")).alias("ids"))
