import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import Island, cuts, pack_documents, pack_rows, pieces, sequences
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


@pytest.fixture(scope="module")
def config():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def best_fit_decreasing(sizes, capacity):
    room = []
    for z in sorted(sizes, reverse=True):
        i = min((i for i, r in enumerate(room) if r >= z), key=lambda i: room[i], default=None)
        if i is None:
            room.append(capacity - z)
        else:
            room[i] -= z
    return len(room)


def laid_out(rows, capacity):
    """The number of sequences, after checks that pieces lie there without gaps."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=20), st.integers(1, 12))
def test_cuts(sizes, capacity):
    doc, piece, start, length = cuts(np.array(sizes), capacity)
    for i, n in enumerate(sizes):
        own = list(zip(piece[doc == i].tolist(), start[doc == i].tolist(), length[doc == i].tolist()))
        assert [p for p, _, _ in own] == list(range(-(-n // capacity)))
        assert all(z == capacity for p, _, z in own if p) and sum(z for _, _, z in own) == n
        assert [s for _, s, _ in own] == [sum(z for _, _, z in own[:k]) for k in range(len(own))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(0, 9))
def test_packings_stay_whole(sizes, seed):
    here = Island(np.array(sizes), 30, seed)
    packings = here.begin(4)
    assert len(here.fills(packings[0])) == best_fit_decreasing(sizes, 30)
    before = here.worth(packings[0])
    other = Island(np.array(sizes[::2]), 30, seed + 1)
    packings.append(here.settle(packings[0], *other.elite(other.begin(1)[0])))
    packings += [here.cross(packings[0], packings[-1]), here.mutate(packings[0])]
    packings = here.evolve(packings, 10)
    for p in packings:
        fill = here.fills(p)
        assert len(p) == len(sizes) and fill.max() <= 30 and fill.min() > 0
    assert here.worth(packings[0]) <= before


def test_crossover_injects_whole_sequences():
    here = Island(np.array([6, 5, 4, 3, 2]), 10, 0)
    host, other = np.array([0, 1, 1, 2, 2], np.int32), np.array([0, 1, 0, 1, 1], np.int32)  # 6 + 4, 5 + 3 + 2
    child = here.inject(host, np.array([0, -1, 0, -1, -1]))
    assert child[0] == child[2] and here.fills(child).tolist().count(10) >= 1
    assert len(here.fills(here.cross(host, other))) <= 3


def test_search_beats_best_fit():
    """Lengths of a quarter to a half: best-fit decreasing pairs the longest and leaves gaps that no other fills."""
    for seed in range(3):
        sizes = np.random.default_rng(seed).integers(250, 500, 1000)
        here = Island(sizes, 1000, seed)
        best = here.evolve(here.begin(5), 60)[0]
        assert here.bound <= len(here.fills(best)) < best_fit_decreasing(sizes.tolist(), 1000)


def check(spark, docs, config, **kw):
    library = Tokenizer.from_str(config)
    library.encode_special_tokens = True
    rows = pack_documents(docs, config, **kw).collect()
    capacity = kw.get("capacity", 1024)
    want = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        n = -(-len(ids) // capacity)
        edges = [0, *(len(ids) - capacity * k for k in range(n - 1, -1, -1))]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    return rows, laid_out(rows, capacity)


def test_documents(spark, config):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows, n = check(spark, docs, config)
    sizes = [r.length for r in rows]
    assert -(-sum(sizes) // 1024) <= n <= best_fit_decreasing(sizes, 1024)
    many, n_many = check(spark, docs, config, island=20)  # many islands and levels
    assert n_many <= best_fit_decreasing(sizes, 1024) * 1.03


def test_odd_rows(spark, config):
    docs = odd_docs(spark, texts=[None, "", " <|endoftext|> ", "x" * 3000, "word " * 20_000, "日本語 😀", "a", *["same"] * 30])
    check(spark, docs, config)
    check(spark, docs, config, capacity=7, island=4)
    assert pack_documents(no_docs(spark), config).count() == 0


def test_sequences(spark, config):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    packed = pack_documents(docs, config)
    made = {r.sequence_id: r for r in sequences(packed, pieces(docs, config, with_ids=True)).collect()}
    rows = packed.collect()
    assert sum(r.documents for r in made.values()) == len(rows)
    for r in rows:
        data = bytes(made[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(data) == r.ids_crc32


def test_rows_of_any_table(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a"]), rng.randint(1, 50), "x", [1.5], 3) for _ in range(700)]
    table = spark.createDataFrame(rows, "name string, length int, offset string, c0 array<double>, size int")
    out = pack_rows(table, "length", 50, island=30)
    assert out.columns == ["name", "length", "c0", "size", "sequence_id", "offset"]
    got = out.collect()
    assert sorted(((r.name, r.length) for r in got), key=str) == sorted((r[:2] for r in rows), key=str)
    assert laid_out(got, 50) <= best_fit_decreasing([r[1] for r in rows], 50) * 1.05
    assert pack_rows(table.limit(0)).count() == 0
    for bad in (0, None, 51):
        with pytest.raises(Exception, match="a length that is not"):
            pack_rows(spark.createDataFrame([(bad,)], "length int"), "length", 50).count()


def test_tiny_islands_end(spark):
    rows = spark.createDataFrame([(1,)] * 64, "length int")
    assert laid_out(pack_rows(rows, capacity=1000, island=2).collect(), 1000) == 1
