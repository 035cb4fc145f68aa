import math
import re
from collections import Counter

import pytest

from tessera.llm import lexical_search as module
from tessera.llm.lexical_search import search
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs, thue_morse


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=50):
    bags = [(doc, Counter(terms(t))) for doc, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        words = set(terms(text))
        found = []
        for doc, b in bags:
            if not b:
                continue
            m = 100 - 50 + (50 * b.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m)) for w in words if b[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def got(docs, items, **kw):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(docs, items, **kw).collect()), key=str)


def test_documents(spark):
    docs, items = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs, items) == want
    assert len(want) > 50


@pytest.mark.parametrize("sizes", [(4 << 20, 32 << 20, 4096), (40, 300, 2)])
def test_ties_copies_and_parts(spark, monkeypatch, sizes):
    for name, value in zip(("PART_BYTES", "HELD_BYTES", "BLOCK"), sizes):
        monkeypatch.setattr(module, name, value)
    texts = ["red fox", "Red FOX!", "fox red blue", "blue", "fox", "fox fox red", "green " * 300 + "fox", "rare", None, ""] * 13 + ["blue sky"] * 90
    docs = [(None if i % 11 == 3 else (i * 37) % 101, t) for i, t in enumerate(texts)]
    items = [("a", "Red fox"), ("a", "blue"), (None, "rare fox"), ("b", ""), ("c", None), ("d", "unheard"), ("e", "sky the red blue fox")]
    items += [(f"f{i}", f"fox {i} blue") for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    named = spark.createDataFrame(items, "item_id string, text string")
    for top in (1, 7, 50):
        assert got(table, named, top=top) == brute(docs, items, top)


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "word a X"), (2, "naïve 日本語"), (3, thue_morse(1024)[0]), (4, "1 2 3")]
    named = spark.createDataFrame([(*i, "r", 1) for i in items], "item_id long, text string, rank string, score long")
    docs = odd_docs(spark)
    assert got(docs, named) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert got(no_docs(spark), named) == []
    assert got(docs, named.limit(0)) == []


def test_long_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_BYTES", 3)
    with pytest.raises(ValueError):
        search(odd_docs(spark), spark.createDataFrame([(1, "abcd")], "item_id long, text string"))
