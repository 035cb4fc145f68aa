import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as module
from tessera.llm.decontaminate import decontaminate, n_hit
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(docs, items, **kw):
    rows = decontaminate(docs, items, **kw).select("doc_id", "n_words", n_hit(F.col("hit_spans")).alias("n"), F.array_sort("items").alias("items")).collect()
    return sorted(((r.doc_id, r.n_words, r.n, r["items"]) for r in rows), key=str)


ITEMS = [
    ("1", "one two three four five six seven eight nine ten eleven twelve"), ("2", "short item"), ("3", "a"), ("4", ""), ("5", None), ("6", "!!"),
    ("2", "another text of item two"), (None, "nameless item here"), ("7", "the the the the the the the the the the the the"), ("8", "two three four five six seven eight nine ten eleven"),
    ("9", "x y"), ("10", "naïve straße àéî"),
]
TEXTS = [
    "zero one two three four five six seven eight nine ten eleven twelve thirteen", "One, TWO; three four five six seven eight nine TEN", "two three four five six seven eight nine ten",
    "a short  item", "the " * 30, "the " * 9, "short short item item short item", None, "", "x Y", "nameless item here", "naïve straße àéî" * 1, "eleven twelve one two three",
    "one two three four five six seven eight nine ten eleven twelve " * 50,
]


@pytest.mark.parametrize("part_bytes", [8 << 20, 60])
def test_against_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(module, "PART_BYTES", part_bytes)
    monkeypatch.setattr(module, "AT_ONCE", 5)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert got(docs, items) == brute(list(enumerate(TEXTS)), ITEMS)


def test_documents(spark):
    docs, items = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in items.collect()])
    assert got(docs, items) == want
    assert any(r[2] for r in want)


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([("1", "abc def abc")], "item_id string, text string")
    docs = odd_docs(spark)
    assert got(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [("1", "abc def abc")])
    assert {r[2] for r in got(docs, items.limit(0))} == {0}
    assert got(no_docs(spark), items) == []
    assert set(docs.columns) <= set(decontaminate(docs, items).columns)
