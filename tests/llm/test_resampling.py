import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import Words
from tessera.llm.resampling import feature_crcs, resample, smallest
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, percent=25, least=20):
    cells = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = cells(x for _, x in docs), cells(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, (doc, text) in enumerate(docs):
        n, found = features(text)
        got = [math.floor(1000 * math.log((t[c] + 1) * (s_all + 10000) / ((s[c] + 1) * (t_all + 10000)))) for c in (zlib.crc32(f.encode()) % 10000 for f in found)]
        weight = sum(got) // len(got) if got else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(*args, **kw):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(*args, **kw).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1 é-日"), max_size=40), min_size=1, max_size=5))
def test_checksums(texts):
    texts = [*texts, "x" * 64 + " " + "y" * 65 + " z", "w " + "v" * 200 + " " + "u" * 63]
    w = Words(pa.array(texts), Words.LETTERS)
    one, two, _ = feature_crcs(w)
    want = [features(t) for t in texts]
    assert one.tolist() == [zlib.crc32(f.encode()) for n, x in want for f in x[:n]]
    assert two.tolist() == [zlib.crc32(f.encode()) for n, x in want for f in x[n:]]


def test_documents(spark):
    docs, target = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(docs, target) == want
    assert sum(r[4] is not None for r in want) > 10


def test_odd_rows(spark):
    target = spark.createDataFrame([("word word", 1), (None, 2)], "text string, cells int")
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for kw in ({}, {"percent": 100, "least": 1}, {"percent": 0}, {"least": 10**6}):
        assert got(docs, target, **kw) == brute(rows, ["word word"], **kw)
    assert got(no_docs(spark), target) == []
    assert got(docs, target.limit(0)) == brute(rows, [])


def test_ties_and_repeated_rows(spark):
    rows = [(i % 7 if i % 5 else None, "same text of words") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    target = spark.createDataFrame([("other words",)], "text string")
    assert got(docs, target, least=1, percent=50) == brute(rows, ["other words"], least=1, percent=50)


def test_quickselect(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice([None, "a", "b"]), i // 3) for i in range(400)]
    keys = spark.createDataFrame(rows, "x int, y string, z long")
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for k in (1, 7, 200, 399, 400):
        assert smallest(keys, k, pivots=3) == order[k - 1]
    assert np.all([smallest(keys.limit(1), 1) is not None])
