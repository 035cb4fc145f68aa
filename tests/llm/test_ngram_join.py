import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ngram_join as module
from tessera.llm.ngram_join import components, ngram_join, prefix_keys
from tests.conftest import SF01
from tests.llm.helpers import docs_of, no_docs, odd_docs


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shared = {}
    for at in where.values():
        for a in range(len(at)):
            for b in range(a):
                shared[at[b], at[a]] = shared.get((at[b], at[a]), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((doc, len(s), low.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def got(docs, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, **kw).collect()), key=str)


@settings(max_examples=1500, deadline=None)
@given(st.data())
def test_prefixes_meet_when_sets_link(data):
    n, rng = data.draw(st.integers(1, 40)), random.Random(data.draw(st.integers()))
    x = set(rng.sample(range(1000), n))
    y = {e for e in x if rng.random() > data.draw(st.sampled_from([0, 0.05, 0.12]))} | set(rng.sample(range(1000, 2000), rng.randint(0, max(1, n // 5))))
    rare = data.draw(st.sampled_from([0.0, 0.05, 0.2, 0.5, 1.0]))
    often = {e for e in range(2000) if rng.random() >= rare}
    keys = []
    for s in (x, y):
        if not s:
            return
        a = np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(a)
        f = np.array([e in often for e in sorted(s)])[order]
        single, pairs = prefix_keys(a[order], f)
        assert len(single) + len(pairs) <= len(s) + 1
        keys.append({("s", k) for k in single.tolist()} | {("p", k) for k in pairs.tolist()})
    if 100 * len(x & y) >= 75 * len(x | y):
        assert keys[0] & keys[1]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 900), st.floats(0, 0.4), st.integers())
def test_signatures_pass_all_sets_that_link(n, change, seed):
    rng = np.random.default_rng(abs(seed))
    x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    y = np.unique(np.concatenate([x[rng.random(len(x)) > change], rng.integers(0, 1 << 63, int(n * change * rng.random())).astype(np.uint64)]))
    if not len(y):
        return
    shared = len(np.intersect1d(x, y))
    links = 100 * shared >= 75 * (len(x) + len(y) - shared)
    assert module._similar(x.tobytes(), len(x), y.tobytes(), len(y), 75) == links
    may = module._may_link(module._signature(x), len(x), module._signature(y), len(y), 75)
    assert may or not links
    z = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    assert n < 50 or not module._may_link(module._signature(x), len(x), module._signature(z), len(z), 75)


def variants(seed=3):
    rng, texts = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 40, 90]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy if rng.random() < 0.7 else copy[: len(copy) - rng.randint(0, len(copy) // 4)]))
    for _ in range(40):  # mostly one passage
        texts.append(" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 14))))
    for i in range(30):  # a chain: neighbours link, ends don't
        texts.append(" ".join(f"c{j}" for j in range(i * 2, i * 2 + 60)))
    texts += ["a b", "A  b", "a b c d e", "a b c d e f", ""] + ["x y z x y z x y z"] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent,left", [("none", 20), ("some", 0), ("all", 20)])
def test_against_brute_force(spark, monkeypatch, frequent, left):
    top = {"none": 1, "some": 4, "all": 5}[frequent]
    counts = np.random.default_rng(5).integers(4 if frequent == "all" else 0, top, module.CELLS).astype(np.uint16)
    monkeypatch.setattr(module, "_rarity", lambda sketch: (counts, 1))
    monkeypatch.setattr(module, "LEFT", left)
    monkeypatch.setattr(module, "WIDTH", 7)
    monkeypatch.setattr(module, "FEW", 0 if left else 2)
    texts = variants()
    assert got(docs_of(spark, texts), n_buckets=3) == brute(list(enumerate(texts)))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert any(a != c for a, _, c in want)


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(no_docs(spark)) == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in pairs], "a string, b string")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {f"{x:04}": f"{root(x):04}" for p in pairs for x in p if p[0] != p[1]}
    rows = components(edges).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    written, real = [], module.reliable_checkpoint
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df: (written.append(df), real(df))[1])
    rows = components(spark.createDataFrame([("a", "b"), ("c", "a"), ("x", "y")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in rows} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert len(written) == 1


def test_merged_is_components_of_all_edges(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(150):04}", f"{rng.randrange(150):04}") for _ in range(110)]
    frame = lambda e: spark.createDataFrame(e, "a string, b string")
    want = {(r.node, r.component) for r in components(frame(edges)).collect()}
    rows = module.merged(components(frame(edges[:60])), frame(edges[60:])).collect()
    assert {(r.node, r.component) for r in rows} == want and len(rows) == len(want)


def test_fetched_sets_are_not_shuffled(spark, monkeypatch):
    plans, real = [], module.reliable_checkpoint
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), real(df))[1])
    texts = [" ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(21))]
    assert {c for _, _, c in got(docs_of(spark, texts))} == {0}
    sets = [p for cols, p in plans if "place" in cols and "data" in cols and "MapInArrow" in p]
    assert sets and not any("Exchange" in p for p in sets)
