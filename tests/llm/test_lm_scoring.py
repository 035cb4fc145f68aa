import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.lm_scoring import byte_grams, log_kt, score
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def is_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Tree:
    """Context-tree weighting as defined: block probabilities by recursion, predictions as ratios of them."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            for path in self.decisions(t):
                for node in path:
                    self.n[node] += 1

    def decisions(self, text):
        data = bytes([255]) * self.depth + lower(text).encode() + bytes([255])
        for i in range(self.depth, len(data)):
            for k in range(8):
                bit, prefix = (data[i] >> (7 - k)) & 1, (1 << k) | (data[i] >> (8 - k))
                yield [(prefix, data[i - d : i], bit) for d in range(self.depth + 1)]

    def kids(self):
        out = {}
        for prefix, context, _ in self.n:
            if context:
                out.setdefault((prefix, context[1:]), set()).add(context)
        return out

    def log_p(self, prefix, context, kids):
        own = float(log_kt(np.array([self.n[prefix, context, 0]]), np.array([self.n[prefix, context, 1]]))[0])
        if len(context) == self.depth:
            return own
        return np.logaddexp(own, sum(self.log_p(prefix, c, kids) for c in kids.get((prefix, context), ()))) - math.log(2)

    def score(self, text):
        total = 0.0
        for path in list(self.decisions(text)):
            kids = self.kids()
            before = self.log_p(path[0][0], b"", kids)
            for node in path:
                self.n[node] += 1
            after = self.log_p(path[0][0], b"", self.kids())
            for node in path:
                self.n[node] -= 1
                self.n += Counter()
            total += (after - before) / math.log(10)
        return total


def test_log_kt():
    for a, b in [(0, 0), (1, 0), (3, 5), (1000, 2)]:
        p, n0, n1 = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            p += math.log(((n1 if bit else n0) + 0.5) / (n0 + n1 + 1))
            n0, n1 = n0 + (bit == 0), n1 + bit
        assert log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(p, abs=1e-9)


def test_byte_grams():
    code, at = byte_grams(pa.array(["aB", None, "c"]), 2)
    assert [int(x).to_bytes(3) for x in code] == [b"\xff\xffa", b"\xffab", b"ab\xff", b"\xff\xff\xff", b"\xff\xffc", b"\xffc\xff"]
    assert at.tolist() == [0, 3, 4, 6]


def test_weighting_against_its_definition(spark):
    texts = ["abab", "aba", "Bbab", "a", None, "abc", "zz", "abab"]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert any(is_out(i) for i, _ in rows) and not all(is_out(i) for i, _ in rows)
    tree = Tree([t for i, t in rows if not is_out(i)], 2)
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), depth=2, n_buckets=3).collect()}
    for i, t in rows:
        assert got[i].held_out == is_out(i)
        assert got[i].score == pytest.approx(tree.score(t), rel=1e-5)


def base(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    c = Counter(w for i, t in rows if not is_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def test_base_and_gain(spark):
    for docs in (spark.read.parquet(f"{SF001}/documents.parquet"), odd_docs(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = score(docs, n_buckets=3).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
        assert all(r.score < 0 for r in got)
    real = score(spark.read.parquet(f"{SF001}/documents.parquet")).where("held_out").join(spark.read.parquet(f"{SF001}/documents.parquet"), "doc_id")
    sums = real.selectExpr("sum(score) s", "sum(octet_length(text) + 1) n").first()
    assert -sums.s / math.log10(2) / sums.n < 3.5  # bits for a byte


def test_empty_table(spark):
    assert score(no_docs(spark)).count() == 0
