import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.pii import find_pii
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.kind in PLAIN]


def test_documents_and_odd_rows(spark):
    for docs in (spark.read.parquet(f"{SF001}/documents.parquet"), odd_docs(spark)):
        texts = docs.select("doc_id", "text").collect()
        got = sorted((r.doc_id, base(r.spans)) for r in find_pii(docs).collect())
        assert got == sorted((r.doc_id, plain(r.text)) for r in texts)
    assert find_pii(no_docs(spark)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("01259.@-+ (aB_%é😀", max_size=40), min_size=60, max_size=60))
def test_patterns_match_the_plain_ones(spark, texts):
    got = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, base(r.spans)) for r in got) == [(i, plain(t)) for i, t in enumerate(texts)]


def test_added_kinds_and_scores(spark):
    texts = ["My IBAN: DE89 3704 0044 0532 0130 00 thanks", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "part 123-45-6789", "card 4111 1111 1111 1111", "4111 1111 1111 1111"]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s.kind, texts[0][s.start : s.end]) for s in got[0] if s.kind == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert not [s for s in got[1] if s.kind == "iban"]
    assert [s.kind for s in got[2]] == ["ssn"] and got[3] == []
    assert got[4][0].score > got[5][0].score


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a." * 100_000 + "@x", "1.1." * 50_000, "+" * 100_000, "+1 " * 50_000, "a@b.c " * 4_000, "A" * 200_000, "x@" + "a." * 100_000])
def test_long_runs(spark, text):
    t0 = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert find_pii(df).select(F.size("spans")).first()[0] >= 0
    assert time.time() - t0 < 40
