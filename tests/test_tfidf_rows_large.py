"""E2 inside the rows under a vocabulary that is too large to be broadcast whole."""

import pytest

from tessera.operators import tfidf


def test_only_the_terms_of_the_rows_go_out(spark):
    fitted = spark.range(3_000).selectExpr("id as doc_id", "concat('word', id, ' red car') as text")
    model = tfidf.tfidf_fit(fitted)
    docs = spark.createDataFrame([("a", "red word5 unknown red"), ("a", "word7"), (None, "car word5"), ("e", ""), ("n", None)], "doc_id string, text string")
    got = tfidf.tfidf_transform_rows(docs, model, broadcast_bytes=2_000).collect()
    want = tfidf.tfidf_transform_rows(docs, model).collect()
    key = lambda r: (r.doc_id or "", r.term, r.tf)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 5
    assert sorted(r.weight for r in got) == pytest.approx(sorted(r.weight for r in want))
