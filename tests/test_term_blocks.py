"""Documents packed in blocks: the same counts, weights and vectors as a row for each document and term."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.operators import term_blocks as TB
from tessera.operators import tfidf

TEXTS = ["red green green blue", None, "", "blue sky blue sky red", "x", "green sea the sea the sea", "sky the blue red", "ultra violet the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)


def _rows(df):
    return sorted((str(r["doc_id"]), r["term"], r["tf"], round(r["weight"], 12)) for r in df.collect())


@pytest.mark.parametrize("params", [tfidf.TfidfParams(), tfidf.TfidfParams(norm="l1", sublinear_tf=True, stop_words=("the",)),
                                    tfidf.TfidfParams(norm=None, binary=True, min_df=2), tfidf.TfidfParams(max_features=3)])
@pytest.mark.parametrize("ids", ["doc_id", "if(doc_id > 3, null, 'a')"])
def test_weights_are_those_of_the_long_form(docs, params, ids, monkeypatch):
    monkeypatch.setattr(TB, "BLOCK_PAIRS", 5)  # blocks of a document or two
    docs = docs.select(F.expr(ids).alias("doc_id"), "text")  # once unique, once repeated and null: those share a norm
    model, found = tfidf.tfidf_fit_transform(docs, params=params)
    plain = tfidf.tfidf_fit(docs, params=params)
    assert sorted(model.vocabulary.collect()) == sorted(plain.vocabulary.collect())
    assert _rows(found) == _rows(tfidf.tfidf_transform(docs, plain))


def test_a_block_looks_a_term_up_once(docs, monkeypatch):
    docs = docs.crossJoin(docs.sparkSession.range(40)).select((F.col("doc_id") * 40 + F.col("id")).alias("doc_id"), "text")
    packed = TB.pack_documents(tfidf.term_runs(docs))
    pairs = tfidf.term_counts(docs).count()
    terms = tfidf.term_counts(docs).select("term").distinct().count()
    assert packed.count() < docs.count() and TB.wanted(packed).count() < pairs
    _, weights = tfidf.tfidf_fit_transform(docs)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no document's terms are brought together by a shuffle and a sort
    assert TB.block_frequency(packed).count() == terms


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_mean_vectors_by_hand(docs, limit, monkeypatch):
    monkeypatch.setattr(TB, "BLOCK_PAIRS", 5)
    words = docs.sparkSession.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 2.0]), ("blue", [4.0, 4.0]), ("sea", [3.0, 3.0])], "word string, vector array<double>")
    twice = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    rows = E.mean_word_vector_embed(twice, words, tokenizer="word", broadcast_bytes=limit).collect()
    got = {r["doc_id"]: r["vector"] for r in rows}
    assert len(rows) == 17 and got[None] is None and got[1] is None and got[2] is None and got[4] is None
    assert np.allclose(got[0], [5 / 3, 2.0]) and np.allclose(got[3], [9 / 5, 12 / 5]) and np.allclose(got[5], [3.0, 3.0])
    model = tfidf.tfidf_fit(docs)
    idf = {r["term"]: r["idf"] for r in model.vocabulary.collect()}
    e = E.idf_weighted_word_vector_embed(docs, words, tokenizer="word", model=model, broadcast_bytes=limit).where("doc_id = 6").first()["vector"]
    assert np.allclose(e, np.array([idf["red"] + 4 * idf["blue"], 6 * idf["blue"]]) / 3)
