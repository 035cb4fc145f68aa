"""E2 inside the document rows: equal to the joined form, and on a stream with its norm."""

import tempfile

import pytest

from tessera.operators import tfidf
from tessera.streaming.stateless import apply_fitted, run_to_memory

TEXTS = ["red apple red pie", "green apple", "unknown words only", "", None, "the red red red car " * 400, "blue"]


def _fitted(spark, **params):
    docs = spark.createDataFrame(list(enumerate(["red apple pie", "the green car", "blue car", "red the the"])), "doc_id long, text string")
    return tfidf.tfidf_fit(docs, params=tfidf.TfidfParams(**params))


def _rows(df):
    return {(r["doc_id"], r["term"], r["tf"]): r["weight"] for r in df.collect()}


@pytest.mark.parametrize("params", [dict(), dict(norm="l1", sublinear_tf=True), dict(norm=None, binary=True), dict(stop_words=("the",), use_idf=False)])
def test_rows_equal_the_join(spark, params):
    model = _fitted(spark, **params)
    docs = spark.createDataFrame([(f"d{i}", t, 1.0) for i, t in enumerate(TEXTS)], "doc_id string, text string, weight double")
    want, got = _rows(tfidf.tfidf_transform(docs, model)), _rows(tfidf.tfidf_transform_rows(docs, model))
    assert set(got) == set(want) and len(got) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert tfidf.tfidf_transform_rows(docs.where("false"), model).count() == 0


def test_no_shuffle_and_a_checked_broadcast(spark):
    model = _fitted(spark)
    docs = spark.createDataFrame([(1, "red"), (1, "red apple"), (None, "car")], "doc_id long, text string")
    out = tfidf.tfidf_transform_rows(docs.coalesce(1), model)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    assert sorted((r["doc_id"] or 0, r["term"]) for r in out.collect()) == [(0, "car"), (1, "apple"), (1, "red"), (1, "red")]
    with pytest.raises(ValueError, match="bytes"):
        tfidf.tfidf_transform_rows(docs, model, broadcast_bytes=10)


def test_stream_with_norm(spark):
    model = _fitted(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    d = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    docs.repartition(3).write.parquet(d + "/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    run_to_memory(apply_fitted(stream, lambda s: tfidf.tfidf_transform_rows(s, model)), "streamed_tfidf", d + "/ckpt")
    want, got = _rows(tfidf.tfidf_transform(docs, model)), _rows(spark.table("streamed_tfidf"))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
