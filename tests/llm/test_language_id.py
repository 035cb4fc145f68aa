import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.language_id import GRAMS, codewords, grams, language_id
from tests.conftest import SF01
from tests.llm.helpers import DOCS, no_docs, odd_docs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 30, 200])
def test_codewords_differ(n):
    m = codewords(n)
    assert len({r.tobytes() for r in m}) == n
    if n > 1:
        assert ((m.sum(0) > 0) & (m.sum(0) < n)).all()


def test_grams_stay_in_their_text():
    bucket, at = grams(pa.array(["ab", "", None, "ab", "xyz"]))
    assert list(np.diff(at)) == [2, 0, 0, 2, 3]
    assert bucket[:2].tolist() == bucket[2:4].tolist()
    assert bucket.max() < GRAMS


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = language_id(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = language_id(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == letters
        assert r.block == "b" and r.digest == "d"


def test_no_labels_and_empty_table(spark):
    rows = [(1, "some text", None, "s", 9, "b", "d", "k", "i", "x"), (None, "text", "en", "s", 4, "b", "d", "k", "i", "x")]
    got = language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.lang_pred for r in got] == ["und", "und"] and {r.held_out for r in got} == {False} or zlib.crc32(b"1") % 5 == 0
    assert language_id(no_docs(spark)).count() == 0
