"""E3 / E4 with a word in every document, beyond the broadcast bound."""

import pytest

from tessera.operators import embed as E


def test_salted_word_vectors_equal_broadcast_ones(spark):
    texts = ["the " * (i % 3 + 1) + ["red apple", "blue car", "don't stop"][i % 3] + f" odd{i}" for i in range(120)] + ["", None, "unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wv = spark.createDataFrame([(w, [float(i), 1.0 / (i + 1)]) for i, w in enumerate(["the", "red", "apple", "car", "n't", "stop"])], "word string, vector array<double>")
    for embed in (E.mean_word_vector_embed, E.idf_weighted_word_vector_embed):
        got = [{r["doc_id"]: r["vector"] for r in embed(docs, wv, broadcast_bytes=b).collect()} for b in (1 << 20, 0)]
        assert len(got[0]) == 123 and got[0][120] is None and got[0][121] is None and got[0][122] is None
        assert set(got[0]) == set(got[1])
        assert all(got[1][d] == (None if v is None else pytest.approx(v)) for d, v in got[0].items())
