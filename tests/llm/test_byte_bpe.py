import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.byte_bpe import PreTokens, decode, encode, merge, read_ranks
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stredlvm aé1²\n\t 　!?_日😀́"), max_size=30), min_size=1, max_size=6))
def test_pre_tokens(texts):
    p = PreTokens(pa.array(texts))
    data = p.raw.tobytes()
    for i, text in enumerate(texts):
        a, b = p.row_at[i], p.row_at[i + 1]
        assert [data[s:e].decode() for s, e in zip(p.starts[a:b], p.ends[a:b], strict=True)] == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merges_of_a_small_vocabulary(word):
    ranks = {bytes([i]): i for i in range(256)}
    for pair in (b"\x00\x00", b"ab", b"ba", b"aba", b"\x01\x00", b"\x00\x01", b"\x00\x00\x00"):
        ranks[pair] = len(ranks)
    library = tiktoken.Encoding("small", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert merge(word, ranks) == library._encode_single_piece(word)


def test_as_the_library(spark, ranks, library):
    for docs in (spark.read.parquet(f"{SF001}/documents.parquet"), odd_docs(spark)):
        texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
        got = sorted((r.doc_id, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()) for r in decode(encode(docs, ranks, n_buckets=3), ranks).collect())
        assert [(i, t) for i, t, _ in got] == texts
        assert [ids for _, _, ids in got] == [library.encode_ordinary(t) for _, t in texts]
        both = encode(docs, ranks, n_buckets=3, decoded=True).collect()
        assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in both) == texts


def test_empty_table(spark, ranks):
    assert encode(no_docs(spark), ranks).count() == 0
