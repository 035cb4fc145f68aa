import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import common
from tessera.llm.byte_bpe import read_ranks
from tessera.llm.language_id import language_id
from tests.conftest import SF001
from tests.llm.helpers import DOCS, no_docs, odd_docs
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import lower
from tests.llm.test_ngram_join import brute as near


def expected(spark, docs, items):
    """The stages in plain Python, but for the predictions of the language model."""
    clear = {(r.doc_id, r.text) for r in language_id(docs).collect() if r.lang_pred != "und" and not r.ambiguous}
    rows = [(r.doc_id, r.text) for r in docs.collect() if (r.doc_id, r.text) in clear]
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), (-1, "")), (i, t))
    rows = list(best.values())
    rows = [r for r, (i, _, c) in zip(sorted(rows, key=lambda r: str((r[0],))), sorted(near(rows), key=lambda x: str((x[0],)))) if i == c]
    bad = {i for i, _, n, _ in contaminated(rows, items) if n}
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        if i not in bad:
            ids = np.array(library.encode_ordinary(t), "<u4")
            out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run(spark):
    docs, items = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF001).collect())
    assert got == expected(spark, docs, [(str(r.item_id), r.text) for r in items.collect()])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, name, stage):
    docs = odd_docs(spark)
    out = stage(spark, docs, SF001)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in DOCS]
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in out.collect())
    assert stage(spark, no_docs(spark), SF001).count() == 0


@pytest.mark.parametrize("name,stage", [s for s in corpus_pipeline.STAGES if s[0] in ("language_id", "decontaminate")])
def test_texts_go_to_the_workers_once(spark, monkeypatch, name, stage):
    docs = odd_docs(spark)
    sent, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: (sent.append(df.schema.simpleString()), real(df, f, schema))[1])
    stage(spark, docs, SF001)
    assert sent and all(s.count("text:string") == 1 for s in sent)


def test_slices_give_memory_back(monkeypatch):
    given = []
    pool = type("Pool", (), {"release_unused": lambda self: given.append(1)})
    monkeypatch.setattr(common.pa, "default_memory_pool", pool)
    texts = pa.RecordBatch.from_arrays([pa.array(["some text", None, "x"])], ["text"])
    assert [b.num_rows for b in common.slices([texts], most=4)] == [1, 2]
    assert len(given) == 2
