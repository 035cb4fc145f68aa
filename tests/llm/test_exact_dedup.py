import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import keep_rows, landed
from tessera.llm.exact_dedup import exact_dedup, sha256
from tests.conftest import SF001
from tests.llm.helpers import no_docs, odd_docs


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    return sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest", [sha256, lambda c: (F.crc32(c.cast("binary")) % 5).cast("string")], ids=["sha256", "colliding"])
def test_odd_rows(spark, digest):
    docs = odd_docs(spark)
    got = exact_dedup(docs, digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected([(r.doc_id, r.text) for r in docs.collect()])
    texts = {lower(r.text) for r in docs.collect()}
    kept = [r for r in got if r.kept]
    assert len(kept) == len(texts) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = exact_dedup(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert keep_rows(landed(docs), got.where("kept")).count() == got.select("text_sha256").distinct().count()


def test_empty_table(spark):
    assert exact_dedup(no_docs(spark)).count() == 0
