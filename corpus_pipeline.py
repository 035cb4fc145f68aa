"""The corpus pipeline: language identification, exact dedup, near-duplicates, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, language_id, ngram_join
from tessera.llm.common import keep_rows, landed, table
from tessera.llm.queries import bpe_digests
from tessera.session import reliable_checkpoint


def _whole(docs: DataFrame, *cols: str) -> DataFrame:
    """The columns named, and all others as ``row``, so that no column of ``docs`` clashes with a new one and no text
    stands twice in a row."""
    others = [c for c in docs.columns if c not in cols]
    return docs.select(*[F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] * bool(others), *cols)


def _again(found: DataFrame, docs: DataFrame, *cols: str) -> DataFrame:
    """The columns of ``docs``, after ``_whole``."""
    return found.select(*[F.col(c if c in cols else f"row.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language: those without letters, and those whose best codeword is not clearly nearer
    than the others, go."""
    found = language_id.language_id(_whole(docs, "doc_id", "text", "lang"))
    return _again(found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")), docs, "doc_id", "text", "lang")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    docs = landed(docs)
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of linked documents, and those that link with nothing (without
    words)."""
    docs = landed(docs)
    found = ngram_join.ngram_join(docs)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_file", "row_no")).alias("first"))
    kept = first.select("first.row_file", "first.row_no").unionByName(found.where("component is null").select("row_file", "row_no"))
    return keep_rows(docs, kept)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(_whole(docs, "text"), table(spark, sf_dir, "benchmark"))
    return _again(found.where(F.size("items") == 0), docs, "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    return bpe_digests(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", dedup),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("byte_bpe", tokens),
]

#: Language identification can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
