"""TF-IDF in long form.

Plan shape, per document row:

1. tokens (F3/F5) -> ``array_sort`` -> run-length counts with higher-order
   functions: term frequencies are computed *inside the row*, so no shuffle
   is needed to build ``(doc_id, term, tf)``;
2. document frequency = ``groupBy(term)`` with map-side partial counts
   (the only vocabulary-wide shuffle);
3. idf joins back on ``term``: broadcast when the fitted vocabulary is
   below ``broadcast_terms`` (a counted, checked size), otherwise a shuffle
   join that AQE splits for hot terms;
4. the row norm is a per-document window sum (one shuffle by ``doc_id``).

``tfidf_fit_transform`` packs the documents in blocks (``term_blocks``): a block
sends one row a term to 2. and 3., and has its weights and norms in place.

An empty document contributes no rows (a zero vector).  idf follows the
classic smooth formula ``ln((1+n)/(1+df)) + 1`` (``ln(n/df) + 1`` unsmoothed),
which Spark ML's ``IDF`` does not implement.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import english_stop_words, tokens as token_expr
from tessera.operators import term_blocks as TB
from tessera.operators.hot_join import BROADCAST_BYTES, fits
from tessera.session import reliable_checkpoint, spread

BROADCAST_TERMS = 2_000_000


@dataclass(frozen=True)
class TfidfParams:
    lowercase: bool = True
    strip_accents: str | None = None
    analyzer: str = "word"
    stop_words: str | tuple | None = None
    max_df: float | int = 1.0
    min_df: float | int = 1
    max_features: int | None = None
    norm: str | None = "l2"
    use_idf: bool = True
    smooth_idf: bool = True
    sublinear_tf: bool = False
    binary: bool = False


@dataclass
class TfidfModel:
    """Fitted vocabulary ``(term, df, idf)`` plus the scalars of the fit."""

    vocabulary: DataFrame
    n_docs: int
    n_terms: int
    max_idf: float | None
    params: TfidfParams = field(default_factory=TfidfParams)

    def idf_table(self) -> DataFrame:
        v = self.vocabulary.select("term", "idf")
        return F.broadcast(v) if self.n_terms <= BROADCAST_TERMS else v

    def indexed_vocabulary(self) -> DataFrame:
        """Vocabulary with ``term_index`` = 0-based alphabetical position."""
        from tessera.sources.keys import add_row_number

        return add_row_number(self.vocabulary, ["term"], name="term_index", start=0)


def term_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              params: TfidfParams = TfidfParams(), token_fn=None) -> DataFrame:
    """``(doc_id, _runs)``: the terms of each document with their counts as one array of its row, stop words included."""
    if token_fn is not None:
        toks = token_fn(F.col(text_col))
    else:
        toks = token_expr(F.col(text_col), params.analyzer, params.lowercase, params.strip_accents)
    sorted_toks = spread(docs).select(F.col(id_col).alias("doc_id"), F.sort_array(toks).alias("_s"))
    with_starts = sorted_toks.select(
        "doc_id",
        "_s",
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))),
            lambda i: (F.size("_s") > 0)
            & ((i == 1) | (F.try_element_at(F.col("_s"), i) != F.try_element_at(F.col("_s"), i - 1))),
        ).alias("_st"),
    )
    return with_starts.select(
        "doc_id",
        F.transform(
            F.col("_st"),
            lambda st, j: F.struct(
                F.element_at(F.col("_s"), st).alias("term"),
                (F.coalesce(F.try_element_at(F.col("_st"), j + 2), F.size("_s") + 1) - st).cast("long").alias("tf"),
            ),
        ).alias("_runs"),
    )


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                params: TfidfParams = TfidfParams(), token_fn=None) -> DataFrame:
    """``(doc_id, term, tf)`` counted inside each document row (no shuffle).

    ``token_fn`` (text Column -> array Column) replaces the analyzer."""
    runs = term_runs(docs, id_col, text_col, params, token_fn)
    # inline_outer: a plain generator would make the optimizer infer a
    # ``size(...) > 0`` filter that copies the whole run-length expression.
    tc = runs.select("doc_id", F.inline_outer("_runs")).where(F.col("term").isNotNull())
    stop = _stop_words(params.stop_words)
    if stop:
        stop_df = docs.sparkSession.createDataFrame([(w,) for w in stop], "term string")
        tc = tc.join(F.broadcast(stop_df), "term", "left_anti").select("doc_id", "term", "tf")
    return tc


def _stop_words(stop_words) -> list[str]:
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        if stop_words != "english":
            raise ValueError("stop_words must be None, 'english' or a list of words")
        return english_stop_words()
    return list(stop_words)


def _doc_count_limit(value, n_docs: int) -> float:
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else float(value) * n_docs


def document_frequency(counts: DataFrame) -> DataFrame:
    """A2: ``(term, df, ctf)`` from term counts: documents containing the term
    and its corpus count."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def idf_expr(df_col: Column, n_docs: int, params: TfidfParams) -> Column:
    if not params.use_idf:
        return F.lit(1.0)
    n = F.lit(float(n_docs))
    if params.smooth_idf:
        return F.log((n + 1.0) / (df_col + 1.0)) + 1.0
    return F.log(n / df_col) + 1.0


def tfidf_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              params: TfidfParams = TfidfParams(), counts: DataFrame | None = None) -> TfidfModel:
    """Fit vocabulary and idf.  Actions: document count and vocabulary size."""
    counts = counts if counts is not None else term_counts(docs, id_col, text_col, params)
    return _fitted(document_frequency(counts), docs.count(), params)


def _fitted(dfreq: DataFrame, n_docs: int, params: TfidfParams) -> TfidfModel:
    """The model of ``dfreq`` (``term``, ``df``, ``ctf``) over ``n_docs`` documents."""
    hi = _doc_count_limit(params.max_df, n_docs)
    lo = _doc_count_limit(params.min_df, n_docs)
    if hi < lo:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    vocab = dfreq.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if params.max_features is not None:
        # Top terms by corpus count, ties alphabetical: a bounded top-k.
        vocab = vocab.orderBy(F.col("ctf").desc(), F.col("term")).limit(int(params.max_features))
    vocab = vocab.select("term", "df", idf_expr(F.col("df"), n_docs, params).alias("idf"))
    vocab = vocab.persist()
    stats = vocab.agg(F.count(F.lit(1)).alias("n"), F.max("idf").alias("m")).first()
    return TfidfModel(vocab, n_docs, int(stats["n"]), stats["m"], params)


def tfidf_transform(docs: DataFrame, model: TfidfModel, id_col: str = "doc_id", text_col: str = "text",
                    counts: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, tf, weight)`` for any documents; unknown terms dropped."""
    p = model.params
    counts = counts if counts is not None else term_counts(docs, id_col, text_col, p)
    joined = counts.join(model.idf_table(), "term", "inner")
    if p.binary:
        tfv = F.lit(1.0)
    elif p.sublinear_tf:
        tfv = F.log(F.col("tf").cast("double")) + 1.0
    else:
        tfv = F.col("tf").cast("double")
    raw = joined.select("doc_id", "term", "tf", (tfv * F.col("idf")).alias("_w"))
    by_doc = Window.partitionBy("doc_id")
    if p.norm == "l2":
        den = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(by_doc))
    elif p.norm == "l1":
        den = F.sum(F.abs(F.col("_w"))).over(by_doc)
    elif p.norm is None:
        den = F.lit(1.0)
    else:
        raise ValueError(f"norm must be 'l1', 'l2' or None, not {p.norm!r}")
    return raw.select("doc_id", "term", "tf", F.when(den > 0, F.col("_w") / den).otherwise(0.0).alias("weight"))


def tfidf_transform_rows(docs: DataFrame, model: TfidfModel, id_col: str = "doc_id", text_col: str = "text",
                         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """E2 inside the document rows, with the norm and without any shuffle: ``(doc_id, term, tf, weight)`` as ``tfidf_transform``
    gives them, on tables and on streams.

    The fitted terms go out as one broadcast whose bytes are checked first.  Of a larger vocabulary only the terms of ``docs`` go
    out, found by one distinct of their terms; where those are too large as well, and on a stream, it is refused (use
    ``tfidf_transform``, on a stream inside ``foreachBatch``).  Null and empty texts give no rows; a repeated or null id is a
    document of its own."""
    p = model.params
    if p.norm not in ("l1", "l2", None):
        raise ValueError(f"norm must be 'l1', 'l2' or None, not {p.norm!r}")
    terms = model.vocabulary.select("term", "idf")
    if not fits(terms, broadcast_bytes):
        if not docs.isStreaming:
            own = term_counts(docs, id_col, text_col, p).select("term").distinct()
            terms = reliable_checkpoint(terms.join(own, "term", "left_semi"))
        if docs.isStreaming or not fits(terms, broadcast_bytes):
            raise ValueError(f"the vocabulary has more than {broadcast_bytes} bytes")
    sink = pa.BufferOutputStream()
    table = terms.toArrow()  # stays in Arrow on the driver: no Python object for each term
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    fitted = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del table, sink

    def weigh(batches):
        known_terms = pa.ipc.open_stream(fitted.value).read_all()
        words, idf = pd.Index(known_terms["term"].to_numpy()), known_terms["idf"].to_numpy()
        for batch in batches:
            runs = batch.column(1)
            term, tf = runs.flatten().flatten()
            owner = np.repeat(np.arange(len(batch)), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = words.get_indexer(term.to_numpy(zero_copy_only=False))
            known = np.flatnonzero(at >= 0)
            owner, n = owner[known], tf.to_numpy(zero_copy_only=False)[known].astype(float)
            w = idf[at[known]] * (1.0 if p.binary else np.log(n) + 1.0 if p.sublinear_tf else n)
            if p.norm:
                size = np.bincount(owner, np.abs(w) if p.norm == "l1" else w * w, len(batch))[owner]
                size = size if p.norm == "l1" else np.sqrt(size)
                w = np.divide(w, size, out=np.zeros_like(w), where=size > 0)
            take = pa.array(known)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), term.take(take), tf.take(take), pa.array(w)], ["doc_id", "term", "tf", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return term_runs(docs, id_col, text_col, p).mapInArrow(weigh, f"doc_id {kind}, term string, tf bigint, weight double")


def tfidf_fit_transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        params: TfidfParams = TfidfParams()) -> tuple[TfidfModel, DataFrame]:
    """Fit on ``docs`` and return (model, long-form weights)."""
    if params.norm not in ("l1", "l2", None):
        raise ValueError(f"norm must be 'l1', 'l2' or None, not {params.norm!r}")
    # read by the fit and by the transform: the texts are tokenised once
    packed = TB.pack_documents(term_runs(docs, id_col, text_col, params), _stop_words(params.stop_words))
    model = _fitted(TB.block_frequency(packed), docs.count(), params)
    if TB.ids_repeat(packed):  # documents of one id share a norm, wherever they are
        return model, tfidf_transform(docs, model, id_col, text_col, counts=TB.counts_of(packed))
    idf = TB.wanted(packed).join(model.idf_table(), "term").select("of", "place", "idf")
    scale = np.ones_like if params.binary else (lambda tf: np.log(tf) + 1.0) if params.sublinear_tf else (lambda tf: tf)
    return model, TB.weigh(packed, idf, params.norm, scale)


def vocabulary(docs: DataFrame, text_col: str = "text", params: TfidfParams = TfidfParams()) -> DataFrame:
    """Distinct terms of a corpus (explode + distinct)."""
    toks = token_expr(F.col(text_col), params.analyzer, params.lowercase, params.strip_accents)
    return docs.select(F.explode(toks).alias("term")).distinct()
