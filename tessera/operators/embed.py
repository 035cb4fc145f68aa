"""Document vectors from words, token states or an injected model.

Word-vector means (E3) and idf-weighted means (E4):

    term counts per document (counted inside each row), packed in blocks (``term_blocks``)
      -> the distinct words of each block meet the word-vector table (J3), by broadcast when the table's bytes are below
         a bound, otherwise by a shuffle
      -> [E4] and the idf table (the same way), missing idf = max idf (J4)
      -> the vectors found go back to the block, where each document's weighted sum is made

A word's vector crosses the shuffle once for a block, not once for a document.  Documents without any known word get a NULL
vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.operators import term_blocks as TB
from tessera.operators import tfidf
from tessera.operators.hot_join import BROADCAST_BYTES, fits
from tessera.session import reliable_checkpoint


def _word_table(word_vectors: DataFrame) -> DataFrame:
    return word_vectors.select(F.col("word").alias("term"), F.col("vector").cast("array<double>").alias("_wv"))


def _join(rows: DataFrame, table: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    return rows.join(F.broadcast(table) if fits(table, broadcast_bytes) else table, "term", how)


def _means(packed: DataFrame, found: DataFrame, docs: DataFrame, id_col: str, out: str) -> DataFrame:
    """The vector sums of ``found`` (of, place, v, scale) over the counts they are of, for all ``docs``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = TB.vector_sums(packed, found).where("doc_id IS NOT NULL")
    agg = own.groupBy("doc_id").agg(Summarizer.sum(array_to_vector("s")).alias("_s"), F.sum("w").alias("_w"))  # documents of one id share a vector
    means = agg.select("doc_id", F.transform(vector_to_array("_s"), lambda x: x / F.col("_w")).alias(out))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return ids.join(means, "doc_id", "left")


def mean_word_vector_embed(docs: DataFrame, word_vectors: DataFrame, id_col: str = "doc_id",
                           text_col: str = "text", tokenizer: str = "treebank", out: str = "vector",
                           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mean of the vectors of a document's known words (repeats count;
    unknown words dropped; lower-cased at fit and transform alike)."""
    packed = TB.pack_documents(_runs(docs, id_col, text_col, tokenizer))
    table = reliable_checkpoint(_word_table(word_vectors))  # measured, then joined
    found = _join(TB.wanted(packed), table, "inner", broadcast_bytes)
    return _means(packed, found.select("of", "place", F.col("_wv").alias("v"), F.lit(1.0).alias("scale")), docs, id_col, out)


def idf_weighted_word_vector_embed(docs: DataFrame, word_vectors: DataFrame, id_col: str = "doc_id",
                                   text_col: str = "text", tokenizer: str = "treebank",
                                   model: tfidf.TfidfModel | None = None, out: str = "vector",
                                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each known word's vector times its smooth idf from a default TF-IDF
    fit on the same documents (words without an idf get the largest idf),
    divided by the number of known words (not by the weight sum)."""
    model = model or tfidf.tfidf_fit(docs, id_col, text_col)
    packed = TB.pack_documents(_runs(docs, id_col, text_col, tokenizer))
    table = reliable_checkpoint(_word_table(word_vectors))
    found = _join(TB.wanted(packed), table, "inner", broadcast_bytes)
    found = _join(found, model.vocabulary.select("term", "idf"), "left", broadcast_bytes)
    scale = F.coalesce("idf", F.lit(float(model.max_idf or 1.0)))
    return _means(packed, found.select("of", "place", F.col("_wv").alias("v"), scale.alias("scale")), docs, id_col, out)


def _runs(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    if tokenizer == "word":
        return tfidf.term_runs(docs, id_col, text_col)
    if tokenizer == "treebank":
        return tfidf.term_runs(docs, id_col, text_col, token_fn=lambda c: TX.treebank_tokens(c, lowercase=True))
    raise ValueError("tokenizer must be 'treebank' or 'word'")


def pool_token_states(df: DataFrame, states: str = "states", mask: str = "attention_mask",
                      mode: str = "mean", include_padding: bool = False, out: str = "vector") -> DataFrame:
    """E5: ``start_token_hidden`` = the first token's state; ``mean`` = mean
    over tokens, masked by the attention mask unless ``include_padding``
    (the reference's behaviour).  A row without tokens gets NULL.  Per-row array expressions, no shuffle."""
    st = F.col(states)
    if mode == "start_token_hidden":
        return df.withColumn(out, F.try_element_at(st, F.lit(1)).cast("array<double>"))
    if mode != "mean":
        raise ValueError("mode must be 'mean' or 'start_token_hidden'")
    dim = F.size(F.try_element_at(st, F.lit(1)))
    if include_padding:
        w = F.transform(st, lambda _: F.lit(1.0))
    else:
        w = F.transform(F.col(mask), lambda m: m.cast("double"))
    pairs = F.arrays_zip(st.alias("s"), w.alias("w"))
    total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    zero = F.array_repeat(F.lit(0.0), F.greatest(F.coalesce(dim, F.lit(0)), F.lit(0)))
    summed = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["s"], lambda a, s: a + s.cast("double") * p["w"]))
    pooled = F.when(total > 0, F.transform(summed, lambda x: x / total))
    return df.withColumn(out, F.when(F.size(st) > 0, pooled))


def embed_with_model(df: DataFrame, text_col: str, make_predict_fn: Callable, dim: int | None = None,
                     batch_size: int = 64, out: str = "vector") -> DataFrame:
    """Batch inference with a user-supplied model.

    ``make_predict_fn()`` is called once per Python worker and returns a
    function mapping a numpy array of texts to an (n, d) float array; Spark
    feeds it Arrow batches of ``batch_size`` rows (``predict_batch_udf``)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.coalesce(F.col(text_col), F.lit(""))))


def letter_count_embedder(letters: str = "aeiou"):
    """A deterministic, model-free text embedder for tests and examples: the
    count of each letter in the lower-cased text, then the text length."""

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), len(letters) + 1), dtype=np.float64)
            for i, t in enumerate(texts):
                s = str(t).lower()
                for j, ch in enumerate(letters):
                    out[i, j] = s.count(ch)
                out[i, -1] = len(s)
            return out
        return predict

    return make
