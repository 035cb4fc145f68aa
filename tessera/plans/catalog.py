"""Registered queries: one per operator of the blueprint, over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL twin in ``tessera.plans.oracle``.  Floating results are
rounded (``rounded``) on both sides so independent engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import rounded
from tessera.operators import metrics, tfidf
from tessera.sources.io import read_table
from tessera.sources import keys
from tessera.sources.keys import category_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# --- text vectors ----------------------------------------------------------

@query
def tfidf_fit_transform(spark, sf_dir):
    """E1 with default parameters: long-form l2-normalised weights."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    _, w = tfidf.tfidf_fit_transform(docs)
    return w.select("doc_id", "term", "tf", rounded("weight", 6).alias("weight"))


@query
def document_frequency(spark, sf_dir):
    """A2: documents per term and corpus count."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return tfidf.document_frequency(tfidf.term_counts(docs))


# --- metrics per cluster ---------------------------------------------------

def _docs_by_lang(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return category_labels(docs, "lang", "cluster")


def _stats_out(df):
    return df.select(
        "rank", "cluster",
        rounded("mean", 6).alias("mean"), rounded("median", 6).alias("median"),
        rounded("min", 6).alias("min"), rounded("max", 6).alias("max"), rounded("sum", 4).alias("sum"),
        rounded("std", 4).alias("std"), rounded("var", 2).alias("var"), rounded("sem", 6).alias("sem"),
        "size", rounded("metric", 6).alias("metric"),
    )


@query
def cluster_metric_stats(spark, sf_dir):
    """A1 + W1: n_chars per language cluster, ranked by mean."""
    return _stats_out(metrics.cluster_metric_stats(_docs_by_lang(spark, sf_dir), "n_chars", "mean"))


@query
def cluster_metric_stats_missing(spark, sf_dir):
    """A1 with a partly missing metric: label quality per source, ranked by median."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    df = category_labels(docs.join(labels, "doc_id", "left"), "source", "cluster")
    return _stats_out(metrics.cluster_metric_stats(df, "quality", "median"))


@query
def axis_range(spark, sf_dir):
    """A4 on the regression plane of lineitem."""
    li = _t(spark, sf_dir, "lineitem")
    r = metrics.axis_range(li, "l_quantity", "l_extendedprice", 0.05)
    return r.select(*[rounded(c, 6).alias(c) for c in r.columns])


@query
def category_summary(spark, sf_dir):
    """A5: distinct count and label range of document sources."""
    return metrics.category_summary(_t(spark, sf_dir, "documents"), "source")


@query
def category_counts(spark, sf_dir):
    """A5: rows per source."""
    return metrics.category_counts(_t(spark, sf_dir, "documents"), "source")


@query
def top_texts(spark, sf_dir):
    """K1: the ten longest documents (ties by id)."""
    docs = _t(spark, sf_dir, "documents")
    return metrics.top_texts(docs, "n_chars", 10).select("doc_id", "n_chars", "lang")


@query
def add_surrogate_key(spark, sf_dir):
    """S3: contiguous 1..n key over lineitem ordered by all its columns."""
    li = _t(spark, sf_dir, "lineitem")
    keyed = keys.add_surrogate_key(li)
    return keyed.select("observation_number", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")



# --- regression on lineitem (x = quantity, y = extended price, cluster = return flag) ---

from tessera.operators import diagnostics, regress  # noqa: E402

X_COL, Y_COL = "l_quantity", "l_extendedprice"

_INFLUENCE_ROUND = {
    "fitted_values": 1, "residuals": 1, "leverage": 11, "cooks_d": 11, "standard_resid": 6,
    "dffits_internal": 8, "student_resid": 6, "dffits": 8, "externally_studentized_residuals": 6,
    "press_residuals": 1, "internally_studentized_residuals": 6,
}


def _regression_input(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X_COL, Y_COL, "l_returnflag")
    return category_labels(li, "l_returnflag", "cluster")


def _fit(spark, sf_dir, model):
    df = _regression_input(spark, sf_dir)
    return df, regress.ols_fit(df, X_COL, Y_COL, "cluster", model)


def _params(spark, sf_dir, model):
    _, fit = _fit(spark, sf_dir, model)
    p = regress.ols_params(spark, fit, inference=False)
    return p.select("position", "parameter", rounded("estimate", 6).alias("estimate"),
                    rounded("std_err", 6).alias("std_err"), rounded("t_value", 6).alias("t_value"))


@query
def ols_slr(spark, sf_dir):
    """R1 + R4: y = a + b x over all rows."""
    return _params(spark, sf_dir, "slr")


@query
def ols_parallel(spark, sf_dir):
    """R2 + R4: one slope, an intercept shift per return flag."""
    return _params(spark, sf_dir, "parallel")


@query
def ols_separate(spark, sf_dir):
    """R3 + R4: intercept and slope shifts per return flag."""
    return _params(spark, sf_dir, "separate")


@query
def ols_inference(spark, sf_dir):
    """P-values and 95 % confidence intervals (Student t on the driver)."""
    _, fit = _fit(spark, sf_dir, "separate")
    return regress.ols_params(spark, fit, inference=True)


def _influence(spark, sf_dir, model):
    df, fit = _fit(spark, sf_dir, model)
    infl = regress.ols_influence(df, fit)
    dfb = [f"dfb_{n}" for n in fit.names]
    return infl.select(
        "l_orderkey", "l_linenumber", "cluster", "x", "y",
        *[rounded(c, d).alias(c) for c, d in _INFLUENCE_ROUND.items()],
        *[rounded(c, 8).alias(c) for c in dfb],
    )


@query
def ols_influence_slr(spark, sf_dir):
    """R6 for the single line."""
    return _influence(spark, sf_dir, "slr")


@query
def ols_influence_parallel(spark, sf_dir):
    """R6 for parallel lines."""
    return _influence(spark, sf_dir, "parallel")


@query
def ols_influence(spark, sf_dir):
    """R6 for separate lines (the dashboard default)."""
    return _influence(spark, sf_dir, "separate")


_METRIC_ROUND = {
    "nobs": 1, "df_model": 1, "df_resid": 1, "fvalue": 6, "ess": -1, "ssr": -5, "centered_tss": -5,
    "uncentered_tss": -6, "rsquared": 9, "rsquared_adj": 9, "aic": 4, "bic": 4, "llf": 4,
    "mse_model": -1, "mse_resid": 1, "mse_total": 1, "ess_press": -5,
}


@query
def ols_metrics(spark, sf_dir):
    """R5 for separate lines (F-test p-value in ``ols_metrics_full``)."""
    df, fit = _fit(spark, sf_dir, "separate")
    m = regress.ols_metrics(spark, fit, regress.ols_influence(df, fit))
    return m.select(*[rounded(c, d).alias(c) for c, d in _METRIC_ROUND.items()])


@query
def ols_metrics_full(spark, sf_dir):
    """R5 with the F-test p-value (driver-side F tail)."""
    df, fit = _fit(spark, sf_dir, "separate")
    return regress.ols_metrics(spark, fit, regress.ols_influence(df, fit))


@query
def regression_lines(spark, sf_dir):
    """1,000 points per return flag over the global quantity range."""
    df, fit = _fit(spark, sf_dir, "separate")
    r = df.agg(F.min(X_COL), F.max(X_COL)).first()
    lines = regress.regression_lines(spark, fit, float(r[0]), float(r[1]), 1000)
    return lines.select(F.col("cluster").cast("int").alias("cluster"), rounded("X_plot", 6).alias("X_plot"),
                        rounded("y_plot", 4).alias("y_plot"))


@query
def predict_ols(spark, sf_dir):
    """Predicted price for every part's size as the quantity, the return
    flag label taken from the part key (new rows joined with the per-flag
    coefficients)."""
    df, fit = _fit(spark, sf_dir, "separate")
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x_new"))
    new = part.withColumn("cluster", F.pmod("p_partkey", F.lit(3)))
    pred = regress.predict_ols(new, fit, x="x_new", cat="cluster")
    return pred.select("p_partkey", F.col("cluster").cast("int").alias("cluster"), "x_new",
                       rounded("prediction", 4).alias("prediction"))


RESID = "externally_studentized_residuals"


def _separate_influence(spark, sf_dir):
    df, fit = _fit(spark, sf_dir, "separate")
    return regress.ols_influence(df, fit)


@query
def qq_points(spark, sf_dir):
    """G1: theoretical vs standardised sample quantiles of the externally
    studentized residuals."""
    pts = diagnostics.qq_points(_separate_influence(spark, sf_dir), RESID, keep=[])
    return pts.select("qq_position", rounded(RESID, 6).alias("resid"), rounded("qq_x", 8).alias("qq_x"),
                      rounded("qq_y", 6).alias("qq_y"))


@query
def qq_reference_line(spark, sf_dir):
    """The four reference lines of the Q-Q plot."""
    pts = diagnostics.qq_points(_separate_influence(spark, sf_dir), RESID, keep=[])
    lines = diagnostics.qq_reference_line(pts)
    return lines.select("line_type", rounded("slope", 6).alias("slope"), rounded("intercept", 6).alias("intercept"))


@query
def residual_histogram(spark, sf_dir):
    """H1: 30-bin histogram of the externally studentized residuals."""
    h = diagnostics.residual_histogram(_separate_influence(spark, sf_dir), RESID, 30)
    return h.select("bin", "bin_count", rounded("bin_probability", 8).alias("bin_probability"),
                    rounded("left_edge", 8).alias("left_edge"), rounded("right_edge", 8).alias("right_edge"),
                    "Description")


@query
def normal_curve(spark, sf_dir):
    """H2: normal density with the residuals' population std, 200 points."""
    c = diagnostics.normal_curve(_separate_influence(spark, sf_dir), RESID, 200)
    return c.select("i", rounded("x", 8).alias("x"), rounded("y", 8).alias("y"))


@query
def residual_leverage_bins(spark, sf_dir):
    """Residual vs leverage as counts on a 20 x 20 grid."""
    return diagnostics.residual_bins(_separate_influence(spark, sf_dir), "leverage", RESID, 20)


@query
def residual_vs_predicted(spark, sf_dir):
    """Residual vs predicted value as counts on a 20 x 20 grid."""
    return diagnostics.residual_bins(_separate_influence(spark, sf_dir), "fitted_values", RESID, 20)


@query
def log_transform(spark, sf_dir):
    """Natural log of the discount (zero discounts give NULL)."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    out, _ = diagnostics.log_transform(li, "l_discount")
    return out.select("l_orderkey", "l_linenumber", rounded("Log l_discount", 9).alias("Log l_discount"))


# --- vectors: scaling, similarity, cluster scores (embeddings, label = cluster) ---

from tessera.functions import vector as V  # noqa: E402
from tessera.operators import cluster as C  # noqa: E402
from tessera.operators import scale as S  # noqa: E402
from tessera.operators import lsh as LSH  # noqa: E402
from tessera.operators import similarity as M  # noqa: E402
from tessera.operators import term_join as TJ  # noqa: E402

EXACT_IDS = (3, 14, 15, 92, 65, 35, 89, 79, 32, 38)
FOCUS_ID = 42
FILTER_SIZE = 10
SEED = 7


def _emb(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"),
                                                  F.col("label").cast("long").alias("cluster"))


def _long_vectors(df, col):
    return df.select("vec_id", F.posexplode(col).alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), rounded("value", 9).alias("value"))


@query
def min_max_scale(spark, sf_dir):
    """D1 per dimension, long form (vec_id, dim, value)."""
    return _long_vectors(S.min_max_scale(_emb(spark, sf_dir), "v"), "scaled")


@query
def standard_scale(spark, sf_dir):
    """D2 with population std, long form."""
    return _long_vectors(S.standard_scale(_emb(spark, sf_dir), "v"), "scaled")


def _pairs_out(pairs):
    return pairs.select("id1", "id2", rounded("cosine_similarity", 9).alias("cosine_similarity"),
                        "cluster1", "cluster2", "label1", "label2")


@query
def cosine_pairs_exact(spark, sf_dir):
    """M1 + M2 (P4): the similarity matrix of a listed id set."""
    e = _emb(spark, sf_dir)
    return _pairs_out(M.cosine_pairs(M.filter_exact(e, "vec_id", EXACT_IDS), "vec_id", "v", "cluster"))


@query
def cosine_pairs_random(spark, sf_dir):
    """M2 (P5): the similarity matrix of a seeded hash sample of ids."""
    e = _emb(spark, sf_dir)
    return _pairs_out(M.cosine_pairs(M.filter_random(e, "vec_id", FILTER_SIZE, SEED), "vec_id", "v", "cluster"))


def _focus(spark, sf_dir, mode):
    e = _emb(spark, sf_dir)
    return _pairs_out(M.cosine_pairs(M.filter_focused(e, "vec_id", "v", FOCUS_ID, mode, FILTER_SIZE, SEED),
                                     "vec_id", "v", "cluster"))


@query
def cosine_focus_most(spark, sf_dir):
    """M3 (P6): focus id and its nine most similar vectors."""
    return _focus(spark, sf_dir, "most_similar")


@query
def cosine_focus_least(spark, sf_dir):
    """M3 (P6): focus id and its nine least similar vectors."""
    return _focus(spark, sf_dir, "least_similar")


@query
def cosine_focus_random(spark, sf_dir):
    """M3 (P6): focus id and nine hash-chosen others."""
    return _focus(spark, sf_dir, "random")


@query
def cosine_topk(spark, sf_dir):
    """M4: every vector's five most similar others (exact, blocked)."""
    t = M.topk_neighbours(_emb(spark, sf_dir), "vec_id", "v", k=5, metric="cosine", block_rows=128)
    return t.select("id1", "id2", rounded("cosine_similarity", 9).alias("cosine_similarity"),
                    F.col("rank").cast("int").alias("rank"))


@query
def knn_graph(spark, sf_dir):
    """Every vector's five nearest others by euclidean distance."""
    t = M.topk_neighbours(_emb(spark, sf_dir), "vec_id", "v", k=5, metric="euclidean", block_rows=128)
    return t.select("id1", "id2", rounded("distance", 9).alias("distance"), F.col("rank").cast("int").alias("rank"))


def _knn(spark, sf_dir, metric):
    t = M.topk_neighbours(_emb(spark, sf_dir), "vec_id", "v", k=5, metric=metric, block_rows=128)
    return t.select("id1", "id2", rounded("distance", 9).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query
def knn_graph_manhattan(spark, sf_dir):
    """Every vector's five nearest others by manhattan distance."""
    return _knn(spark, sf_dir, "manhattan")


@query
def knn_graph_chebyshev(spark, sf_dir):
    """Every vector's five nearest others by chebyshev distance."""
    return _knn(spark, sf_dir, "chebyshev")


@query
def cosine_join(spark, sf_dir):
    """M5: all pairs with cosine similarity >= 0.3 (exact, blocked)."""
    t = M.cosine_join(_emb(spark, sf_dir), "vec_id", "v", 0.3, block_rows=128)
    return t.select("id1", "id2", rounded("cosine_similarity", 9).alias("cosine_similarity"))


@query
def cosine_join_tfidf(spark, sf_dir):
    """M5 on long-form TF-IDF: all pairs of documents (of classes of equal vectors) with cosine similarity >= 0.5 (exact,
    prefix-filtered join on terms)."""
    _, w = tfidf.tfidf_fit_transform(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    t = TJ.cosine_join_terms(w, 0.5)
    return t.select("id1", "id2", rounded("cosine_similarity", 6).alias("cosine_similarity"), "n1", "n2")


@query
def cosine_topk_lsh(spark, sf_dir):
    """M4 by candidates: every vector's five most similar others among those that random hyperplanes bring together."""
    t = LSH.approx_topk_neighbours(_emb(spark, sf_dir), "vec_id", "v", k=5)
    return t.select("id1", "id2", rounded("cosine_similarity", 9).alias("cosine_similarity"), "rank")


@query
def knn_graph_lsh(spark, sf_dir):
    """D10 by candidates: every vector's five nearest others by euclidean distance among those of near slabs."""
    t = LSH.approx_topk_neighbours(_emb(spark, sf_dir), "vec_id", "v", k=5, metric="euclidean")
    return t.select("id1", "id2", rounded("distance", 9).alias("distance"), "rank")


@query
def nearest_labelled(spark, sf_dir):
    """The three nearest vectors with an even id for every vector with an odd one (exact, two tables)."""
    e = _emb(spark, sf_dir)
    t = M.topk_between(e.where("vec_id % 2 = 1"), "vec_id", "v", e.where("vec_id % 2 = 0"), "vec_id", "v", k=3, block_rows=128)
    return t.select("id1", "id2", rounded("distance", 9).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query
def vector_distances(spark, sf_dir):
    """Distances between each vector and the next id's vector
    (hellinger on absolute values, as it needs non-negative input)."""
    e = _emb(spark, sf_dir)
    a, b = e.alias("a"), e.select(F.col("vec_id").alias("nid"), F.col("v").alias("w"))
    p = a.join(b, F.col("nid") == F.col("a.vec_id") + 1)
    absv = lambda c: F.transform(F.col(c), lambda x: F.abs(x))
    return p.select(
        F.col("vec_id").alias("id1"), F.col("nid").alias("id2"),
        rounded(V.cosine_distance("v", "w"), 9).alias("cosine"),
        rounded(V.euclidean("v", "w"), 9).alias("euclidean"),
        rounded(V.manhattan("v", "w"), 9).alias("manhattan"),
        rounded(V.chebyshev("v", "w"), 9).alias("chebyshev"),
        rounded(V.hellinger(absv("v"), absv("w")), 9).alias("hellinger"),
        rounded(V.dot("v", "w"), 9).alias("dot"),
        rounded(V.l2_norm("v"), 9).alias("l2_norm"),
        rounded(V.l1_norm("v"), 9).alias("l1_norm"),
    )


@query
def silhouette(spark, sf_dir):
    """Cosine silhouette of the embedding labels."""
    return C.silhouette(_emb(spark, sf_dir), "v", "cluster").select(rounded("silhouette", 9).alias("silhouette"))


@query
def calinski_harabasz(spark, sf_dir):
    """C7 of the embedding labels."""
    return C.calinski_harabasz(_emb(spark, sf_dir), "v", "cluster").select(
        rounded("calinski_harabasz", 8).alias("calinski_harabasz"))


@query
def davies_bouldin(spark, sf_dir):
    """C8 of the embedding labels."""
    return C.davies_bouldin(_emb(spark, sf_dir), "v", "cluster").select(
        rounded("davies_bouldin", 8).alias("davies_bouldin"))


# --- text embeddings ----------------------------------------------------------------

from tessera.functions import text as TX  # noqa: E402
from tessera.operators import embed as E  # noqa: E402
from tessera.operators import reduce as R_  # noqa: E402


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def derived_word_vectors(docs):
    """A word-vector table derived from the corpus itself (all words, accented
    ones too): [length, first letter, last letter, length mod 3].  Stands in for
    a trained model so the result has an exact SQL twin."""
    words = tfidf.vocabulary(docs)
    return words.select(
        F.col("term").alias("word"),
        F.array(F.length("term").cast("double"), (F.ascii("term") - 96).cast("double"),
                (F.ascii(F.substring("term", -1, 1)) - 96).cast("double"),
                (F.length("term") % 3).cast("double")).alias("vector"),
    )


def _vec_cols(df, col, n, digits=9):
    return [rounded(F.element_at(col, i + 1), digits).alias(f"v{i}") for i in range(n)]


@query
def tfidf_transform(spark, sf_dir):
    """Fit on documents, transform the benchmark passages (unknown terms dropped)."""
    model = tfidf.tfidf_fit(_docs(spark, sf_dir))
    bench = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    w = tfidf.tfidf_transform(bench, model)
    return w.select("doc_id", "term", "tf", rounded("weight", 6).alias("weight"))


@query
def treebank_tokens(spark, sf_dir):
    """Treebank-style tokens of every document, counted by token."""
    counts = tfidf.term_counts(_docs(spark, sf_dir), token_fn=TX.treebank_tokens)
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


@query
def idf_weighted_treebank_embed(spark, sf_dir):
    """E4 / J4 with Treebank tokens: words without an idf (punctuation, single characters) get the largest one."""
    docs = _docs(spark, sf_dir)
    words = tfidf.term_counts(docs, token_fn=TX.treebank_tokens).select(F.col("term").alias("word")).distinct()
    words = words.withColumn("vector", F.array(F.length("word").cast("double"), (F.length("word") % 3).cast("double")))
    e = E.idf_weighted_word_vector_embed(docs, words)
    return e.select("doc_id", *_vec_cols(e, "vector", 2, 6))


@query
def mean_word_vector_embed(spark, sf_dir):
    """E3 with word tokens: mean word vector per document (NULL if no known word)."""
    docs = _docs(spark, sf_dir)
    e = E.mean_word_vector_embed(docs, derived_word_vectors(docs), tokenizer="word")
    return e.select("doc_id", *_vec_cols(e, "vector", 4))


@query
def idf_weighted_word_vector_embed(spark, sf_dir):
    """E4 with word tokens: idf-weighted mean word vector per document."""
    docs = _docs(spark, sf_dir)
    e = E.idf_weighted_word_vector_embed(docs, derived_word_vectors(docs), tokenizer="word")
    return e.select("doc_id", *_vec_cols(e, "vector", 4))


def _token_states(docs):
    toks = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return docs.select(
        "doc_id",
        F.transform(toks, lambda t: F.array(F.length(t).cast("double"), (F.ascii(t) - 96).cast("double"))).alias("states"),
        F.transform(toks, lambda t: F.when(t.rlike("^[a-z]+$"), 1).otherwise(0)).alias("attention_mask"),
    )


@query
def pool_token_states(spark, sf_dir):
    """E5: first-token, masked-mean and padded-mean pooling of per-token states
    ([length, first letter]) with non-ASCII words as padding positions."""
    st = _token_states(_docs(spark, sf_dir))
    a = E.pool_token_states(st, mode="start_token_hidden", out="first")
    a = E.pool_token_states(a, mode="mean", out="masked")
    a = E.pool_token_states(a, mode="mean", include_padding=True, out="padded")
    return a.select("doc_id", *[rounded(F.element_at(c, i + 1), 9).alias(f"{c}{i}")
                                for c in ("first", "masked", "padded") for i in range(2)])


@query
def embed_with_model(spark, sf_dir):
    """Batch inference through an injected model (a letter-count embedder)."""
    e = E.embed_with_model(_docs(spark, sf_dir), "text", E.letter_count_embedder("aeiou"), batch_size=256)
    return e.select("doc_id", *_vec_cols(e, "vector", 6, 3))


# --- clustering chain --------------------------------------------------------------

from tessera.plans import cluster_texts as CT  # noqa: E402


@query
def kmeans(spark, sf_dir):
    """K-means (k = 10, best of 20 seeded restarts) of the embeddings,
    canonical labels."""
    labelled, _ = C.kmeans(_emb(spark, sf_dir).select("vec_id", "v"), "v", k=10, id_col="vec_id")
    return labelled.select("vec_id", "cluster")


@query
def pca(spark, sf_dir):
    """D3: centred 2-D principal component scores of the embeddings."""
    e = _emb(spark, sf_dir)
    m = R_.pca(e, "v", 2)
    return m.transform(e, "v").select("vec_id", F.element_at("reduced", 1).alias("pc1"),
                                      F.element_at("reduced", 2).alias("pc2"))


@query
def truncated_svd(spark, sf_dir):
    """2-D randomised SVD scores of the TF-IDF long form."""
    _, w = tfidf.tfidf_fit_transform(_docs(spark, sf_dir))
    _, sc = R_.truncated_svd(w, k=2)
    return sc.select("doc_id", F.element_at("reduced", 1).alias("x"), F.element_at("reduced", 2).alias("y"))


def _cluster_docs(spark, sf_dir):
    """The chain with k-means (20 seeded restarts) as the clustering step."""
    return CT.cluster_texts(_docs(spark, sf_dir), config=CT.TextClusterConfig(algorithm="kmeans"))


@query
def cluster_texts(spark, sf_dir):
    """Documents -> TF-IDF -> SVD(50) -> k-means(4): x, y, cluster."""
    frame, _, _ = _cluster_docs(spark, sf_dir)
    return frame


@query
def cluster_texts_stats(spark, sf_dir):
    """Flagship: C9 then A1 + W1 of n_chars per text cluster, ranked by mean."""
    frame, _, _ = _cluster_docs(spark, sf_dir)
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _stats_out(metrics.cluster_metric_stats(frame.join(docs, "doc_id"), "n_chars", "mean"))


@query
def cluster_scores(spark, sf_dir):
    """C6-C8 of the text clusters (one row)."""
    _, scores, _ = _cluster_docs(spark, sf_dir)
    return scores


@query
def assign_cluster(spark, sf_dir):
    """Cluster of each benchmark passage under the fitted text model."""
    _, _, model = _cluster_docs(spark, sf_dir)
    bench = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return CT.assign_texts(bench, model)


# --- posts and prompts (conversations: account = conv_id, ts = turn, kind = role) ---

from tessera.operators import prompt as PR  # noqa: E402

N_EXAMPLES = 3
TOPIC, TONE = "the weather", "friendly"


def _posts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("account"), F.col("turn").alias("ts"), F.col("role").alias("kind"),
                    (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("post_id"), "text",
                    F.length("text").alias("n_chars"))


@query
def recent_texts(spark, sf_dir):
    """S7 + W3: each account's three latest non-system posts."""
    r = PR.recent_texts(_posts(spark, sf_dir), n=N_EXAMPLES, exclude=("system",))
    return r.select("account", "post_id", F.col("rank").cast("int").alias("rank"))


@query
def top_texts_per_account(spark, sf_dir):
    """K1 per group: each account's three longest non-system posts."""
    p = _posts(spark, sf_dir).where(F.col("kind") != "system")
    t = metrics.top_texts_per_group(p, "account", "n_chars", N_EXAMPLES, True, id_col="post_id")
    return t.select("account", "post_id", F.col("rank").cast("int").alias("rank"))


def _prompts(spark, sf_dir):
    posts = _posts(spark, sf_dir)
    recent = PR.recent_texts(posts, n=N_EXAMPLES, exclude=("system",))
    ok = posts.where(F.col("kind") != "system")
    success = metrics.top_texts_per_group(ok, "account", "n_chars", N_EXAMPLES, True, id_col="post_id")
    accounts = posts.select("account").distinct()
    return PR.build_prompts(recent.select("account", "rank", "text"), success.select("account", "rank", "text"),
                            "account", TOPIC, TONE, account_name=lambda c: F.concat(F.lit("account "), c),
                            accounts=accounts)


@query
def build_prompts(spark, sf_dir):
    """Per account, recent and most successful (longest) posts assembled
    into the generation prompt."""
    return _prompts(spark, sf_dir)


@query
def generate_texts(spark, sf_dir):
    """One generated text per prompt (first-line stub generator)."""
    g = PR.generate_texts(_prompts(spark, sf_dir), PR.first_line_generator())
    return g.select("account", "generated")


# --- table hygiene ----------------------------------------------------------------

from tessera.sources.io import parse_vector_column as _parse_vec  # noqa: E402


@query
def remove_observations(spark, sf_dir):
    """Drop the documents labelled toxic (left-anti join with the id table)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    toxic = _t(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return metrics.remove_observations(docs, toxic)


@query
def fill_missing(spark, sf_dir):
    """Labels joined to all documents, missing values filled with 0."""
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return metrics.fill_missing(docs.join(labels, "doc_id", "left"), ["quality", "toxic"])


@query
def parse_vector_column(spark, sf_dir):
    """Embeddings written as list text and parsed back."""
    e = _t(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("["), F.array_join(F.transform(F.col("embedding").cast("array<double>"),
                                                                lambda x: x.cast("string")), ", "), F.lit("]")).alias("txt"))
    p = _parse_vec(e, "txt", "vec")
    return p.select("vec_id", F.size("vec").alias("n"),
                    rounded(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 9).alias("total"),
                    rounded(F.element_at("vec", 1), 9).alias("first"))


from tessera.operators import agglomerative as AG  # noqa: E402


@query
def agglomerative(spark, sf_dir):
    """Average-linkage cosine agglomeration of the embeddings into 10
    clusters, from 2,000 micro-clusters at any size."""
    e = _emb(spark, sf_dir).select("vec_id", "v")
    return AG.agglomerative(e, "v", 10, "average", "cosine", id_col="vec_id", micro=2_000).select("vec_id", "cluster")


@query
def cluster_texts_agglomerative(spark, sf_dir):
    """C9 with the reference's default clustering: documents -> TF-IDF ->
    SVD(50) -> average-linkage cosine agglomeration (4 clusters)."""
    frame, _, _ = CT.cluster_texts(_docs(spark, sf_dir))
    return frame


# --- text function and TF-IDF option coverage -------------------------------------

from tessera.functions import text as TXT  # noqa: E402

STOP = ("the", "and", "of", "de", "la", "und", "der", "el", "y", "en")


@query
def vocabulary(spark, sf_dir):
    """Distinct terms of the corpus."""
    return tfidf.vocabulary(_docs(spark, sf_dir))


@query
def strip_accents(spark, sf_dir):
    """unicode accent stripping (NFKD, combining marks dropped) of whole texts."""
    d = _docs(spark, sf_dir)
    s = TXT.strip_accents(F.col("text"), "unicode")
    return d.select("doc_id", F.md5(s).alias("md5"), F.length(s).alias("n_chars"))


@query
def tfidf_options(spark, sf_dir):
    """E1 with options: accents stripped, stop words, min_df 2, max_df 0.5,
    sublinear tf, l1 norm."""
    p = tfidf.TfidfParams(strip_accents="unicode", stop_words=STOP, min_df=2, max_df=0.5, sublinear_tf=True, norm="l1")
    _, w = tfidf.tfidf_fit_transform(_docs(spark, sf_dir), params=p)
    return w.select("doc_id", "term", "tf", rounded("weight", 9).alias("weight"))


@query
def tfidf_max_features(spark, sf_dir):
    """E1 with a bounded vocabulary: the 50 commonest terms (ties by term)."""
    _, w = tfidf.tfidf_fit_transform(_docs(spark, sf_dir), params=tfidf.TfidfParams(max_features=50))
    return w.select("doc_id", "term", "tf", rounded("weight", 6).alias("weight"))


@query
def char_counts(spark, sf_dir):
    """F5 analyzer ``char``: how often each character occurs in each document."""
    tc = tfidf.term_counts(_docs(spark, sf_dir), params=tfidf.TfidfParams(analyzer="char"))
    return tc.select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


from tessera.operators import sparse_cluster as SP  # noqa: E402


@query
def tfidf_cluster_scores(spark, sf_dir):
    """C6-C8 before any reduction: scores of the documents' languages as clusters of the whole TF-IDF vectors."""
    docs = _t(spark, sf_dir, "documents")
    _, w = tfidf.tfidf_fit_transform(docs.select("doc_id", "text"))
    s = SP.sparse_scores(w, docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("cluster")))
    return s.select(rounded("silhouette", 7).alias("silhouette"), rounded("calinski_harabasz", 4).alias("calinski_harabasz"),
                    rounded("davies_bouldin", 6).alias("davies_bouldin"))


@query
def tfidf_transform_rows(spark, sf_dir):
    """E2 inside the document rows (no shuffle): the model of the documents applied to the benchmark passages."""
    model = tfidf.tfidf_fit(_docs(spark, sf_dir))
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tfidf.tfidf_transform_rows(items, model).select("doc_id", "term", "tf", rounded("weight", 6).alias("weight"))


@query
def cluster_texts_before(spark, sf_dir):
    """C3 ``before`` + C1: k-means(4, best of 4 restarts) of the whole TF-IDF vectors, sparse centroids."""
    docs = _docs(spark, sf_dir)
    _, w = tfidf.tfidf_fit_transform(docs)
    labelled, _ = SP.sparse_kmeans(w, 4, "euclidean", n_init=4, ids=docs)
    return labelled


from tessera.operators import layout as LY  # noqa: E402


@query
def tsne_layout(spark, sf_dir):
    """2-D t-SNE of the embeddings on their exact 90-NN graph (perplexity
    30, the operator's default iterations)."""
    e = _emb(spark, sf_dir).select("vec_id", "v")
    return LY.tsne_layout(e, "vec_id", "v", perplexity=30.0)


from tessera.operators.single_linkage import single_linkage as _single_linkage  # noqa: E402


@query
def single_linkage(spark, sf_dir):
    """C2 with single linkage, exact: the embeddings' clusters when no two are nearer than a cosine distance of 0.65."""
    e = _emb(spark, sf_dir).select("vec_id", "v")
    return _single_linkage(e, "v", metric="cosine", id_col="vec_id", distance_threshold=0.65).select("vec_id", "cluster")


@query
def assign_stored_model(spark, sf_dir):
    """C4 + C5 + D9: the embeddings scaled, reduced by PCA and clustered by k-means; the fitted chain saved and loaded again, and
    every embedding assigned by it: whether it gets the cluster of the fit."""
    import uuid

    from tessera.session import shared_dir

    e = _emb(spark, sf_dir).select("vec_id", "v")
    config = CT.TextClusterConfig(embedding="vectors", reduction="pca", scale_before_reduction="standard", cluster_space="after_step1",
                                  scale_before_cluster="min_max", step_one_dims=8, algorithm="kmeans", n_init=2)
    frame, _, model = CT.cluster_texts(e, "vec_id", None, config, vec_col="v")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    CT.save_model(model, path)
    found = CT.assign_texts(e, CT.load_model(spark, path), "vec_id", None, "v")
    both = frame.select("doc_id", F.col("cluster").alias("fitted")).join(found, "doc_id")
    return both.select(F.col("doc_id").alias("vec_id"), F.col("fitted").eqNullSafe(F.col("cluster")).alias("same_cluster"))


from tessera.operators.umap import umap_layout as _umap_layout  # noqa: E402


@query
def umap_layout(spark, sf_dir):
    """2-D UMAP of the embeddings (15 neighbours, cosine, the operator's default epochs)."""
    return _umap_layout(_emb(spark, sf_dir).select("vec_id", "v"), "vec_id", "v", metric="cosine")
