"""Hand-written golden cases and invariants for the operators."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions import vector as V
from tessera.operators import cluster as C
from tessera.operators import diagnostics as D
from tessera.operators import embed as E
from tessera.operators import metrics as MT
from tessera.operators import prompt as PR
from tessera.operators import scale as S
from tessera.operators import similarity as M
from tessera.operators import tfidf as T
from tessera.sources import io
from tessera.sources.keys import add_row_number


def _sk_tfidf(docs, smooth=True, sublinear=False, norm="l2", binary=False, min_df=1, max_df=1.0):
    """Reference formulas of the classic vectorizer, written out in numpy."""
    import re
    toks = [re.findall(r"(?u)\b\w\w+\b", (d or "").lower()) for d in docs]
    n = len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    lo = min_df if isinstance(min_df, int) else min_df * n
    hi = max_df if isinstance(max_df, int) else max_df * n
    vocab = sorted(w for w, c in df.items() if lo <= c <= hi)
    out = {}
    for i, t in enumerate(toks):
        row = {}
        for w in t:
            if w in vocab:
                row[w] = row.get(w, 0) + 1
        for w, c in row.items():
            tf = 1.0 if binary else (1 + math.log(c) if sublinear else float(c))
            idf = (math.log((1 + n) / (1 + df[w])) + 1) if smooth else (math.log(n / df[w]) + 1)
            row[w] = tf * idf
        if norm == "l2":
            s = math.sqrt(sum(v * v for v in row.values()))
            row = {w: v / s for w, v in row.items()} if s else row
        elif norm == "l1":
            s = sum(abs(v) for v in row.values())
            row = {w: v / s for w, v in row.items()} if s else row
        for w, v in row.items():
            out[(i, w)] = v
    return out


DOCS = ["The cat sat on the mat.", "", "Dogs and cats, cats and dogs!", "x y z", "Café déjà vu — the cafe",
        "the the the end", None]


@pytest.mark.parametrize("kw", [dict(), dict(smooth=False), dict(sublinear=True), dict(norm="l1"),
                                dict(norm=None), dict(binary=True), dict(min_df=2), dict(max_df=0.5)])
def test_tfidf_matches_reference_formulas(spark, kw):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "doc_id long, text string")
    p = T.TfidfParams(smooth_idf=kw.get("smooth", True), sublinear_tf=kw.get("sublinear", False),
                      norm=kw.get("norm", "l2"), binary=kw.get("binary", False), min_df=kw.get("min_df", 1),
                      max_df=kw.get("max_df", 1.0))
    _, w = T.tfidf_fit_transform(df, params=p)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in w.collect()}
    want = _sk_tfidf(DOCS, **kw)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    # empty and NULL documents contribute no rows (zero vectors)
    assert not any(d in (1, 6) for d, _ in got)


def test_tfidf_max_features_ties_alphabetical(spark):
    df = spark.createDataFrame([(0, "b a c"), (1, "bb aa cc aa")], "doc_id long, text string")
    m = T.tfidf_fit(df, params=T.TfidfParams(max_features=2))
    assert sorted(r["term"] for r in m.vocabulary.collect()) == ["aa", "bb"]


def test_term_counts_repartition_invariant(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "doc_id long, text string")
    a = sorted(T.term_counts(df).collect())
    b = sorted(T.term_counts(df.repartition(5)).collect())
    assert a == b


def test_treebank_tokens_split_contractions_and_punctuation(spark):
    df = spark.createDataFrame([("They don't like it, do they?",)], "t string")
    toks = df.select(TX.treebank_tokens("t").alias("k")).first()["k"]
    assert toks == ["they", "do", "n't", "like", "it", ",", "do", "they", "?"]


def test_strip_accents(spark):
    df = spark.createDataFrame([("Café déjà ß Ω",)], "t string")
    r = df.select(TX.strip_accents("t", "unicode").alias("u"), TX.strip_accents("t", "ascii").alias("a")).first()
    assert r["u"] == "Cafe deja ß Ω"
    assert r["a"] == "Cafe deja  "


def test_silhouette_zero_vector_and_singleton(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.5, 0.5], 2)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c long")
    got = C.silhouette(df, "v", "c").first()["silhouette"]
    x = np.array([r[1] for r in rows])
    lab = np.array([r[2] for r in rows])
    nrm = np.linalg.norm(x, axis=1)
    unit = np.divide(x, nrm[:, None], out=np.zeros_like(x), where=nrm[:, None] > 0)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, 0)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-12)


def test_scalers_constant_dimension(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [2.0, 5.0])], "id long, v array<double>")
    mm = {r["id"]: r["scaled"] for r in S.min_max_scale(df, "v").collect()}
    assert mm[0] == [0.0, 0.0] and mm[1] == [1.0, 0.0] and mm[2] == [0.5, 0.0]
    st = {r["id"]: r["scaled"] for r in S.standard_scale(df, "v").collect()}
    assert st[2][1] == 0.0
    assert st[1][0] == pytest.approx(1 / np.std([1, 3, 2]))


def test_histogram_all_equal_and_log_of_nonpositive(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "r double")
    h = D.residual_histogram(df, "r", bins=4).orderBy("bin").collect()
    assert h[0]["left_edge"] == 0.5 and h[-1]["right_edge"] == 1.5
    assert sum(r["bin_count"] for r in h) == 3
    assert h[2]["bin_count"] == 3  # value sits on the inner edge 1.0 -> bin 2
    lg = spark.createDataFrame([(0.0,), (-1.0,), (math.e,)], "x double")
    out, dropped = D.log_transform(lg, "x")
    assert dropped == 2
    assert sorted([r["Log x"] for r in out.collect()], key=lambda v: (v is None, v)) == [1.0, None, None]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "r double")
    h = D.residual_histogram(df, "r", bins=30).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=30, range=(vals.min(), vals.max()))
    assert [r["bin_count"] for r in h] == counts.tolist()
    np.testing.assert_allclose([r["left_edge"] for r in h], edges[:-1], rtol=1e-12)
    dens, _ = np.histogram(vals, bins=30, range=(vals.min(), vals.max()), density=True)
    np.testing.assert_allclose([r["bin_probability"] for r in h], dens, rtol=1e-9)
    assert h[0]["Description"].startswith("Bin Min: ")


def test_qq_points_use_inverse_normal(spark):
    from statistics import NormalDist
    vals = [3.0, -1.0, 2.0, 0.5, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    pts = D.qq_points(df, "r").orderBy("qq_position").collect()
    n = len(vals)
    mu, sd = np.mean(vals), np.std(vals)
    for i, p in enumerate(pts, start=1):
        assert p["qq_x"] == pytest.approx(NormalDist().inv_cdf(i / (n + 1)), abs=1e-14)
        assert p["qq_y"] == pytest.approx((sorted(vals)[i - 1] - mu) / sd)


def test_focus_absent_gives_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    assert M.filter_focused(df, "id", "v", 99, "most_similar", 2).count() == 0


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]  # exact duplicate ties at similarity 1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(r["id1"], r["rank"]): r["id2"] for r in M.topk_neighbours(df, "id", "v", 3, block_rows=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:3]
        assert [got[(i, k)] for k in (1, 2, 3)] == order


def test_pool_token_states_padding(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]], [1, 1, 0]),
                                ([[5.0, 6.0]], [0])], "states array<array<double>>, attention_mask array<int>")
    m = E.pool_token_states(df, mode="mean").collect()
    assert m[0]["vector"] == [2.0, 3.0]
    assert m[1]["vector"] is None  # fully padded
    p = E.pool_token_states(df, mode="mean", include_padding=True).collect()
    assert p[0]["vector"] == pytest.approx([4.0 / 3, 2.0])
    f = E.pool_token_states(df, mode="start_token_hidden").collect()
    assert f[1]["vector"] == [5.0, 6.0]


def test_word_vectors_unknown_words_give_null(spark):
    docs = spark.createDataFrame([(0, "cat dog cat"), (1, "zzz qqq")], "doc_id long, text string")
    wv = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "word string, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in E.mean_word_vector_embed(docs, wv, tokenizer="word").collect()}
    assert got[0] == pytest.approx([2 / 3, 1 / 3])
    assert got[1] is None


def test_prompt_lists_and_tails(spark):
    rec = spark.createDataFrame([(1, 1, "hello")], "account long, rank long, text string")
    suc = spark.createDataFrame([(2, 1, "best")], "account long, rank long, text string")
    p = {r["account"]: r["prompt"] for r in PR.build_prompts(rec, suc, "account", "rain", None).collect()}
    assert p[1].startswith("The following are the most recent tweets written by 1:\n1. hello\n\n")
    assert p[2].endswith("that has a high chance of being successful and is less than 280 characters long:\n")
    none = {r["account"]: r["prompt"] for r in PR.build_prompts(rec.limit(0), suc.limit(0), "account", "rain").collect()}
    assert none == {}


def test_row_numbers_contiguous_and_partition_invariant(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    a = add_row_number(df, ["v"], "rn").orderBy("rn").collect()
    assert [r["rn"] for r in a] == list(range(1, 1001))
    assert [r["v"] for r in a] == sorted(r["v"] for r in a)


def test_group_median_exact(spark):
    rows = [(g, float(v)) for g, vals in {0: [5, 1, 3], 1: [4, 2], 2: [7]}.items() for v in vals]
    df = spark.createDataFrame(rows, "g long, v double")
    med = {r["g"]: r["median"] for r in MT.group_median(df, "g", "v").collect()}
    assert med == {0: 3.0, 1: 3.0, 2: 7.0}


def test_scan_csv_multiline_and_word_vector_file(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('id,Text,Spend\n1,"line one\nline ""two""",3.5\n2,plain,4\n')
    df = io.scan_csv(spark, os.path.join(d, "a.csv"))
    rows = df.orderBy("id").collect()
    assert rows[0]["Text"] == 'line one\nline "two"'
    num, other = io.split_columns(df)
    assert "Spend" in num and "Text" in other
    with open(os.path.join(d, "w.vec"), "w") as f:
        f.write("3 2\ncat 1.0 2.0\ndog 3.0 4e-1\nemu 5 6\n")
    vocab = spark.createDataFrame([("cat",), ("dog",)], "term string")
    wv = {r["word"]: r["vector"] for r in io.load_word_vectors(spark, os.path.join(d, "w.vec"), vocab).collect()}
    assert wv == {"cat": [1.0, 2.0], "dog": [3.0, 0.4]}


def test_embedding_cache_embeds_only_missing(spark):
    from tessera.sources.cache import embedding_cache

    d = tempfile.mkdtemp(prefix="tessera-store-", dir="/tmp")
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.withColumn("vector", F.array(F.length("text").cast("double")))

    docs = spark.createDataFrame([(1, "aa"), (2, "bbb")], "doc_id long, text string")
    first = embedding_cache(docs, d + "/store", embed, "len")
    assert sorted((r["doc_id"], r["vector"][0]) for r in first.collect()) == [(1, 2.0), (2, 3.0)]
    more = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "c")], "doc_id long, text string")
    second = embedding_cache(more, d + "/store", embed, "len")
    assert second.count() == 3
    assert calls == [2, 1]


def test_fitted_operators_on_a_stream(spark):
    from tessera.operators.reduce import PcaModel
    from tessera.operators.regress import ols_fit, predict_ols
    from tessera.streaming.stateless import apply_fitted, run_to_memory

    d = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    fitted = ols_fit(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)], "x double, y double"), "x", "y", model="slr")
    pca = PcaModel([1.0, 1.0], [[0.6, 0.8]], [1.0])
    spark.createDataFrame([(10, 3.0, [2.0, 3.0])], "doc_id long, x double, v array<double>").write.parquet(d + "/in")
    stream = spark.readStream.schema("doc_id long, x double, v array<double>").parquet(d + "/in")

    def chain(s):  # R8, D9 and C5
        s = pca.transform(predict_ols(s, fitted), "v")
        return C.assign_nearest(s, "v", [[0.0, 0.0], [2.0, 2.0]])

    run_to_memory(apply_fitted(stream, chain), "streamed_rows", d + "/ckpt")
    row = spark.sql("SELECT * FROM streamed_rows").collect()[0]
    assert row["prediction"] == pytest.approx(7.0) and row["reduced"][0] == pytest.approx(2.2) and row["cluster"] == 1


def test_char_analyzers(spark):
    df = spark.createDataFrame([("Ab  c\nd",), ("",)], "t string")
    r = df.select(TX.char_tokens("t").alias("c"), TX.char_wb_tokens("t").alias("w")).collect()
    assert r[0]["c"] == ["a", "b", " ", "c", "\n", "d"]
    assert r[0]["w"] == [" ", "a", "b", " ", " ", "c", " ", " ", "d", " "]
    assert r[1]["c"] == [] and r[1]["w"] == []


def test_stop_words_removed_before_counting(spark):
    df = spark.createDataFrame([(0, "the cat and the dog"), (1, "a cat")], "doc_id long, text string")
    tc = T.term_counts(df, params=T.TfidfParams(stop_words=("the", "and")))
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in tc.collect()) == [(0, "cat", 1), (0, "dog", 1), (1, "cat", 1)]


def test_kmeans_finds_blobs_and_its_result_can_be_read_again(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(loc=c, scale=0.3, size=(30, 3)) for c in ([5, 0, 0], [0, 5, 0], [0, 0, 5], [5, 5, 5])])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    out, cents = C.kmeans(df, "v", 4, n_init=5, id_col="id")
    for _ in range(2):
        lab = {r["id"]: r["cluster"] for r in out.collect()}
        for g in range(4):
            assert len({lab[i] for i in range(g * 30, g * 30 + 30)}) == 1
    assert sorted(lab.values()).count(0) == 30 and len(cents) == 4
    for g in range(4):
        assert np.allclose(cents[lab[g * 30]], x[g * 30:g * 30 + 30].mean(0), atol=1e-6)


def test_pairs_of_many_ids_and_string_ids(spark):
    df = spark.range(1001).select(F.col("id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    assert M.cosine_pairs(df, "id", "v").count() == 1001 * 1001
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = {(r["id1"], r["id2"]) for r in M.cosine_join(named, "id", "v", 0.9, block_rows=1).collect()}
    assert got == {("a", "b")}
    top = {r["id1"]: r["id2"] for r in M.topk_neighbours(named, "id", "v", 1, block_rows=1).collect()}
    assert top == {"a": "b", "b": "a", "c": "a"}
    assert M.filter_random(named, "id", 2).count() == 2


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "hellinger"])
def test_topk_metrics(spark, metric):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.random((18, 4)), np.zeros((2, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")

    def dist(a, b):
        if metric == "euclidean":
            return np.sqrt(((a - b) ** 2).sum())
        if metric in ("manhattan", "chebyshev"):
            return np.abs(a - b).sum() if metric == "manhattan" else np.abs(a - b).max()
        den = np.sqrt(a.sum() * b.sum())
        near = np.sqrt(a * b).sum() / den if den else float(a.sum() == b.sum())
        return np.sqrt(max(0.0, 1 - near))

    got = {(r["id1"], r["rank"]): (r["id2"], r["distance"]) for r in M.topk_neighbours(df, "id", "v", 3, metric, block_rows=6).collect()}
    for i in range(20):
        want = sorted((round(dist(x[i], x[j]), 9), j) for j in range(20) if j != i)[:3]
        assert [round(got[i, k + 1][1], 6) for k in range(3)] == pytest.approx([w[0] for w in want], abs=1e-6)
    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id"))
    for r in pairs.select("a.v", F.col("b.v").alias("w"), V.distance(metric)(F.col("a.v"), F.col("b.v")).alias("d")).collect():
        assert r["d"] == pytest.approx(dist(np.array(r["v"]), np.array(r["w"])), abs=1e-7)


def test_silhouette_of_duplicates_in_two_clusters_is_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "cluster int, v array<double>")
    assert C.silhouette(df, "v", "cluster").first()[0] == 0.0


def test_statistics_keep_the_null_cluster(spark):
    df = spark.createDataFrame([(None, 9.0), (None, 7.0), (0, 1.0), (1, 2.0), (1, 4.0)], "cluster int, m double")
    rows = MT.cluster_metric_stats(df, "m").collect()
    assert [(r["rank"], r["cluster"], r["mean"], r["median"], r["size"]) for r in rows] == [(0, None, 8.0, 8.0, 2), (1, 1, 3.0, 3.0, 2), (2, 0, 1.0, 1.0, 1)]


def test_prompts_for_accounts_without_texts(spark):
    rec = spark.createDataFrame([(1, 1, "hello")], "account long, rank long, text string")
    accounts = spark.createDataFrame([(1,), (2,), (2,)], "account long")
    p = {r["account"]: r["prompt"] for r in PR.build_prompts(rec, None, "account", "rain", accounts=accounts).collect()}
    assert p[2] == "The following is an 2 tweet about rain that is less than 280 characters long:\n" and len(p) == 2
    assert PR.build_prompts(None, None, "account", "rain", accounts=accounts).count() == 2
    with pytest.raises(ValueError):
        PR.build_prompts(None, None, "account", "rain")
