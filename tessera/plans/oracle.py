"""SQL twins of the registered queries, for an independent engine (DuckDB)
reading the same parquet tables as views.  Column names and rounding match
``tessera.plans.catalog``."""

from __future__ import annotations

from tessera.functions.numeric import sql_rounded as r

SQL: dict[str, str] = {}

WORD_RE = r"[\p{L}\p{N}_]{2,}"

_TF = f"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)
"""

SQL["tfidf_fit_transform"] = f"""
WITH {_TF},
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1.0 + n.n) / (1.0 + dfq.df)) + 1.0) AS w
      FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN n)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf,
       {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight
FROM w
"""

SQL["cosine_join_tfidf"] = f"""
WITH {_TF},
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + dfq.df)) + 1.0) AS w
      FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
vec AS (SELECT doc_id, list((term, round(w, 9)) ORDER BY term) AS vec FROM u GROUP BY doc_id),
cls AS (SELECT min(doc_id) AS id, count(*) AS n FROM vec GROUP BY vec),
v AS (SELECT u.* FROM u JOIN cls ON doc_id = id),
pairs AS (SELECT a.doc_id AS id1, b.doc_id AS id2, sum(a.w * b.w) AS c
          FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING c >= 0.5)
SELECT id1, id2, {r('c', 6)} AS cosine_similarity, x.n AS n1, y.n AS n2
FROM pairs JOIN cls x ON x.id = id1 JOIN cls y ON y.id = id2
"""

SQL["document_frequency"] = f"""
WITH {_TF}
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf GROUP BY term
"""


def _stats_sql(source: str, sort_metric: str) -> str:
    return f"""
WITH d AS ({source}),
s AS (SELECT cluster, avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max,
             coalesce(sum(v), 0.0) AS sum, stddev_samp(v) AS std, var_samp(v) AS var,
             stddev_samp(v) / sqrt(count(v)) AS sem, count(*) AS size
      FROM d GROUP BY cluster)
SELECT CAST(row_number() OVER (ORDER BY {sort_metric} DESC NULLS LAST, cluster) - 1 AS INTEGER) AS rank,
       CAST(cluster AS INTEGER) AS cluster,
       {r('mean', 6)} AS mean, {r('median', 6)} AS median, {r('min', 6)} AS min, {r('max', 6)} AS max,
       {r('sum', 4)} AS sum, {r('std', 4)} AS std, {r('var', 2)} AS var, {r('sem', 6)} AS sem,
       CAST(size AS BIGINT) AS size, {r(sort_metric, 6)} AS metric
FROM s
"""


SQL["cluster_metric_stats"] = _stats_sql(
    "SELECT CAST(n_chars AS DOUBLE) AS v, dense_rank() OVER (ORDER BY lang) - 1 AS cluster FROM documents",
    "mean",
)

SQL["cluster_metric_stats_missing"] = _stats_sql(
    "SELECT CAST(l.quality AS DOUBLE) AS v, dense_rank() OVER (ORDER BY d.source) - 1 AS cluster "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "median",
)

SQL["axis_range"] = f"""
WITH a AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                  max(l_extendedprice) AS y1 FROM lineitem)
SELECT {r('x0 - (x1 - x0) * 0.05', 6)} AS x_min, {r('x1 + (x1 - x0) * 0.05', 6)} AS x_max,
       {r('y0 - (y1 - y0) * 0.05', 6)} AS y_min, {r('y1 + (y1 - y0) * 0.05', 6)} AS y_max
FROM a
"""

SQL["category_summary"] = """
SELECT CAST(count(DISTINCT source) AS BIGINT) AS n_distinct, CAST(min(source) AS VARCHAR) AS min_label,
       CAST(max(source) AS VARCHAR) AS max_label
FROM documents
"""

SQL["category_counts"] = """
SELECT source AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source
"""

SQL["top_texts"] = """
SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10
"""

SQL["add_surrogate_key"] = """
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS observation_number,
       l_orderkey, l_linenumber, l_partkey, l_quantity
FROM lineitem
"""


# --- regression on lineitem -------------------------------------------------

from tessera.functions.stats import normal_ppf_sql  # noqa: E402

K_FLAGS = 3  # return flags A, N, R -> labels 0, 1, 2
XN = "l_quantity"


def _reg_base(model: str) -> str:
    """CTEs: d (rows), gs (group stats), tot (n, p, rss, s2), rowv (per-row
    fitted, e, h, s2_i), for the three models."""
    k = K_FLAGS
    group = "cluster" if model != "slr" else "0"
    if model == "slr":
        p = "2"
    elif model == "parallel":
        p = f"{k + 1}"
    else:
        p = f"{2 * k}"
    ab = {
        "slr": "sxy / sxx AS b, ybar - (sxy / sxx) * xbar AS a, sxx AS den",
        "parallel": "(SELECT sum(sxy) FROM gs0) / (SELECT sum(sxx) FROM gs0) AS b, "
                    "ybar - ((SELECT sum(sxy) FROM gs0) / (SELECT sum(sxx) FROM gs0)) * xbar AS a, "
                    "(SELECT sum(sxx) FROM gs0) AS den",
        "separate": "sxy / sxx AS b, ybar - (sxy / sxx) * xbar AS a, sxx AS den",
    }[model]
    rss = {
        "slr": "sum(syy - sxy * sxy / sxx)",
        "parallel": "sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)",
        "separate": "sum(syy - sxy * sxy / sxx)",
    }[model]
    return f"""
d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y,
             CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS cluster FROM lineitem),
gs0 AS (SELECT {group} AS g, count(*) AS n, avg(x) AS xbar, avg(y) AS ybar, var_pop(x) * count(*) AS sxx,
               covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM d GROUP BY {'cluster' if model != 'slr' else '1'}),
gs AS (SELECT *, {ab} FROM gs0),
tot AS (SELECT sum(n) AS n, {p} AS p, greatest({rss}, 0.0) AS rss FROM gs),
tot2 AS (SELECT n, p, rss, rss / (n - p) AS s2 FROM tot),
rowv AS (SELECT d.*, gs.g, gs.n AS ng, gs.xbar AS xbar_g, gs.den, gs.a, gs.b,
                gs.a + gs.b * d.x AS fitted, d.y - (gs.a + gs.b * d.x) AS e,
                1.0 / gs.n + (d.x - gs.xbar) * (d.x - gs.xbar) / gs.den AS h,
                tot2.n AS n_tot, tot2.p AS p, tot2.s2 AS s2
         FROM d JOIN gs ON {'d.cluster' if model != 'slr' else '0'} = gs.g CROSS JOIN tot2),
rowi AS (SELECT *, e / (1.0 - h) AS press,
                ((n_tot - p) * s2 - e * e / (1.0 - h)) / (n_tot - p - 1.0) AS s2_i FROM rowv)
"""


def _params_def(model: str):
    """(name, estimate SQL, cov-diag SQL, dfbeta-coefficient SQL over a row of rowi)."""
    k = K_FLAGS
    g = lambda j, c: f"(SELECT {c} FROM gs WHERE g = {j})"
    out = []
    if model == "slr":
        out.append(("const", g(0, "a"), f"(1.0 / {g(0, 'n')} + {g(0, 'xbar')} * {g(0, 'xbar')} / {g(0, 'den')})",
                    f"((1.0 / ng + xbar_g * xbar_g / den) + (-xbar_g / den) * x)"))
        out.append((XN, g(0, "b"), f"(1.0 / {g(0, 'den')})", "((-xbar_g / den) + (1.0 / den) * x)"))
        return out
    if model == "parallel":
        w = g(0, "den")

        def u(m):
            return f"((CASE WHEN g = {m} THEN 1.0 / ng ELSE 0.0 END) + {g(m, 'xbar')} * xbar_g / den)"

        def v(m):
            return f"(-{g(m, 'xbar')} / den)"

        out.append(("const", g(0, "a"), f"(1.0 / {g(0, 'n')} + {g(0, 'xbar')} * {g(0, 'xbar')} / {w})",
                    f"({u(0)} + {v(0)} * x)"))
        out.append((XN, g(0, "b"), f"(1.0 / {w})", "((-xbar_g / den) + (1.0 / den) * x)"))
        for j in range(1, k):
            out.append((f"cluster_{j}", f"({g(j, 'a')} - {g(0, 'a')})",
                        f"(1.0 / {g(0, 'n')} + 1.0 / {g(j, 'n')} + ({g(j, 'xbar')} - {g(0, 'xbar')}) * "
                        f"({g(j, 'xbar')} - {g(0, 'xbar')}) / {w})",
                        f"(({u(j)} - {u(0)}) + ({v(j)} - {v(0)}) * x)"))
        return out
    da = "((1.0 / ng + xbar_g * xbar_g / den) + (-xbar_g / den) * x)"
    db = "((-xbar_g / den) + (1.0 / den) * x)"
    c0 = f"(1.0 / {g(0, 'n')} + {g(0, 'xbar')} * {g(0, 'xbar')} / {g(0, 'den')})"
    out.append(("const", g(0, "a"), c0, f"(CASE WHEN g = 0 THEN {da} ELSE 0.0 END)"))
    out.append((XN, g(0, "b"), f"(1.0 / {g(0, 'den')})", f"(CASE WHEN g = 0 THEN {db} ELSE 0.0 END)"))
    for j in range(1, k):
        out.append((f"cluster_{j}", f"({g(j, 'a')} - {g(0, 'a')})",
                    f"(1.0 / {g(j, 'n')} + {g(j, 'xbar')} * {g(j, 'xbar')} / {g(j, 'den')} + {c0})",
                    f"(CASE WHEN g = 0 THEN -{da} WHEN g = {j} THEN {da} ELSE 0.0 END)"))
    for j in range(1, k):
        out.append((f"{XN} cluster_{j}", f"({g(j, 'b')} - {g(0, 'b')})",
                    f"(1.0 / {g(j, 'den')} + 1.0 / {g(0, 'den')})",
                    f"(CASE WHEN g = 0 THEN -{db} WHEN g = {j} THEN {db} ELSE 0.0 END)"))
    return out


def _params_sql(model: str) -> str:
    rows = []
    for i, (name, est, cov, _) in enumerate(_params_def(model)):
        rows.append(f"SELECT {i} AS position, '{name}' AS parameter, {est} AS est, sqrt((SELECT s2 FROM tot2) * {cov}) AS se")
    body = " UNION ALL ".join(rows)
    return f"""
WITH {_reg_base(model)}, pr AS ({body})
SELECT CAST(position AS INTEGER) AS position, parameter, {r('est', 6)} AS estimate, {r('se', 6)} AS std_err,
       {r('est / se', 6)} AS t_value FROM pr
"""


_INFL_ROUND = [("fitted_values", "fitted", 1), ("residuals", "e", 1), ("leverage", "h", 11),
               ("cooks_d", "t_int * t_int * h / (p * (1.0 - h))", 11), ("standard_resid", "t_int", 6),
               ("dffits_internal", "t_int * sqrt(h / (1.0 - h))", 8), ("student_resid", "t_ext", 6),
               ("dffits", "t_ext * sqrt(h / (1.0 - h))", 8), ("externally_studentized_residuals", "t_ext", 6),
               ("press_residuals", "press", 1), ("internally_studentized_residuals", "t_int", 6)]


def _influence_rows(model: str) -> str:
    return f"""rowt AS (SELECT *, e / sqrt(s2 * (1.0 - h)) AS t_int, e / sqrt(s2_i * (1.0 - h)) AS t_ext FROM rowi)"""


def _influence_sql(model: str) -> str:
    cols = [f"{r(expr, dgt)} AS {name}" for name, expr, dgt in _INFL_ROUND]
    for name, _, cov, coef in _params_def(model):
        cols.append(f"{r(f'{coef} * press / sqrt(s2_i * {cov})', 8)} AS \"dfb_{name}\"")
    return f"""
WITH {_reg_base(model)}, {_influence_rows(model)}
SELECT l_orderkey, l_linenumber, cluster, x, y, {', '.join(cols)} FROM rowt
"""


SQL["ols_slr"] = _params_sql("slr")
SQL["ols_parallel"] = _params_sql("parallel")
SQL["ols_separate"] = _params_sql("separate")
SQL["ols_influence_slr"] = _influence_sql("slr")
SQL["ols_influence_parallel"] = _influence_sql("parallel")
SQL["ols_influence"] = _influence_sql("separate")

SQL["ols_metrics"] = f"""
WITH {_reg_base("separate")},
ys AS (SELECT avg(y) AS ybar, count(*) AS n FROM d),
tss AS (SELECT sum(gs.syy + gs.n * (gs.ybar - ys.ybar) * (gs.ybar - ys.ybar)) AS tss_c FROM gs CROSS JOIN ys),
m AS (SELECT CAST(tot2.n AS DOUBLE) AS n, CAST(tot2.p AS DOUBLE) AS p, tot2.rss, tot2.s2, tss.tss_c,
             tss.tss_c + tot2.n * ys.ybar * ys.ybar AS tss_u,
             -tot2.n / 2.0 * (ln(2 * pi()) + ln(tot2.rss / tot2.n) + 1.0) AS llf,
             (SELECT sum(press * press) FROM rowi) AS ess_press
      FROM tot2 CROSS JOIN tss CROSS JOIN ys)
SELECT {r('n', 1)} AS nobs, {r('p - 1.0', 1)} AS df_model, {r('n - p', 1)} AS df_resid,
       {r('((tss_c - rss) / (p - 1.0)) / s2', 6)} AS fvalue, {r('tss_c - rss', -1)} AS ess, {r('rss', -5)} AS ssr,
       {r('tss_c', -5)} AS centered_tss, {r('tss_u', -6)} AS uncentered_tss, {r('1.0 - rss / tss_c', 9)} AS rsquared,
       {r('1.0 - (rss / tss_c) * (n - 1.0) / (n - p)', 9)} AS rsquared_adj, {r('-2.0 * llf + 2.0 * p', 4)} AS aic,
       {r('-2.0 * llf + p * ln(n)', 4)} AS bic, {r('llf', 4)} AS llf, {r('(tss_c - rss) / (p - 1.0)', -1)} AS mse_model,
       {r('s2', 1)} AS mse_resid, {r('tss_c / (n - 1.0)', 1)} AS mse_total, {r('ess_press', -5)} AS ess_press
FROM m
"""

SQL["regression_lines"] = f"""
WITH {_reg_base("separate")},
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
pts AS (SELECT gs.g, gs.a, gs.b, i,
               CASE WHEN i = 999 THEN rng.hi ELSE i * ((rng.hi - rng.lo) / 999) + rng.lo END AS xp
        FROM gs CROSS JOIN rng CROSS JOIN range(0, 1000) t(i))
SELECT CAST(g AS INTEGER) AS cluster, {r('xp', 6)} AS X_plot, {r('a + b * xp', 4)} AS y_plot FROM pts
"""

SQL["predict_ols"] = f"""
WITH {_reg_base("separate")},
nw AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x_new, p_partkey % 3 AS cluster FROM part)
SELECT nw.p_partkey, CAST(nw.cluster AS INTEGER) AS cluster, nw.x_new, {r('gs.a + gs.b * nw.x_new', 4)} AS prediction
FROM nw LEFT JOIN gs ON nw.cluster = gs.g
"""

_QQ = f"""
WITH {_reg_base("separate")}, {_influence_rows("separate")},
rs AS (SELECT t_ext AS v FROM rowt WHERE t_ext IS NOT NULL AND NOT isnan(t_ext)),
mo AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM rs),
qq AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM rs),
pts AS (SELECT qq.pos, qq.v, {normal_ppf_sql('qq.pos / CAST(mo.n + 1 AS DOUBLE)')} AS qx,
               CASE WHEN mo.mean <> 0 AND mo.std <> 1 THEN (qq.v - mo.mean) / mo.std ELSE qq.v END AS qy
        FROM qq CROSS JOIN mo)
"""

SQL["qq_points"] = _QQ + f"""
SELECT CAST(pos AS BIGINT) AS qq_position, {r('v', 6)} AS resid, {r('qx', 8)} AS qq_x, {r('qy', 6)} AS qq_y FROM pts
"""

SQL["qq_reference_line"] = _QQ + f""",
a AS (SELECT avg(qy) AS my, stddev_pop(qy) AS sy, regr_slope(qy, qx) AS rs, regr_intercept(qy, qx) AS ri,
             quantile_cont(qy, 0.25) AS q25, quantile_cont(qy, 0.75) AS q75 FROM pts),
l AS (SELECT '45' AS line_type, 1.0 AS slope, 0.0 AS intercept FROM a
      UNION ALL SELECT 's', sy, my FROM a
      UNION ALL SELECT 'r', rs, ri FROM a
      UNION ALL SELECT 'q', (q75 - q25) / (0.6744897501960817 - -0.6744897501960817),
                       q25 - ((q75 - q25) / (0.6744897501960817 - -0.6744897501960817)) * -0.6744897501960817 FROM a)
SELECT line_type, {r('slope', 6)} AS slope, {r('intercept', 6)} AS intercept FROM l
"""

_HIST = f"""
WITH {_reg_base("separate")}, {_influence_rows("separate")},
rs AS (SELECT t_ext AS v FROM rowt WHERE t_ext IS NOT NULL AND NOT isnan(t_ext)),
mo AS (SELECT count(*) AS n, stddev_pop(v) AS std,
              CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM rs)
"""


def _edge(i: str) -> str:
    return f"(CASE WHEN {i} >= 30 THEN mo.hi ELSE CAST({i} AS DOUBLE) * ((mo.hi - mo.lo) / 30) + mo.lo END)"


SQL["residual_histogram"] = _HIST + f""",
i0 AS (SELECT rs.v, LEAST(CAST(floor((rs.v - mo.lo) / (mo.hi - mo.lo) * 30.0) AS INTEGER), 29) AS b0 FROM rs CROSS JOIN mo),
i1 AS (SELECT v, CASE WHEN v < {_edge('b0')} THEN b0 - 1 ELSE b0 END AS b1 FROM i0 CROSS JOIN mo),
i2 AS (SELECT CASE WHEN v >= {_edge('b1 + 1')} AND b1 <> 29 THEN b1 + 1 ELSE b1 END AS bin FROM i1 CROSS JOIN mo),
c AS (SELECT bin, count(*) AS cnt FROM i2 GROUP BY bin),
h AS (SELECT CAST(t.bin AS INTEGER) AS bin, CAST(coalesce(c.cnt, 0) AS BIGINT) AS bin_count,
             {_edge('t.bin')} AS le, {_edge('t.bin + 1')} AS re, mo.n AS n
      FROM range(0, 30) t(bin) CROSS JOIN mo LEFT JOIN c ON c.bin = t.bin)
SELECT bin, bin_count, {r('bin_count / (re - le) / n', 8)} AS bin_probability, {r('le', 8)} AS left_edge,
       {r('re', 8)} AS right_edge, printf('Bin Min: %.3f, Bin Max: %.3f', le, re) AS Description FROM h
"""

SQL["normal_curve"] = _HIST.replace("CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END", "min(v)").replace(
    "CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END", "max(v)") + f""",
pts AS (SELECT i, CASE WHEN i = 199 THEN mo.hi ELSE i * ((mo.hi - mo.lo) / 199) + mo.lo END AS x, mo.std
        FROM range(0, 200) t(i) CROSS JOIN mo)
SELECT CAST(i AS INTEGER) AS i, {r('x', 8)} AS x,
       {r('exp(-0.5 * (x / std) * (x / std)) / (sqrt(2 * pi()) * std)', 8)} AS y FROM pts
"""

SQL["residual_leverage_bins"] = f"""
WITH {_reg_base("separate")}, {_influence_rows("separate")},
p AS (SELECT h AS lx, t_ext AS ly FROM rowt WHERE h IS NOT NULL AND t_ext IS NOT NULL),
rg AS (SELECT min(lx) - (max(lx) - min(lx)) * 0.05 AS x0, max(lx) + (max(lx) - min(lx)) * 0.05 AS x1,
              min(ly) - (max(ly) - min(ly)) * 0.05 AS y0, max(ly) + (max(ly) - min(ly)) * 0.05 AS y1 FROM p)
SELECT CAST(least(greatest(floor((lx - x0) / (x1 - x0) * 20.0), 0), 19) AS INTEGER) AS x_bin,
       CAST(least(greatest(floor((ly - y0) / (y1 - y0) * 20.0), 0), 19) AS INTEGER) AS y_bin,
       CAST(count(*) AS BIGINT) AS n
FROM p CROSS JOIN rg GROUP BY ALL
"""

SQL["residual_vs_predicted"] = SQL["residual_leverage_bins"].replace(
    "h AS lx, t_ext AS ly FROM rowt WHERE h IS NOT NULL", "fitted AS lx, t_ext AS ly FROM rowt WHERE fitted IS NOT NULL")

SQL["log_transform"] = f"""
SELECT l_orderkey, l_linenumber,
       {r('CASE WHEN l_discount > 0 THEN ln(l_discount) END', 9)} AS "Log l_discount" FROM lineitem
"""


# --- vectors ------------------------------------------------------------------

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS cluster FROM embeddings)"
_EL = _E + ", el AS (SELECT vec_id, cluster, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)"

SQL["min_max_scale"] = f"""
WITH {_EL}, st AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM el GROUP BY dim)
SELECT el.vec_id, CAST(el.dim AS INTEGER) AS dim,
       {r('CASE WHEN st.hi > st.lo THEN (el.x - st.lo) / (st.hi - st.lo) ELSE 0.0 END', 9)} AS value
FROM el JOIN st ON el.dim = st.dim
"""

SQL["standard_scale"] = f"""
WITH {_EL}, st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM el GROUP BY dim)
SELECT el.vec_id, CAST(el.dim AS INTEGER) AS dim,
       {r('CASE WHEN st.sd > 0 THEN (el.x - st.mu) / st.sd ELSE 0.0 END', 9)} AS value
FROM el JOIN st ON el.dim = st.dim
"""


def _cos(a: str, b: str) -> str:
    den = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"(CASE WHEN {den} > 0 THEN list_inner_product({a}, {b}) / {den} ELSE 0.0 END)"


def _pairs_sql(ids_cte: str) -> str:
    return f"""
WITH {_E}, ids AS ({ids_cte}), f AS (SELECT e.* FROM e JOIN ids ON e.vec_id = ids.vec_id)
SELECT a.vec_id AS id1, b.vec_id AS id2, {r(_cos('a.v', 'b.v'), 9)} AS cosine_similarity,
       a.cluster AS cluster1, b.cluster AS cluster2, 'vec_id1: ' || CAST(a.vec_id AS VARCHAR) AS label1,
       'vec_id2: ' || CAST(b.vec_id AS VARCHAR) AS label2
FROM f a CROSS JOIN f b
"""


_HASH = "(((vec_id % 2147483647) * 48271 + 7) % 2147483647)"
_IDS_EXACT = "SELECT unnest([3, 14, 15, 92, 65, 35, 89, 79, 32, 38]) AS vec_id"
SQL["cosine_pairs_exact"] = _pairs_sql(_IDS_EXACT)
SQL["cosine_pairs_random"] = _pairs_sql(f"SELECT vec_id FROM e ORDER BY {_HASH}, vec_id LIMIT 10")

_FOCUS_SIM = _cos("e.v", "(SELECT v FROM e WHERE vec_id = 42)")
SQL["cosine_focus_most"] = _pairs_sql(
    f"SELECT 42 AS vec_id UNION ALL (SELECT vec_id FROM e WHERE vec_id <> 42 ORDER BY {_FOCUS_SIM} DESC, vec_id LIMIT 9)")
SQL["cosine_focus_least"] = _pairs_sql(
    f"SELECT 42 AS vec_id UNION ALL (SELECT vec_id FROM e WHERE vec_id <> 42 ORDER BY {_FOCUS_SIM} ASC, vec_id LIMIT 9)")
SQL["cosine_focus_random"] = _pairs_sql(
    f"SELECT 42 AS vec_id UNION ALL (SELECT vec_id FROM e WHERE vec_id <> 42 ORDER BY {_HASH}, vec_id LIMIT 9)")

SQL["cosine_topk"] = f"""
WITH {_E}, p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, {_cos('a.v', 'b.v')} AS s
                 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
q AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY s DESC, id2) AS rk FROM p)
SELECT id1, id2, {r('s', 9)} AS cosine_similarity, CAST(rk AS INTEGER) AS rank FROM q WHERE rk <= 5
"""

SQL["knn_graph"] = f"""
WITH {_E}, p AS (SELECT a.vec_id AS id1, b.vec_id AS id2,
                        sqrt(greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v)
                                      - 2 * list_inner_product(a.v, b.v), 0)) AS d
                 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
q AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS rk FROM p)
SELECT id1, id2, {r('d', 9)} AS distance, CAST(rk AS INTEGER) AS rank FROM q WHERE rk <= 5
"""

SQL["cosine_join"] = f"""
WITH {_E}, p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, {_cos('a.v', 'b.v')} AS s
                 FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT id1, id2, {r('s', 9)} AS cosine_similarity FROM p WHERE s >= 0.3
"""

SQL["vector_distances"] = f"""
WITH {_EL},
p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, a.x AS xa, b.x AS xb
      FROM el a JOIN el b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim)
SELECT id1, id2,
       {r('1.0 - CASE WHEN sum(xa * xa) > 0 AND sum(xb * xb) > 0 THEN sum(xa * xb) / (sqrt(sum(xa * xa)) * sqrt(sum(xb * xb))) ELSE 0.0 END', 9)} AS cosine,
       {r('sqrt(sum((xa - xb) * (xa - xb)))', 9)} AS euclidean,
       {r('sum(abs(xa - xb))', 9)} AS manhattan,
       {r('max(abs(xa - xb))', 9)} AS chebyshev,
       {r('sqrt(greatest(0.0, 1.0 - sum(sqrt(abs(xa) * abs(xb))) / sqrt(sum(abs(xa)) * sum(abs(xb)))))', 9)} AS hellinger,
       {r('sum(xa * xb)', 9)} AS dot, {r('sqrt(sum(xa * xa))', 9)} AS l2_norm, {r('sum(abs(xa))', 9)} AS l1_norm
FROM p GROUP BY id1, id2
"""

SQL["silhouette"] = f"""
WITH {_E}, p AS (SELECT a.vec_id AS i, a.cluster AS ci, b.cluster AS cj,
                        CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE 1.0 - {_cos('a.v', 'b.v')} END AS d
                 FROM e a CROSS JOIN e b),
m AS (SELECT i, ci, cj, sum(d) AS sd, count(*) AS n FROM p GROUP BY i, ci, cj),
ab AS (SELECT i, max(CASE WHEN ci = cj THEN n END) AS own_n,
              max(CASE WHEN ci = cj THEN sd / greatest(n - 1, 1) END) AS a,
              min(CASE WHEN ci <> cj THEN sd / n END) AS b FROM m GROUP BY i)
SELECT {r('avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END)', 9)} AS silhouette FROM ab
"""

_CENT = f"""{_EL},
cs AS (SELECT cluster, count(DISTINCT vec_id) AS n FROM el GROUP BY cluster),
ce AS (SELECT cluster, dim, avg(x) AS c FROM el GROUP BY cluster, dim),
mu AS (SELECT dim, avg(x) AS m FROM el GROUP BY dim),
dist AS (SELECT el.vec_id, el.cluster, sum((el.x - ce.c) * (el.x - ce.c)) AS sq
         FROM el JOIN ce ON el.cluster = ce.cluster AND el.dim = ce.dim GROUP BY el.vec_id, el.cluster)"""

SQL["calinski_harabasz"] = f"""
WITH {_CENT},
bw AS (SELECT sum(cs.n * t.sq) AS b FROM cs JOIN (SELECT ce.cluster, sum((ce.c - mu.m) * (ce.c - mu.m)) AS sq
       FROM ce JOIN mu ON ce.dim = mu.dim GROUP BY ce.cluster) t ON cs.cluster = t.cluster),
wi AS (SELECT sum(sq) AS w, count(*) AS n FROM dist),
k AS (SELECT count(*) AS k FROM cs)
SELECT {r('(bw.b / (k.k - 1)) / (wi.w / (wi.n - k.k))', 8)} AS calinski_harabasz FROM bw, wi, k
"""

SQL["davies_bouldin"] = f"""
WITH {_CENT},
s AS (SELECT cluster, avg(sqrt(sq)) AS s FROM dist GROUP BY cluster),
cd AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
       FROM ce a JOIN ce b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
r AS (SELECT cd.i, max(CASE WHEN cd.d > 0 THEN (si.s + sj.s) / cd.d ELSE 0.0 END) AS worst
      FROM cd JOIN s si ON si.cluster = cd.i JOIN s sj ON sj.cluster = cd.j GROUP BY cd.i)
SELECT {r('avg(worst)', 8)} AS davies_bouldin FROM r
"""


# --- text embeddings ----------------------------------------------------------

_DOC_TF = f"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
ndoc AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + ndoc.n) / (1.0 + count(*))) + 1.0 AS idf FROM tf CROSS JOIN ndoc GROUP BY term, ndoc.n)
"""

SQL["tfidf_transform"] = f"""
WITH {_DOC_TF},
btoks AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM benchmark),
btf AS (SELECT doc_id, term, count(*) AS tf FROM btoks GROUP BY doc_id, term),
w AS (SELECT btf.doc_id, btf.term, btf.tf, btf.tf * idf.idf AS w FROM btf JOIN idf ON btf.term = idf.term)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM w
"""

_WV = """wv AS (SELECT DISTINCT term FROM toks),
wvv AS (SELECT term, CAST(length(term) AS DOUBLE) AS c0, CAST(ascii(term) - 96 AS DOUBLE) AS c1,
               CAST(ascii(right(term, 1)) - 96 AS DOUBLE) AS c2, CAST(length(term) % 3 AS DOUBLE) AS c3 FROM wv)"""

SQL["mean_word_vector_embed"] = f"""
WITH {_DOC_TF}, {_WV},
m AS (SELECT tf.doc_id, sum(tf.tf * c0) / sum(tf.tf) AS v0, sum(tf.tf * c1) / sum(tf.tf) AS v1,
             sum(tf.tf * c2) / sum(tf.tf) AS v2, sum(tf.tf * c3) / sum(tf.tf) AS v3
      FROM tf JOIN wvv ON tf.term = wvv.term GROUP BY tf.doc_id)
SELECT d.doc_id, {r('v0', 9)} AS v0, {r('v1', 9)} AS v1, {r('v2', 9)} AS v2, {r('v3', 9)} AS v3
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""

SQL["idf_weighted_word_vector_embed"] = f"""
WITH {_DOC_TF}, {_WV},
m AS (SELECT tf.doc_id, sum(tf.tf * idf.idf * c0) / sum(tf.tf) AS v0, sum(tf.tf * idf.idf * c1) / sum(tf.tf) AS v1,
             sum(tf.tf * idf.idf * c2) / sum(tf.tf) AS v2, sum(tf.tf * idf.idf * c3) / sum(tf.tf) AS v3
      FROM tf JOIN wvv ON tf.term = wvv.term JOIN idf ON tf.term = idf.term GROUP BY tf.doc_id)
SELECT d.doc_id, {r('v0', 9)} AS v0, {r('v1', 9)} AS v1, {r('v2', 9)} AS v2, {r('v3', 9)} AS v3
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""

#: The rewrites of the Treebank-style tokenizer, in their order.
_TREEBANK = [
    (r'^"', r" `` "), (r"(``)", r" \1 "), (r'([ (\[{<])"', r"\1 `` "), (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "),
    (r"\.\.\.", r" ... "), (r"([;@#$%&])", r" \1 "), (r"""([^\.])(\.)([\]\)}>"']*)\s*$""", r"\1 \2\3 "), (r"([?!])", r" \1 "),
    (r"([\]\[\(\)\{\}<>])", r" \1 "), (r"--", r" -- "), (r'"', r" '' "), (r"(\S)('')", r"\1 \2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "), (r"\s+", r" "),
]


def _treebank(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in _TREEBANK:
        out = f"regexp_replace({out}, '" + pattern.replace("'", "''") + "', '" + new.replace("'", "''") + "', 'g')"
    return f"trim({out})"


_TB_TF = f"""
tb0 AS (SELECT doc_id, {_treebank('text')} AS s FROM documents),
tb AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(s, ' ')) AS term FROM tb0 WHERE s <> '') GROUP BY ALL)"""

SQL["treebank_tokens"] = f"""
WITH {_TB_TF}
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tb GROUP BY term
"""

SQL["idf_weighted_treebank_embed"] = f"""
WITH {_TF}, {_TB_TF},
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + n.n) / (1.0 + count(*))) + 1.0 AS idf FROM tf CROSS JOIN n GROUP BY term, n.n),
top AS (SELECT max(idf) AS top FROM idf),
m AS (SELECT doc_id, sum(tf * coalesce(idf, top) * length(tb.term)) / sum(tf) AS v0, sum(tf * coalesce(idf, top) * (length(tb.term) % 3)) / sum(tf) AS v1
      FROM tb LEFT JOIN idf ON tb.term = idf.term CROSS JOIN top GROUP BY doc_id)
SELECT d.doc_id, {r('v0', 6)} AS v0, {r('v1', 6)} AS v1 FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""

SQL["nearest_labelled"] = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS rank FROM p)
SELECT id1, id2, {r('d', 9)} AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
"""

SQL["pool_token_states"] = f"""
WITH t0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}') AS tk FROM documents),
t AS (SELECT doc_id, unnest(tk) AS term, generate_subscripts(tk, 1) AS pos FROM t0),
s AS (SELECT doc_id, pos, CAST(length(term) AS DOUBLE) AS s0, CAST(ascii(term) - 96 AS DOUBLE) AS s1,
             CASE WHEN regexp_full_match(term, '[a-z]+') THEN 1.0 ELSE 0.0 END AS m FROM t),
a AS (SELECT doc_id, max(CASE WHEN pos = 1 THEN s0 END) AS f0, max(CASE WHEN pos = 1 THEN s1 END) AS f1,
             CASE WHEN sum(m) > 0 THEN sum(s0 * m) / sum(m) END AS m0, CASE WHEN sum(m) > 0 THEN sum(s1 * m) / sum(m) END AS m1,
             sum(s0) / count(*) AS p0, sum(s1) / count(*) AS p1 FROM s GROUP BY doc_id)
SELECT d.doc_id, {r('f0', 9)} AS first0, {r('f1', 9)} AS first1, {r('m0', 9)} AS masked0, {r('m1', 9)} AS masked1,
       {r('p0', 9)} AS padded0, {r('p1', 9)} AS padded1
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""

SQL["embed_with_model"] = f"""
WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents)
SELECT doc_id,
       {r("length(s) - length(replace(s, 'a', ''))", 3)} AS v0, {r("length(s) - length(replace(s, 'e', ''))", 3)} AS v1,
       {r("length(s) - length(replace(s, 'i', ''))", 3)} AS v2, {r("length(s) - length(replace(s, 'o', ''))", 3)} AS v3,
       {r("length(s) - length(replace(s, 'u', ''))", 3)} AS v4, {r('length(s)', 3)} AS v5
FROM l
"""


# --- posts and prompts ----------------------------------------------------------

_POSTS = """posts AS (SELECT conv_id AS account, turn AS ts, role AS kind, conv_id * 1000000 + turn AS post_id, text,
                  length(text) AS n_chars FROM conversations)"""

SQL["recent_texts"] = f"""
WITH {_POSTS}, r AS (SELECT account, post_id, row_number() OVER (PARTITION BY account ORDER BY ts DESC, post_id) AS rk
                     FROM posts WHERE kind <> 'system')
SELECT account, post_id, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 3
"""

SQL["top_texts_per_account"] = f"""
WITH {_POSTS}, r AS (SELECT account, post_id, row_number() OVER (PARTITION BY account ORDER BY n_chars DESC, post_id) AS rk
                     FROM posts WHERE kind <> 'system')
SELECT account, post_id, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 3
"""

_PROMPTS = f"""
WITH {_POSTS},
rr AS (SELECT account, text, row_number() OVER (PARTITION BY account ORDER BY ts DESC, post_id) AS rk
       FROM posts WHERE kind <> 'system'),
ss AS (SELECT account, text, row_number() OVER (PARTITION BY account ORDER BY n_chars DESC, post_id) AS rk
       FROM posts WHERE kind <> 'system'),
r AS (SELECT account, string_agg(CAST(rk AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY rk) AS l FROM rr
      WHERE rk <= 3 GROUP BY account),
s AS (SELECT account, string_agg(CAST(rk AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY rk) AS l FROM ss
      WHERE rk <= 3 GROUP BY account),
a AS (SELECT DISTINCT account FROM posts),
p AS (SELECT a.account, 'account ' || CAST(a.account AS VARCHAR) AS nm, r.l AS rl, s.l AS sl
      FROM a LEFT JOIN r ON a.account = r.account LEFT JOIN s ON a.account = s.account),
pr AS (SELECT account,
  CASE WHEN rl IS NOT NULL AND sl IS NOT NULL THEN
    'The following are the most recent tweets written by ' || nm || ':' || chr(10) || rl || chr(10) ||
    'The following are the most successful tweets ever written by ' || nm || ':' || chr(10) || sl || chr(10) ||
    'The following is an ' || nm || ' tweet about the weather, written in a friendly tone, that is related to recent events and has a high chance of being successful and is less than 280 characters long:' || chr(10)
  WHEN sl IS NOT NULL THEN
    'The following are the most successful tweets ever written by ' || nm || ':' || chr(10) || sl || chr(10) ||
    'The following is an ' || nm || ' tweet about the weather, written in a friendly tone, that has a high chance of being successful and is less than 280 characters long:' || chr(10)
  WHEN rl IS NOT NULL THEN
    'The following are the most recent tweets written by ' || nm || ':' || chr(10) || rl || chr(10) ||
    'The following is an ' || nm || ' tweet about the weather, written in a friendly tone, that is related to recent events and is less than 280 characters long:' || chr(10)
  ELSE 'The following is an ' || nm || ' tweet about the weather, written in a friendly tone, that is less than 280 characters long:' || chr(10)
  END AS prompt FROM p)
"""

SQL["build_prompts"] = _PROMPTS + "SELECT account, prompt FROM pr"
SQL["generate_texts"] = _PROMPTS + "SELECT account, trim(split_part(prompt, chr(10), 1)) AS generated FROM pr"

SQL["remove_observations"] = """
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)
"""

SQL["fill_missing"] = """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

SQL["parse_vector_column"] = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, CAST(len(v) AS INTEGER) AS n, {r('list_sum(v)', 9)} AS total, {r('v[1]', 9)} AS first FROM e
"""


# --- text function and TF-IDF option coverage ------------------------------------

SQL["vocabulary"] = f"""
SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM documents
"""

SQL["strip_accents"] = """
SELECT doc_id, md5(strip_accents(text)) AS md5, CAST(length(strip_accents(text)) AS INTEGER) AS n_chars FROM documents
"""

_STOP_SQL = "('the', 'and', 'of', 'de', 'la', 'und', 'der', 'el', 'y', 'en')"

SQL["tfidf_options"] = f"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '{WORD_RE}')) AS term
              FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term NOT IN {_STOP_SQL} GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
keep AS (SELECT dfq.term, dfq.df FROM dfq CROSS JOIN n WHERE dfq.df >= 2 AND dfq.df <= 0.5 * n.n),
w AS (SELECT tf.doc_id, tf.term, tf.tf, (1.0 + ln(tf.tf)) * (ln((1.0 + n.n) / (1.0 + keep.df)) + 1.0) AS w
      FROM tf JOIN keep ON tf.term = keep.term CROSS JOIN n)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, {r('w / sum(abs(w)) OVER (PARTITION BY doc_id)', 9)} AS weight FROM w
"""

for _name, _dist in (("manhattan", "list_sum([abs(a.v[i] - b.v[i]) for i in range(1, len(a.v) + 1)])"),
                     ("chebyshev", "list_max([abs(a.v[i] - b.v[i]) for i in range(1, len(a.v) + 1)])")):
    SQL[f"knn_graph_{_name}"] = f"""
WITH {_E}, p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, {_dist} AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
q AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS rk FROM p)
SELECT id1, id2, {r('d', 9)} AS distance, CAST(rk AS INTEGER) AS rank FROM q WHERE rk <= 5
"""

SQL["tfidf_max_features"] = f"""
WITH {_TF},
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 50),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1.0 + n.n) / (1.0 + dfq.df)) + 1.0) AS w
      FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN n)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM w
"""

SQL["char_counts"] = """
WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[\\t\\n\\v\\f\\r ][\\t\\n\\v\\f\\r ]+', ' ', 'g') AS x FROM documents),
c AS (SELECT doc_id, unnest(string_split(x, '')) AS term FROM t)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM c WHERE term <> '' GROUP BY doc_id, term
"""

SQL["tfidf_cluster_scores"] = f"""
WITH {_TF},
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w0 AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + dfq.df)) + 1.0) AS w FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN n),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w0),
cl AS (SELECT doc_id, coalesce(lang, '') AS own, CASE WHEN doc_id IN (SELECT doc_id FROM w) THEN 1.0 ELSE 0.0 END AS xx FROM documents),
sz AS (SELECT own AS c, count(*) AS m FROM cl GROUP BY own),
su AS (SELECT cl.own AS c, w.term, sum(w.x) AS s FROM w JOIN cl ON w.doc_id = cl.doc_id GROUP BY cl.own, w.term),
sq AS (SELECT sz.c, sz.m, coalesce(sum(su.s * su.s), 0.0) AS q FROM sz LEFT JOIN su ON sz.c = su.c GROUP BY sz.c, sz.m),
dt AS (SELECT w.doc_id, su.c, sum(w.x * su.s) AS d FROM w JOIN su ON w.term = su.term GROUP BY w.doc_id, su.c),
al AS (SELECT cl.doc_id, cl.own, cl.xx, sq.c, sq.m, sq.q, coalesce(dt.d, 0.0) AS d
       FROM cl CROSS JOIN sq LEFT JOIN dt ON dt.doc_id = cl.doc_id AND dt.c = sq.c),
ab AS (SELECT doc_id, max(CASE WHEN own = c THEN m END) AS m, max(CASE WHEN own = c THEN ((m - 1.0) - (d - xx)) / greatest(m - 1, 1) END) AS a,
              min(CASE WHEN own <> c THEN 1.0 - d / m END) AS b FROM al GROUP BY doc_id),
si AS (SELECT avg(CASE WHEN m <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS v FROM ab),
wh AS (SELECT sum(t * t) AS q FROM (SELECT sum(x) AS t FROM w GROUP BY term)),
ch AS (SELECT ((i.q - wh.q / n.n) / (i.k - 1)) / ((t.x - i.q) / (n.n - i.k)) AS v
       FROM (SELECT sum(q / m) AS q, count(*) AS k FROM sq) i, wh, n, (SELECT sum(xx) AS x FROM cl) t),
sp AS (SELECT own AS c, avg(sqrt(greatest(xx - 2.0 * d / m + q / (m * m), 0.0))) AS s FROM al WHERE own = c GROUP BY own),
gr AS (SELECT a.c AS i, b.c AS j, sum(a.s * b.s) AS g FROM su a JOIN su b ON a.term = b.term AND a.c <> b.c GROUP BY a.c, b.c),
pr AS (SELECT a.c AS i, x.s + y.s AS spread, sqrt(greatest(a.q / (a.m * a.m) + b.q / (b.m * b.m) - 2.0 * coalesce(gr.g, 0.0) / (a.m * b.m), 0.0)) AS d
       FROM sq a JOIN sq b ON a.c <> b.c LEFT JOIN gr ON gr.i = a.c AND gr.j = b.c JOIN sp x ON x.c = a.c JOIN sp y ON y.c = b.c),
db AS (SELECT avg(worst) AS v FROM (SELECT i, max(CASE WHEN d > 0 THEN spread / d ELSE 0.0 END) AS worst FROM pr GROUP BY i))
SELECT {r('si.v', 7)} AS silhouette, {r('ch.v', 4)} AS calinski_harabasz, {r('db.v', 6)} AS davies_bouldin FROM si, ch, db
"""

SQL["tfidf_transform_rows"] = SQL["tfidf_transform"]

SQL["single_linkage"] = f"""
WITH RECURSIVE {_E},
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id
         WHERE 1.0 - {_cos('a.v', 'b.v')} < 0.65),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
comp AS (SELECT x AS vec_id, min(y) AS least FROM reach GROUP BY x),
label AS (SELECT least, CAST(row_number() OVER (ORDER BY count(*) DESC, least) - 1 AS INTEGER) AS cluster FROM comp GROUP BY least)
SELECT vec_id, cluster FROM comp JOIN label USING (least)
"""

#: An invariant: the stored chain gives every fitted row the cluster of the fit.
SQL["assign_stored_model"] = "SELECT vec_id, true AS same_cluster FROM embeddings"
