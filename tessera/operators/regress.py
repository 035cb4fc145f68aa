"""Ordinary least squares of one metric on another, per category.

Three models, as in the dashboard's regression tab:

* ``slr``       y = a + b x
* ``parallel``  y = a_g + b x          (one slope, intercept shift per group)
* ``separate``  y = a_g + b_g x        (slope shift per group too)

Everything follows from one ``groupBy(category)`` of centred sufficient
statistics (n, means, Sxx, Sxy, Syy via ``var_pop`` / ``covar_pop``, merged
map-side).  Only those k rows reach the driver (k is checked); parameters,
their covariance and the per-group leave-one-out coefficients are closed
forms of them, and the per-row diagnostics are a single broadcast-join map
over the data.  No refits, no design matrix.

Parameter names follow the reference layout: ``const``, the x column,
``cluster_<label>`` for intercept shifts and ``<x> cluster_<label>`` for slope
shifts, the smallest label being the reference group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats as st

MAX_GROUPS = 10_000
MODELS = ("slr", "parallel", "separate")


@dataclass
class Group:
    label: object
    n: int
    xbar: float
    ybar: float
    sxx: float
    sxy: float
    syy: float
    a: float | None = None
    b: float | None = None


@dataclass
class OlsFit:
    model: str
    x: str
    y: str
    cat: str | None
    prefix: str
    groups: list[Group]
    n: int
    p: int
    rss: float
    tss_c: float
    tss_u: float
    names: list[str] = field(default_factory=list)
    estimates: list[float | None] = field(default_factory=list)
    cov_diag: list[float | None] = field(default_factory=list)  # [(X'X)^-1]_jj (times s2 = variance)

    @property
    def df_resid(self) -> int:
        return self.n - self.p

    @property
    def s2(self) -> float | None:
        return self.rss / self.df_resid if self.df_resid > 0 else None

    def slope_denominator(self, g: Group) -> float | None:
        """Sxx that scales the leverage and slope of group g."""
        if self.model == "parallel":
            w = sum(gr.sxx for gr in self.groups)
            return w if w > 0 else None
        return g.sxx if g.sxx > 0 else None


def _div(a, b):
    return None if a is None or b is None or b == 0 else a / b


def group_statistics(df: DataFrame, x: str, y: str, cat: str | None) -> DataFrame:
    """Centred sufficient statistics per category (partial aggregation)."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc) & ~F.isnan(yc))
    key = F.col(cat) if cat else F.lit(0)
    n = F.count(F.lit(1))
    return rows.groupBy(key.alias("_g")).agg(
        n.alias("n"), F.avg(xc).alias("xbar"), F.avg(yc).alias("ybar"),
        (F.var_pop(xc) * n).alias("sxx"), (F.covar_pop(xc, yc) * n).alias("sxy"),
        (F.var_pop(yc) * n).alias("syy"),
    )


def ols_fit(df: DataFrame, x: str, y: str, cat: str | None = None, model: str = "slr",
            prefix: str = "cluster") -> OlsFit:
    """Fit the model from the k group statistics (one aggregation job)."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    if model != "slr" and cat is None:
        raise ValueError(f"model {model!r} needs a category column")
    use_cat = cat if model != "slr" else None
    stats = group_statistics(df, x, y, use_cat).limit(MAX_GROUPS + 1).collect()
    if len(stats) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} categories; regression per category needs a small label set")
    groups = sorted((Group(r["_g"], int(r["n"]), r["xbar"], r["ybar"], r["sxx"], r["sxy"], r["syy"]) for r in stats),
                    key=lambda g: g.label)
    if not groups:
        raise ValueError("no rows with both x and y")
    n = sum(g.n for g in groups)
    ybar = sum(g.n * g.ybar for g in groups) / n
    tss_c = sum(g.syy + g.n * (g.ybar - ybar) ** 2 for g in groups)
    tss_u = tss_c + n * ybar * ybar
    k = len(groups)
    if model == "slr":
        g = groups[0]
        g.b = _div(g.sxy, g.sxx if g.sxx > 0 else None)
        g.a = g.ybar - g.b * g.xbar if g.b is not None else None
        rss = g.syy - (g.sxy * g.sxy / g.sxx if g.sxx > 0 else 0.0)
        p = 2
    elif model == "parallel":
        w = sum(gr.sxx for gr in groups)
        b = _div(sum(gr.sxy for gr in groups), w if w > 0 else None)
        for gr in groups:
            gr.b = b
            gr.a = gr.ybar - b * gr.xbar if b is not None else None
        rss = sum(gr.syy for gr in groups) - (sum(gr.sxy for gr in groups) ** 2 / w if w > 0 else 0.0)
        p = k + 1
    else:
        rss = 0.0
        for gr in groups:
            gr.b = _div(gr.sxy, gr.sxx if gr.sxx > 0 else None)
            gr.a = gr.ybar - gr.b * gr.xbar if gr.b is not None else None
            rss += gr.syy - (gr.sxy * gr.sxy / gr.sxx if gr.sxx > 0 else 0.0)
        p = 2 * k
    fit = OlsFit(model, x, y, use_cat, prefix, groups, n, p, max(rss, 0.0), tss_c, tss_u)
    _parameters(fit)
    return fit


def _parameters(fit: OlsFit) -> None:
    """Estimates and [(X'X)^-1]_jj of the reported parameters."""
    gs, x = fit.groups, fit.x
    g0 = gs[0]
    names, est, cov = [], [], []

    def add(name, e, c):
        names.append(name)
        est.append(e)
        cov.append(c)

    if fit.model == "slr":
        sxx = g0.sxx if g0.sxx > 0 else None
        add("const", g0.a, None if sxx is None else 1.0 / g0.n + g0.xbar ** 2 / sxx)
        add(x, g0.b, _div(1.0, sxx))
    elif fit.model == "parallel":
        w = fit.slope_denominator(g0)
        add("const", g0.a, None if w is None else 1.0 / g0.n + g0.xbar ** 2 / w)
        add(x, g0.b, _div(1.0, w))
        for g in gs[1:]:
            add(f"{fit.prefix}_{g.label}", None if g.a is None else g.a - g0.a,
                None if w is None else 1.0 / g0.n + 1.0 / g.n + (g.xbar - g0.xbar) ** 2 / w)
    else:
        s0 = g0.sxx if g0.sxx > 0 else None
        add("const", g0.a, None if s0 is None else 1.0 / g0.n + g0.xbar ** 2 / s0)
        add(x, g0.b, _div(1.0, s0))
        for g in gs[1:]:
            sg = g.sxx if g.sxx > 0 else None
            ok = s0 is not None and sg is not None
            add(f"{fit.prefix}_{g.label}", g.a - g0.a if ok else None,
                1.0 / g.n + g.xbar ** 2 / sg + 1.0 / g0.n + g0.xbar ** 2 / s0 if ok else None)
        for g in gs[1:]:
            sg = g.sxx if g.sxx > 0 else None
            ok = s0 is not None and sg is not None
            add(f"{x} {fit.prefix}_{g.label}", g.b - g0.b if ok else None, 1.0 / sg + 1.0 / s0 if ok else None)
    fit.names, fit.estimates, fit.cov_diag = names, est, cov


def _dfbeta_coefficients(fit: OlsFit, g: Group) -> list[tuple[float | None, float | None]]:
    """For a row of group g: DFBETA_j = (u_j + v_j x) e / (1 - h), per parameter j."""
    gs = fit.groups
    g0 = gs[0]
    out: list[tuple[float | None, float | None]] = []
    if fit.model == "slr":
        s = fit.slope_denominator(g)
        if s is None:
            return [(None, None)] * len(fit.names)
        out.append((1.0 / g.n + g.xbar ** 2 / s, -g.xbar / s))
        out.append((-g.xbar / s, 1.0 / s))
        return out
    if fit.model == "parallel":
        w = fit.slope_denominator(g)
        if w is None:
            return [(None, None)] * len(fit.names)

        def da(m: Group):
            u = (1.0 / g.n if m.label == g.label else 0.0) + m.xbar * g.xbar / w
            return u, -m.xbar / w

        u0, v0 = da(g0)
        out.append((u0, v0))
        out.append((-g.xbar / w, 1.0 / w))
        for m in gs[1:]:
            um, vm = da(m)
            out.append((um - u0, vm - v0))
        return out
    s = g.sxx if g.sxx > 0 else None
    if s is None:
        return [(None, None)] * len(fit.names)
    da = (1.0 / g.n + g.xbar ** 2 / s, -g.xbar / s)
    db = (-g.xbar / s, 1.0 / s)
    neg = lambda t: (-t[0], -t[1])
    zero = (0.0, 0.0)
    k = len(gs)
    if g.label == g0.label:
        return [da, db] + [neg(da)] * (k - 1) + [neg(db)] * (k - 1)
    shifts_a = [da if m.label == g.label else zero for m in gs[1:]]
    shifts_b = [db if m.label == g.label else zero for m in gs[1:]]
    return [zero, zero] + shifts_a + shifts_b


def coefficient_table(spark: SparkSession, fit: OlsFit) -> DataFrame:
    """One row per group: label, a, b, n, xbar, leverage denominator and the
    DFBETA coefficient arrays (size bounded by the checked group count)."""
    rows = []
    for g in fit.groups:
        coefs = _dfbeta_coefficients(fit, g)
        rows.append((g.label if fit.cat else 0, g.a, g.b, g.n, g.xbar, fit.slope_denominator(g),
                     [c[0] for c in coefs], [c[1] for c in coefs]))
    label_type = "long"
    if fit.cat:
        sample = fit.groups[0].label
        label_type = "string" if isinstance(sample, str) else ("double" if isinstance(sample, float) else "long")
    schema = (f"_g {label_type}, _a double, _b double, _n long, _xbar double, _sxx double, "
              "_du array<double>, _dv array<double>")
    return spark.createDataFrame(rows, schema)


def ols_params(spark: SparkSession, fit: OlsFit, inference: bool = True, alpha: float = 0.05) -> DataFrame:
    """Parameter, estimate, std_err, t_value (+ p_value, lower_ci, upper_ci)."""
    s2 = fit.s2
    dfr = fit.df_resid
    tcrit = st.t_ppf(1.0 - alpha / 2.0, dfr) if dfr > 0 else float("nan")
    rows = []
    for i, (name, e, c) in enumerate(zip(fit.names, fit.estimates, fit.cov_diag)):
        se = math.sqrt(s2 * c) if (s2 is not None and c is not None and s2 * c >= 0) else None
        t = e / se if (e is not None and se) else None
        row = [i, name, e, se, t]
        if inference:
            pv = st.t_sf2(abs(t), dfr) if t is not None else None
            lo = e - tcrit * se if (e is not None and se is not None) else None
            hi = e + tcrit * se if (e is not None and se is not None) else None
            row += [pv, lo, hi]
        rows.append(tuple(row))
    schema = "position int, parameter string, estimate double, std_err double, t_value double"
    if inference:
        schema += ", p_value double, lower_ci double, upper_ci double"
    return spark.createDataFrame(rows, schema)


def ols_influence(df: DataFrame, fit: OlsFit) -> DataFrame:
    """Per row fitted value, residual, leverage, Cook's distance, DFFITS
    (internal and external), DFBETAS per parameter, studentized residuals
    (internal and external) and PRESS residual.  Leverage 1 gives NULL."""
    spark = df.sparkSession
    xc, yc = F.col(fit.x).cast("double"), F.col(fit.y).cast("double")
    if fit.cat:
        coefs = F.broadcast(coefficient_table(spark, fit))
        j = df.withColumn("_g", F.col(fit.cat)).join(coefs, "_g", "left")
    else:
        # one group: its coefficients are plan literals (no join on a constant key)
        row = coefficient_table(spark, fit).first()
        j = df
        for c in ("_a", "_b", "_n", "_xbar", "_sxx", "_du", "_dv"):
            j = j.withColumn(c, F.lit(row[c]))
    p, n = float(fit.p), float(fit.n)
    s2 = fit.s2 if fit.s2 is not None else float("nan")
    # ``x`` and ``y`` are (re)written as copies of the model columns, as in the
    # reference; other input columns pass through.
    base_cols = [F.col(c) for c in df.columns if c not in ("x", "y")]
    # Staged projections: every intermediate is a column computed once, so
    # each stage stays small enough for whole-stage code generation.
    st1 = j.select(*base_cols, "_du", "_dv", xc.alias("x"), yc.alias("y"),
                   (F.col("_a") + F.col("_b") * xc).alias("fitted_values"),
                   (F.lit(1.0) / F.col("_n") + F.try_divide((xc - F.col("_xbar")) * (xc - F.col("_xbar")), F.col("_sxx")))
                   .alias("leverage"))
    e = F.col("y") - F.col("fitted_values")
    st2 = st1.select("*", e.alias("residuals"), (F.lit(1.0) - F.col("leverage")).alias("_omh"))
    valid = F.col("_omh") > 1e-12
    st3 = st2.select(
        "*",
        F.when(valid, F.try_divide(F.col("residuals"), F.col("_omh"))).alias("press_residuals"),
        F.try_divide(F.lit((n - p) * s2) - F.try_divide(F.col("residuals") * F.col("residuals"), F.col("_omh")), F.lit(n - p - 1.0))
        .alias("_s2i"),
        F.when(valid, F.sqrt(F.try_divide(F.col("leverage"), F.col("_omh")))).alias("_ratio"),
    )
    ok_ext = valid & (F.col("_s2i") > 0)
    st4 = st3.select(
        "*",
        F.when(valid, F.try_divide(F.col("residuals"), F.sqrt(F.lit(s2) * F.col("_omh")))).alias("_tint"),
        F.when(ok_ext, F.try_divide(F.col("residuals"), F.sqrt(F.col("_s2i") * F.col("_omh")))).alias("_text"),
    )
    out = st4.select(
        *base_cols, "x", "y", "fitted_values", "residuals", "leverage",
        F.when(valid, F.try_divide(F.col("_tint") * F.col("_tint") * F.col("leverage"), F.lit(p) * F.col("_omh")))
        .alias("cooks_d"),
        F.col("_tint").alias("standard_resid"),
        (F.col("_tint") * F.col("_ratio")).alias("dffits_internal"),
        F.col("_text").alias("student_resid"),
        (F.col("_text") * F.col("_ratio")).alias("dffits"),
        F.col("_text").alias("externally_studentized_residuals"),
        "press_residuals",
        F.col("_tint").alias("internally_studentized_residuals"),
        *[
            F.when(ok_ext, F.try_divide(
                (F.element_at("_du", i + 1) + F.element_at("_dv", i + 1) * F.col("x")) * F.col("press_residuals"),
                F.sqrt(F.col("_s2i") * F.lit(c if c is not None else float("nan"))))).alias(f"dfb_{name}")
            for i, (name, c) in enumerate(zip(fit.names, fit.cov_diag))
        ],
    )
    return out


def ols_metrics(spark: SparkSession, fit: OlsFit, influence: DataFrame | None = None) -> DataFrame:
    """One row of fit statistics; PRESS needs the influence rows (one
    aggregate over them)."""
    n, p, rss = float(fit.n), float(fit.p), fit.rss
    s2 = fit.s2
    ess = fit.tss_c - rss
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1.0) if rss > 0 else float("inf")
    fval = (ess / (p - 1.0)) / s2 if (p > 1 and s2) else None
    row = {
        "nobs": n, "df_model": p - 1.0, "df_resid": n - p, "fvalue": fval,
        "f_pvalue": st.f_sf(fval, p - 1.0, n - p) if fval is not None else None,
        "ess": ess, "ssr": rss, "centered_tss": fit.tss_c, "uncentered_tss": fit.tss_u,
        "rsquared": 1.0 - rss / fit.tss_c if fit.tss_c > 0 else None,
        "rsquared_adj": 1.0 - (rss / fit.tss_c) * (n - 1.0) / (n - p) if fit.tss_c > 0 and n > p else None,
        "aic": -2.0 * llf + 2.0 * p, "bic": -2.0 * llf + p * math.log(n), "llf": llf,
        "mse_model": ess / (p - 1.0) if p > 1 else None, "mse_resid": s2,
        "mse_total": fit.tss_c / (n - 1.0) if n > 1 else None,
    }
    one = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    if influence is None:
        return one
    press = influence.agg(F.sum(F.col("press_residuals") * F.col("press_residuals"))).first()[0]
    return one.withColumn("ess_press", F.lit(press).cast("double"))


def regression_lines(spark: SparkSession, fit: OlsFit, x_min: float, x_max: float, n: int = 1000) -> DataFrame:
    """``n`` evenly spaced x over the global range per category, predicted y."""
    coefs = coefficient_table(spark, fit).select(F.col("_g").alias("cluster"), "_a", "_b")
    step = (x_max - x_min) / (n - 1) if n > 1 else 0.0
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pts = coefs.select("cluster", "_a", "_b", i.alias("_i"))
    xp = F.when(F.col("_i") == n - 1, F.lit(float(x_max))).otherwise(F.col("_i") * F.lit(step) + F.lit(float(x_min)))
    return pts.select("cluster", xp.alias("X_plot"), (F.col("_a") + F.col("_b") * xp).alias("y_plot"))


def predict_ols(new: DataFrame, fit: OlsFit, x: str | None = None, cat: str | None = None,
                name: str = "prediction") -> DataFrame:
    """Predicted y for new rows (x and, for grouped models, category).
    The constant is always included; unknown categories give NULL."""
    spark = new.sparkSession
    x = x or fit.x
    if fit.cat:
        coefs = F.broadcast(coefficient_table(spark, fit).select("_g", "_a", "_b"))
        j = new.withColumn("_g", F.col(cat or fit.cat)).join(coefs, "_g", "left")
    else:
        g = fit.groups[0]
        j = new.withColumn("_g", F.lit(0)).withColumn("_a", F.lit(g.a)).withColumn("_b", F.lit(g.b))
    return j.withColumn(name, F.col("_a") + F.col("_b") * F.col(x).cast("double")).drop("_g", "_a", "_b")


def slr_expressions(x, y) -> tuple[Column, Column]:
    """R1 as plain aggregates: (slope, intercept)."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)
