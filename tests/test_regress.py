"""Regression closed forms against brute-force design-matrix fits and
leave-one-out refits (numpy), on a small fixture with known structure."""

import numpy as np
import pytest

from tessera.functions import stats as st
from tessera.operators import regress


def _fixture(seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    coefs = {3: (1.0, 2.0), 5: (4.0, -1.0), 9: (-2.0, 0.5)}  # labels not starting at 0
    i = 0
    for g, (a, b) in coefs.items():
        for _ in range({3: 12, 5: 9, 9: 15}[g]):
            x = rng.uniform(0, 10)
            rows.append((i, g, float(x), float(a + b * x + rng.normal(0, 0.5))))
            i += 1
    return rows


def _design(rows, model, labels):
    X = []
    for _, g, x, _ in rows:
        if model == "slr":
            X.append([1.0, x])
            continue
        d = [1.0 if g == lab else 0.0 for lab in labels[1:]]
        r = [1.0, x] + d
        if model == "separate":
            r += [x * v for v in d]
        X.append(r)
    return np.array(X)


def _brute(rows, model):
    labels = sorted({g for _, g, _, _ in rows})
    X = _design(rows, model, labels)
    y = np.array([r[3] for r in rows])
    n, p = X.shape
    xtx_inv = np.linalg.inv(X.T @ X)
    beta = xtx_inv @ X.T @ y
    e = y - X @ beta
    s2 = e @ e / (n - p)
    h = np.einsum("ij,jk,ik->i", X, xtx_inv, X)
    loo_beta, loo_s2 = [], []
    for i in range(n):
        m = np.ones(n, bool)
        m[i] = False
        bi = np.linalg.lstsq(X[m], y[m], rcond=None)[0]
        ei = y[m] - X[m] @ bi
        loo_beta.append(bi)
        loo_s2.append(ei @ ei / (n - 1 - p))
    loo_beta, loo_s2 = np.array(loo_beta), np.array(loo_s2)
    t_int = e / np.sqrt(s2 * (1 - h))
    t_ext = e / np.sqrt(loo_s2 * (1 - h))
    dfbetas = (beta - loo_beta) / np.sqrt(loo_s2[:, None] * np.diag(xtx_inv)[None, :])
    return dict(beta=beta, se=np.sqrt(s2 * np.diag(xtx_inv)), h=h, e=e, t_int=t_int, t_ext=t_ext,
                cooks=t_int ** 2 * h / (p * (1 - h)), dffits=t_ext * np.sqrt(h / (1 - h)),
                press=e / (1 - h), dfbetas=dfbetas, rss=e @ e, n=n, p=p)


@pytest.mark.parametrize("model", ["slr", "parallel", "separate"])
def test_ols_matches_brute_force(spark, model):
    rows = _fixture()
    df = spark.createDataFrame(rows, "id long, cluster long, x double, y double")
    fit = regress.ols_fit(df, "x", "y", "cluster", model)
    b = _brute(rows, model)
    params = {r["parameter"]: r for r in regress.ols_params(spark, fit).collect()}
    assert list(params) == fit.names
    np.testing.assert_allclose([params[k]["estimate"] for k in fit.names], b["beta"], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose([params[k]["std_err"] for k in fit.names], b["se"], rtol=1e-9)
    infl = regress.ols_influence(df, fit).orderBy("id").toPandas()
    np.testing.assert_allclose(infl["leverage"], b["h"], rtol=1e-9)
    np.testing.assert_allclose(infl["residuals"], b["e"], rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(infl["internally_studentized_residuals"], b["t_int"], rtol=1e-8)
    np.testing.assert_allclose(infl["externally_studentized_residuals"], b["t_ext"], rtol=1e-8)
    np.testing.assert_allclose(infl["student_resid"], b["t_ext"], rtol=1e-8)
    np.testing.assert_allclose(infl["cooks_d"], b["cooks"], rtol=1e-8)
    np.testing.assert_allclose(infl["dffits"], b["dffits"], rtol=1e-8)
    np.testing.assert_allclose(infl["press_residuals"], b["press"], rtol=1e-8)
    for j, name in enumerate(fit.names):
        np.testing.assert_allclose(infl[f"dfb_{name}"], b["dfbetas"][:, j], rtol=1e-7, atol=1e-10)
    m = regress.ols_metrics(spark, fit, regress.ols_influence(df, fit)).first()
    assert m["ssr"] == pytest.approx(b["rss"], rel=1e-9)
    assert m["ess_press"] == pytest.approx(float((b["press"] ** 2).sum()), rel=1e-9)
    assert m["df_resid"] == b["n"] - b["p"]


def test_separate_recovers_known_coefficients(spark):
    rows = _fixture(11)
    df = spark.createDataFrame(rows, "id long, cluster long, x double, y double")
    fit = regress.ols_fit(df, "x", "y", "cluster", "separate")
    est = dict(zip(fit.names, fit.estimates))
    assert est["const"] == pytest.approx(1.0, abs=0.6)
    assert est["x"] == pytest.approx(2.0, abs=0.15)
    assert est["x cluster_5"] == pytest.approx(-3.0, abs=0.2)
    assert est["x cluster_9"] == pytest.approx(-1.5, abs=0.2)


def test_t_distribution_tails():
    # Known values: t(10) two-sided p at 2.228 ~= 0.05; t quantile(0.975, 10) = 2.2281388519649385
    assert st.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert st.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert st.t_ppf(0.975, 1e9) == pytest.approx(1.959963984540054, rel=1e-7)
    assert st.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-7)


def test_prediction_and_lines(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, "id long, cluster long, x double, y double")
    fit = regress.ols_fit(df, "x", "y", "cluster", "separate")
    new = spark.createDataFrame([(5.0, 3), (5.0, 9), (5.0, 4)], "x double, cluster long")
    pred = [r["prediction"] for r in regress.predict_ols(new, fit).orderBy("cluster").collect()]
    g = {gr.label: gr for gr in fit.groups}
    assert pred[0] == pytest.approx(g[3].a + g[3].b * 5.0)
    assert pred[1] is None  # unknown category
    lines = regress.regression_lines(spark, fit, 0.0, 10.0, 1000)
    assert lines.count() == 3000
    last = lines.where("cluster = 9").agg({"X_plot": "max"}).first()[0]
    assert last == 10.0


def test_leverage_one_gives_null(spark):
    rows = [(1, 0.0, 1.0), (1, 2.0, 5.0), (2, 0.0, 1.0), (2, 1.0, 2.0), (2, 2.0, 2.5), (2, 3.0, 4.5)]  # two rows fix a line
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = regress.ols_fit(df, "x", "y", "g", model="separate")
    got = regress.ols_influence(df, fit).orderBy("g", "x").collect()
    assert len(got) == 6
    assert all(r["press_residuals"] is None and r["cooks_d"] is None and r["standard_resid"] is None for r in got[:2])
    assert all(r["press_residuals"] is not None for r in got[2:])


def test_t_and_f_tails():
    # tabulated two-sided values
    for t, df, p in [(2.228138852, 10, 0.05), (12.70620474, 1, 0.05), (1.959966, 1e7, 0.05), (2.575835, 1e9, 0.01), (63.65674116, 1, 0.01)]:
        assert st.t_sf2(t, df) == pytest.approx(p, rel=2e-5)
    assert st.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    # no step where the sample is large: the tail falls smoothly to the normal one
    tails = [st.t_sf2(2.5, d) for d in (9e5, 999_999, 1e6, 1_000_001, 1.1e6, 1e8, 1e10)]
    assert all(a - b > -1e-8 for a, b in zip(tails, tails[1:]))
    assert max(tails[:5]) - min(tails[:5]) < 1e-7
    assert tails[-1] == pytest.approx(0.012419330651552265, rel=1e-6)
    assert st.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert st.f_sf(3.0, 5, 1e8) == pytest.approx(0.0104, abs=5e-5)
