"""Statistical scalar functions (F8).

* ``normal_ppf``: the inverse normal CDF as a Catalyst expression, using the
  published rational approximation AS241 (Wichura 1988, accurate to about
  1e-16).  The same polynomial is rendered as SQL text by ``normal_ppf_sql``
  so an independent engine evaluates the identical formula.
* ``normal_pdf``: Gaussian density expression.
* Student-t and F tail probabilities for a handful of driver-side scalars
  (regression p-values and confidence intervals), via the regularised
  incomplete beta function (continued fraction, modified Lentz).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# AS241 coefficients (Wichura 1988), highest power first.
_CENTRAL_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
                13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
_CENTRAL_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
                5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
_MID_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
            3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
_MID_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
            0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
_TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
             0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699,
             6.6579046435011037772]
_TAIL_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
             7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]


def _horner(coefs, x):
    acc = None
    for c in coefs:
        acc = F.lit(c) if acc is None else acc * x + F.lit(c)
    return acc


def normal_ppf(p, mu=0.0, sigma=1.0) -> Column:
    """Inverse standard normal CDF of a probability column (NULL outside (0,1))."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(_CENTRAL_NUM, r_c) / _horner(_CENTRAL_DEN, r_c)
    r_t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    mid = _horner(_MID_NUM, r_t - F.lit(1.6)) / _horner(_MID_DEN, r_t - F.lit(1.6))
    tail = _horner(_TAIL_NUM, r_t - F.lit(5.0)) / _horner(_TAIL_DEN, r_t - F.lit(5.0))
    outer = F.when(r_t <= 5.0, mid).otherwise(tail)
    outer = F.when(q < 0, -outer).otherwise(outer)
    z = F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(F.abs(q) <= 0.425, central).otherwise(outer)
    return F.lit(mu) + z * F.lit(sigma)


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"(({acc}) * ({x}) + {c!r})"
    return acc


def normal_ppf_sql(p: str) -> str:
    """The same AS241 evaluation as SQL text (for an oracle engine)."""
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    rt = f"sqrt(-ln(least({p}, 1.0 - ({p}))))"
    central = f"({q} * {_horner_sql(_CENTRAL_NUM, rc)} / {_horner_sql(_CENTRAL_DEN, rc)})"
    mid = f"({_horner_sql(_MID_NUM, rt + ' - 1.6')} / {_horner_sql(_MID_DEN, rt + ' - 1.6')})"
    tail = f"({_horner_sql(_TAIL_NUM, rt + ' - 5.0')} / {_horner_sql(_TAIL_DEN, rt + ' - 5.0')})"
    outer = f"(CASE WHEN {rt} <= 5.0 THEN {mid} ELSE {tail} END)"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)")


def normal_ppf_scalar(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_pdf(x, sigma=1.0, mu=0.0) -> Column:
    """Gaussian density; ``sigma`` may be a Column."""
    x = F.col(x) if isinstance(x, str) else x
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    m = mu if isinstance(mu, Column) else F.lit(float(mu))
    z = (x - m) / s
    return F.exp(F.lit(-0.5) * z * z) / (F.lit(math.sqrt(2.0 * math.pi)) * s)


# --- driver-side distribution tails (on p parameters, never on rows) -------

def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta does not converge for a={a}, b={b}, x={x}")


def _lgamma_step(a: float, b: float) -> float:
    """log Gamma(a + b) - log Gamma(a) without the cancellation of two large
    logarithms: recurrence up to a >= 20, then the difference of Stirling
    series."""
    shift = 0.0
    while a < 20.0:
        shift += math.log(a / (a + b))
        a += 1.0
    c = a + b

    def tail(z):
        r = 1.0 / (z * z)
        return (1.0 / 12.0 - r * (1.0 / 360.0 - r * (1.0 / 1260.0 - r / 1680.0))) / z

    return shift + (a - 0.5) * math.log1p(b / a) + b * math.log(c) - b + tail(c) - tail(a)


def betainc_reg(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` = 1 - x where the caller
    has it without cancellation."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    big, small = max(a, b), min(a, b)
    log_beta = math.lgamma(small) - _lgamma_step(big, small)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(a * log_x + b * log_y - log_beta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, y) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value P(|T| > |t|) of Student's t with ``df`` degrees."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t (bisection on the CDF; p in (0, 1))."""
    if df <= 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    upper = p > 0.5
    target = 2.0 * (1.0 - p) if upper else 2.0 * p  # two-sided tail mass
    lo, hi = 0.0, 1.0
    while t_sf2(hi, df) > target:
        hi *= 2.0
        if hi > 1e300:
            break
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf2(mid, df) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, hi):
            break
    x = 0.5 * (lo + hi)
    return x if upper else -x


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail P(F > f) of the F distribution."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))
