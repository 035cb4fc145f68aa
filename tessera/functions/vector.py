"""Dense-vector expressions (F6, F7) over ``ARRAY<DOUBLE>`` columns.

All are higher-order Catalyst functions (``zip_with`` / ``aggregate``), so
they run JVM-side per row without any Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def clean(col) -> Column:
    """The vector as ``array<double>``; NULL where it is null or holds a null, which counts as having no vector."""
    v = as_double_array(col)
    return F.when(~F.exists(v, lambda x: x.isNull()), v)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def l1_norm(a) -> Column:
    return _sum(F.transform(_c(a), lambda x: F.abs(x)))


def normalize(a, norm: str = "l2") -> Column:
    """Unit vector; a zero vector stays zero.  The norm is bound by a lambda, so that it is found once a row and not for each
    element."""
    n = l2_norm(a) if norm == "l2" else l1_norm(a)
    unit = F.transform(F.array(n), lambda m: F.transform(_c(a), lambda x: F.when(m > 0, x / m).otherwise(F.lit(0.0))))
    return F.element_at(unit, 1)


def cosine_similarity(a, b) -> Column:
    """x.y / (|x||y|); 0 when either vector is zero."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def squared_euclidean(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def hellinger(a, b) -> Column:
    """sqrt(1 - sum(sqrt(x y)) / sqrt(sum x * sum y)) for non-negative inputs;
    two zero vectors are at distance 0, a zero vector is at 1 from any other."""
    bc = _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.sqrt(x * y)))
    sa, sb = _sum(_c(a)), _sum(_c(b))
    none = F.when((sa == 0) & (sb == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.try_divide(bc, F.sqrt(sa * sb)), none)))


DISTANCES = {
    "cosine": cosine_distance,
    "euclidean": euclidean,
    "l2": euclidean,
    "manhattan": manhattan,
    "l1": manhattan,
    "chebyshev": chebyshev,
    "hellinger": hellinger,
}


def distance(metric: str):
    try:
        return DISTANCES[metric]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(DISTANCES)}") from None


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)
