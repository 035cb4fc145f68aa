"""Output shaping for comparable floating-point results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero (``+ 0.0``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
