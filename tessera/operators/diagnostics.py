"""Residual diagnostics.

* Q-Q points need each residual's position in sorted order: a global
  contiguous rank (range-partitioned sort + partition offsets), never a
  single-partition window.
* Histograms and curves are a handful of global scalars (min, max, mean,
  population std, count) from one aggregate, then per-row arithmetic and a
  ``groupBy`` over at most ``bins`` keys (map-side combined).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import normal_pdf, normal_ppf, normal_ppf_scalar
from tessera.operators.metrics import clean_metric
from tessera.sources.keys import add_row_number
from tessera.session import reliable_checkpoint

LINE_TYPES = ("45", "s", "r", "q")


def _moments(df: DataFrame, col: str):
    v = clean_metric(col)
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                  F.min(v).alias("min"), F.max(v).alias("max")).first()


def qq_points(df: DataFrame, resid: str = "externally_studentized_residuals", standardise: bool = True,
              keep: list[str] | None = None) -> DataFrame:
    """G1: ``qq_x`` = standard normal quantile of i/(n+1), ``qq_y`` = the i-th
    smallest residual standardised by mean and population std (skipped, as
    in the reference library, when the mean is exactly 0 or the std exactly 1).
    Rows with a missing residual are dropped.  ``keep`` limits the carried
    columns (default: all, i.e. the regression rows plus ``qq_x``, ``qq_y``)."""
    # The residuals are read three times (moments, range sample, numbering):
    # materialise them once, with only the columns that are carried.
    cols = df.columns if keep is None else list(dict.fromkeys([*keep, resid]))
    rows = reliable_checkpoint(df.where(clean_metric(resid).isNotNull()).select(*cols))
    m = _moments(rows, resid)
    n, mean, std = m["n"], m["mean"], m["std"]
    ranked = add_row_number(rows, [clean_metric(resid)], name="qq_position", start=1)
    y = clean_metric(resid)
    if standardise and mean is not None and std and mean != 0 and std != 1:
        y = (y - F.lit(mean)) / F.lit(std)
    return ranked.withColumn("qq_x", normal_ppf(F.col("qq_position") / F.lit(float(n + 1)))).withColumn("qq_y", y)


def qq_reference_line(points: DataFrame, x: str = "qq_x", y: str = "qq_y") -> DataFrame:
    """Slope and intercept of the 45-degree, standardised (s), regression
    (r) and quartile (q) reference lines, one row per type.  The quartiles are
    read at their positions in the sorted order (``qq_position``), so no task
    gathers the residuals."""
    n = points.count()

    def quartile(q):  # linear interpolation between the two nearest positions
        h = q * (n - 1)
        low = math.floor(h)
        at = lambda i: F.max(F.when(F.col("qq_position") == i + 1, F.col(y)))
        return at(low) + (at(math.ceil(h)) - at(low)) * F.lit(h - low)

    agg = points.agg(
        F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"), F.regr_slope(y, x).alias("rs"),
        F.regr_intercept(y, x).alias("ri"), quartile(0.25).alias("q25"), quartile(0.75).alias("q75"),
    )
    tq1, tq3 = normal_ppf_scalar(0.25), normal_ppf_scalar(0.75)
    slope_q = (F.col("q75") - F.col("q25")) / F.lit(tq3 - tq1)
    def line(t, slope, intercept):
        return F.struct(F.lit(t).alias("line_type"), slope.cast("double").alias("slope"),
                        intercept.cast("double").alias("intercept"))

    lines = agg.select(F.explode(F.array(
        line("45", F.lit(1.0), F.lit(0.0)),
        line("s", F.col("sy"), F.col("my")),
        line("r", F.col("rs"), F.col("ri")),
        line("q", slope_q, F.col("q25") - slope_q * F.lit(tq1)),
    )).alias("l"))
    return lines.select("l.line_type", "l.slope", "l.intercept")


def _linspace_point(i, lo: float, hi: float, num: int):
    step = (hi - lo) / (num - 1) if num > 1 else 0.0
    return F.when(i == num - 1, F.lit(float(hi))).otherwise(i * F.lit(step) + F.lit(float(lo)))


def residual_histogram(df: DataFrame, resid: str = "externally_studentized_residuals", bins: int = 30) -> DataFrame:
    """H1: equal-width bins over the non-missing min..max; last bin closed;
    all-equal input widened by +-0.5.  ``bin_count``, ``bin_probability``
    (density), edges and a text description, empty bins included."""
    spark = df.sparkSession
    m = _moments(df, resid)
    lo, hi = m["min"], m["max"]
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_count long, bin_probability double, left_edge double, "
                                         "right_edge double, Description string")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    total = float(m["n"])
    step = (hi - lo) / bins
    v = clean_metric(resid)

    def edge(i):
        return F.when(i >= bins, F.lit(float(hi))).otherwise(i.cast("double") * F.lit(step) + F.lit(float(lo)))

    raw = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
    idx0 = F.when(raw >= bins, F.lit(bins - 1)).otherwise(raw)
    idx1 = F.when(v < edge(idx0), idx0 - 1).otherwise(idx0)
    idx = F.when((v >= edge(idx1 + 1)) & (idx1 != bins - 1), idx1 + 1).otherwise(idx1)
    counts = df.where(v.isNotNull()).select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("bin_count"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = all_bins.join(counts, "bin", "left").withColumn("bin_count", F.coalesce("bin_count", F.lit(0)).cast("long"))
    left = edge(F.col("bin"))
    right = edge(F.col("bin") + 1)
    return h.select(
        "bin", "bin_count",
        (F.col("bin_count") / (right - left) / F.lit(total)).alias("bin_probability"),
        left.alias("left_edge"), right.alias("right_edge"),
        F.format_string("Bin Min: %.3f, Bin Max: %.3f", left, right).alias("Description"),
    )


def normal_curve(df: DataFrame, resid: str = "externally_studentized_residuals", points: int = 200) -> DataFrame:
    """H2: N(0, population std of the residuals) density at ``points`` evenly
    spaced x over the residual range."""
    spark = df.sparkSession
    m = _moments(df, resid)
    lo, hi, std = m["min"], m["max"], m["std"]
    if lo is None:
        return spark.createDataFrame([], "i int, x double, y double")
    idx = spark.range(points).select(F.col("id").cast("int").alias("i"))
    x = _linspace_point(F.col("i"), lo, hi, points)
    return idx.select("i", x.alias("x"), normal_pdf(x, F.lit(float(std))).alias("y"))


def residual_bins(df: DataFrame, x: str = "leverage", y: str = "externally_studentized_residuals",
                  bins: int = 20, buffer: float = 0.05) -> DataFrame:
    """R9 for large n: counts on a ``bins`` x ``bins`` grid over the buffered
    axis range of (x, y) instead of one point per row."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if r["x0"] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n long")
    xr, yr = r["x1"] - r["x0"], r["y1"] - r["y0"]
    x0, x1 = r["x0"] - xr * buffer, r["x1"] + xr * buffer
    y0, y1 = r["y0"] - yr * buffer, r["y1"] + yr * buffer

    def cell(c, lo, hi):
        width = (hi - lo) if hi > lo else 1.0
        raw = F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * F.lit(float(bins))).cast("int")
        return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))

    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pts.groupBy(cell(x, x0, x1).alias("x_bin"), cell(y, y0, y1).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"))


def log_transform(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Add ``Log <col>`` = natural log.  Zero and negative values give
    NULL (not -inf / NaN); the number of such rows is returned."""
    name = f"Log {col}"
    c = F.col(col).cast("double")
    out = df.withColumn(name, F.when(c > 0, F.log(c)))
    dropped = df.where(~(c > 0) | c.isNull()).count()
    return out, dropped


def undo_log_name(name: str) -> str:
    """P1 inverse naming: strip the first ``"Log "`` prefix."""
    return name[4:] if name.startswith("Log ") else name

