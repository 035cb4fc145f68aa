"""Aggregations, ranks and top-k over metric columns.

Exact medians never buffer a group in one task: values are range-sorted by
``(group, value)`` (a hot group spreads over many range partitions), numbered
globally, and the one or two middle positions of each group are picked by a
join with per-group counts.  ``median="approx"`` uses ``percentile_approx``
(bounded memory, one pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.keys import add_row_number

# Names of the statistics, in the order of the result.
STATISTICS = ("mean", "median", "min", "max", "sum", "std", "var", "sem", "size")


def clean_metric(col) -> Column:
    """Metric as double with NaN turned into NULL (pandas skips NaN)."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def group_median(df: DataFrame, group_col: str, value_col: str, name: str = "median") -> DataFrame:
    """Exact per-group median (mean of the two middle values for even counts)."""
    vals = df.select(group_col, clean_metric(value_col).alias("_v")).where(F.col("_v").isNotNull())
    numbered = add_row_number(vals, [group_col, "_v"], name="_pos", start=0)
    bounds = numbered.groupBy(group_col).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    lo = (F.col("_first") + F.floor((F.col("_n") - 1) / 2)).cast("long")
    hi = (F.col("_first") + F.floor(F.col("_n") / 2)).cast("long")
    # the middle positions of each group: a position is in one row, so no group is one join key
    wanted = bounds.select(F.explode(F.array_distinct(F.array(lo, hi))).alias("_pos"))
    return numbered.join(wanted, "_pos").groupBy(group_col).agg(F.avg("_v").alias(name))


def cluster_metric_stats(df: DataFrame, column: str, sort_metric: str = "mean", cluster_col: str = "cluster",
                         median: str = "exact") -> DataFrame:
    """A1 + W1: per cluster mean, median, min, max, sum, std, var, sem, size;
    sorted by ``sort_metric`` descending, 0-based ``rank``, ``metric`` = the
    chosen statistic.

    std / var / sem use ddof 1 (NULL for one-row groups); ``size`` counts rows
    with a missing metric too; the sum of an all-missing group is 0.
    """
    if sort_metric not in STATISTICS:
        raise ValueError(f"sort_metric must be one of {STATISTICS}")
    v = clean_metric(column)
    aggs = [
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.stddev_samp(v).alias("std"),
        F.var_samp(v).alias("var"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"),
        F.count(F.lit(1)).alias("size"),
    ]
    if median == "approx":
        aggs.append(F.percentile_approx(v, 0.5, 10000).cast("double").alias("median"))
        stats = df.groupBy(cluster_col).agg(*aggs)
    elif median == "exact":
        medians = group_median(df, cluster_col, column).withColumnRenamed(cluster_col, "_group")
        stats = df.groupBy(cluster_col).agg(*aggs)
        stats = stats.join(medians, F.col(cluster_col).eqNullSafe(F.col("_group")), "left").drop("_group")
    else:
        raise ValueError("median must be 'exact' or 'approx'")
    stats = stats.withColumn("metric", F.col(sort_metric))
    ranked = add_row_number(stats, [F.col("metric").desc_nulls_last(), F.col(cluster_col)], name="rank", start=0)
    return ranked.select(
        F.col("rank").cast("int").alias("rank"), F.col(cluster_col).alias("cluster"),
        *[F.col(s) for s in STATISTICS], "metric",
    ).orderBy("rank")  # k rows


def axis_range(df: DataFrame, x: str, y: str, buffer: float = 0.05) -> DataFrame:
    """A4: one row ``x_min, x_max, y_min, y_max`` widened by ``buffer`` x range."""
    r = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    b = F.lit(float(buffer))
    return r.select(
        (F.col("_x0") - (F.col("_x1") - F.col("_x0")) * b).alias("x_min"),
        (F.col("_x1") + (F.col("_x1") - F.col("_x0")) * b).alias("x_max"),
        (F.col("_y0") - (F.col("_y1") - F.col("_y0")) * b).alias("y_min"),
        (F.col("_y1") + (F.col("_y1") - F.col("_y0")) * b).alias("y_max"),
    )


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """A5: rows per distinct value (``value``, ``n``)."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def category_summary(df: DataFrame, col: str) -> DataFrame:
    """A5: one row with the distinct count and the smallest / largest label."""
    return df.agg(
        F.countDistinct(col).alias("n_distinct"),
        F.min(col).cast("string").alias("min_label"),
        F.max(col).cast("string").alias("max_label"),
    )


def top_texts(df: DataFrame, metric: str, n: int, bigger_is_better: bool = True,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """K1: the ``n`` best texts by ``metric`` (ties by id); a bounded top-k.

    Builds the stated intent: ``bigger_is_better`` keeps the largest values.
    """
    m = clean_metric(metric)
    order = m.desc_nulls_last() if bigger_is_better else m.asc_nulls_last()
    return df.orderBy(order, F.col(id_col)).limit(int(n))


def top_texts_per_group(df: DataFrame, group_col: str, metric: str, n: int, bigger_is_better: bool = True,
                        id_col: str = "doc_id", name: str = "rank", salts: int = 32) -> DataFrame:
    """W3/K1 per group: ``row_number() over (partition by group order by metric)``.

    Salted two-level top-n: rows are first ranked inside ``(group, salt)``
    sub-groups (a hot group is spread over ``salts`` tasks), only each
    sub-group's top n survive, and the final window sees at most
    ``salts * n`` rows per group.
    """
    from pyspark.sql import Window

    m = clean_metric(metric)
    order = [m.desc_nulls_last() if bigger_is_better else m.asc_nulls_last(), F.col(id_col)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    pre = salted.withColumn("_lr", F.row_number().over(Window.partitionBy(group_col, "_salt").orderBy(*order)))
    pre = pre.where(F.col("_lr") <= n).drop("_lr", "_salt")
    w = Window.partitionBy(group_col).orderBy(*order)
    return pre.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def remove_observations(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids`` (a null id stays)."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def fill_missing(df: DataFrame, columns: list[str], value: float = 0) -> DataFrame:
    """Missing values of the named columns replaced by ``value``."""
    return df.na.fill(value, columns)
