"""Global contiguous numbering (S3, W2) and category labels.

``add_row_number`` numbers rows 1..n in a total order without a
single-partition window: a range-partitioned sort, one count per partition,
and a broadcast table of partition offsets (one row per partition, so its
size is bounded by the partition count).  The sorted frame is checkpointed
in the shared folder first, so the count and the numbering read the same
partitions even if an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

_PID, _MID = "__part", "__mono"


def _as_cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def add_row_number(df: DataFrame, order_by: Sequence, name: str = "row_number", start: int = 1) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order_by`` (ties in any order)."""
    spark = df.sparkSession
    ordered = (
        df.orderBy(*_as_cols(order_by))
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    ordered = reliable_checkpoint(ordered)
    # One row per partition: the offsets table is as small as the partition count.
    counts = sorted(ordered.groupBy(_PID).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, running = [], 0
    for pid, n in counts:
        rows.append((pid, running))
        running += n
    offsets = spark.createDataFrame(rows or [(0, 0)], schema=f"{_PID} int, __off long")
    local_index = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (
        ordered.join(F.broadcast(offsets), _PID, "left")
        .withColumn(name, (F.col("__off") + local_index + F.lit(start)).cast("long"))
        .drop(_PID, _MID, "__off")
    )


def add_surrogate_key(df: DataFrame, order_by: Sequence | None = None, name: str = "observation_number") -> DataFrame:
    """S3: add a contiguous 1..n key when ``name`` is missing (kept if present).

    Row order of a table is undefined, so the caller names the ordering; by
    default all columns, which makes the numbering reproducible (rows that
    tie are identical).
    """
    if name in df.columns:
        return df
    cols = list(order_by) if order_by is not None else [c for c in df.columns]
    return add_row_number(df, cols, name=name, start=1)


MAX_LOCAL_LABELS = 100_000


def category_labels(df: DataFrame, col: str, name: str = "cluster") -> DataFrame:
    """Map each distinct value of ``col`` to its 0-based position in sorted order.

    Up to ``MAX_LOCAL_LABELS`` distinct values (checked) the label table is
    built from the sorted distinct values and broadcast; beyond that the
    labels come from a distributed global numbering and a shuffle join.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    few = values.limit(MAX_LOCAL_LABELS + 1).collect()
    if len(few) <= MAX_LOCAL_LABELS:
        spark = df.sparkSession
        ordered = sorted(r[0] for r in few)
        schema = f"`{col}` {df.schema[col].dataType.simpleString()}, `{name}` int"
        table = spark.createDataFrame([(v, i) for i, v in enumerate(ordered)], schema)
        return df.join(F.broadcast(table), col, "left")
    labelled = add_row_number(values, [col], name=name, start=0).withColumn(name, F.col(name).cast("int"))
    return df.join(labelled, col, "left")
