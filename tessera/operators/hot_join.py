"""Join of many rows with a keyed table, when a few keys hold most rows (J3, J4, sparse clustering).

* A table of at most ``broadcast_bytes`` (its rows' bytes are summed first, not guessed) is broadcast: no row moves.
* A larger one is joined by a shuffle.  Keys with more than ``1 / parts`` of all rows are hot: fewer than ``parts`` keys,
  found by one count per key with partial sums before the shuffle.  A hot key with a share ``s`` of the rows gets
  ``ceil(s * parts)`` salts; its rows are spread over them by a hash, and its table row is repeated once for each.  All salts
  together are fewer than ``2 * parts``, so the table grows by a bounded number of rows, and no task gets much more
  than ``1 / parts`` of the rows of any one key.  Keys that aren't hot are joined as they are.

Rows whose key is null match nothing; with ``how="left"`` they are spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20


def row_bytes(table: DataFrame) -> Column:
    """Bytes of a row of ``table``: strings and binaries by length, arrays of fixed-width values by size, 8 for the rest."""
    total = F.lit(16)
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = F.size(c) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("long")


def fits(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``table`` together are at most ``limit`` bytes."""
    found = table.agg(F.sum(row_bytes(table)).alias("b")).first()["b"]
    return (found or 0) <= limit


def hot_keys(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(``key``, ``_salts``) of the keys with more than ``1 / parts`` of all rows: fewer than ``parts`` rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    share = F.col("_n") * F.lit(int(parts))
    hot = counts.where(share > total).select(key, F.ceil(share / F.lit(max(total, 1))).cast("int").alias("_salts")).collect()
    schema = T.StructType([rows.schema[key], T.StructField("_salts", T.IntegerType())])
    return rows.sparkSession.createDataFrame(hot, schema)


def salt_rows(rows: DataFrame, hot: DataFrame, key: str, by: list[str], parts: int) -> DataFrame:
    """``rows`` with ``_salt``: 0, or one of a hot key's salts by the hash of ``by``."""
    marked = rows.join(F.broadcast(hot), key, "left")
    salts = F.when(F.col(key).isNull(), F.lit(int(parts))).otherwise(F.coalesce("_salts", F.lit(1)))
    return marked.withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")


def salt_table(table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``table`` with a row for every salt of a hot key."""
    marked = table.join(F.broadcast(hot), key, "left")
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def hot_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], how: str = "inner",
             broadcast_bytes: int = BROADCAST_BYTES, parts: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` (``how``: inner or left); ``by`` names columns that tell the rows of one key
    apart.  ``rows`` is read twice beyond ``broadcast_bytes``: pass a written table where it is costly."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if fits(table, broadcast_bytes):
        return rows.join(F.broadcast(table), key, how)
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_keys(rows, key, parts)
    return salt_rows(rows, hot, key, by, parts).join(salt_table(table, hot, key), [key, "_salt"], how).drop("_salt")
