"""A persistent embedding store.

Vectors are keyed by ``(id, xxhash64(text), model)``.  Known keys are read
from the store; only the missing documents (a left-anti join, J6) are
embedded, appended to the store (parquet, append mode) and unioned with
the stored ones (U1).  The store lives on a shared file system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read_store(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def embedding_cache(docs: DataFrame, store_path: str, embed: Callable[[DataFrame], DataFrame], model: str,
                    id_col: str = "doc_id", text_col: str = "text", vec_col: str = "vector") -> DataFrame:
    """Return ``(id, vector)`` for every document, embedding only those whose
    key is not in the store yet.  ``embed`` maps ``(id, text)`` rows to
    ``(id, text, vector)`` rows."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                        F.lit(model).alias("model"))
    store = _read_store(spark, store_path)
    key = ["id", "text_hash", "model"]
    missing = keyed if store is None else keyed.join(store.select(*key), key, "left_anti")
    fresh = embed(missing.select(F.col("id").alias(id_col), F.col("text").alias(text_col)))
    fresh = fresh.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"),
                         F.col(text_col).alias("text"))
    fresh = fresh.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lit(model).alias("model"),
                         "vector")
    fresh.write.mode("append").parquet(store_path)
    stored = spark.read.parquet(store_path)
    return keyed.join(stored, key, "inner").select(F.col("id").alias(id_col), F.col("vector").alias(vec_col))
