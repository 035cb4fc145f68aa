"""Scans and sinks.

Results leave the engine through ``DataFrame.write``; the only operator that
writes on its own is the embedding store (``tessera.sources.cache``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet table ``<base_dir>/<name>.parquet`` (filters and projections
    are pushed into the scan by Catalyst)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A header CSV whose texts may hold newlines and quotes.

    With ``schema`` the read is typed up front (preferred at scale); without
    it types are inferred (one extra pass over the file).
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("quote", '"')
        .option("mode", "PERMISSIVE")
    )
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(metric candidates = numeric columns, text candidates = the rest)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    other = [f.name for f in df.schema.fields if f.name not in numeric]
    return numeric, other


def parse_vector_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """List-as-text (``"[0.1, -2e-3, ...]"``) to ``ARRAY<DOUBLE>``;
    real arrays pass through (cast to double).  No code evaluation."""
    out = out or col
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType):
        return df.withColumn(out, F.col(col).cast("array<double>"))
    if isinstance(dtype, T.StringType):
        return df.withColumn(out, F.from_json(F.trim(F.col(col)), "array<double>"))
    raise TypeError(f"column {col!r} is {dtype.simpleString()}, expected a string or an array")


def load_word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None,
                      has_header: bool = True) -> DataFrame:
    """A text word-vector file (``word v1 v2 ...`` per line, optional
    ``count dim`` header) as ``(word, vector ARRAY<DOUBLE>)``.

    With ``vocabulary`` (a ``term``/``word`` column) only the needed words are
    kept, by a left-semi join instead of a per-word membership scan.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("_p"))
    if has_header:
        lines = lines.where(F.size("_p") > 2)
    wv = lines.select(
        F.element_at("_p", 1).alias("word"),
        F.transform(F.slice("_p", 2, F.size("_p") - 1), lambda x: x.cast("double")).alias("vector"),
    )
    if vocabulary is not None:
        vcol = "word" if "word" in vocabulary.columns else "term"
        wv = wv.join(vocabulary.select(F.col(vcol).alias("word")), "word", "left_semi")
    return wv
