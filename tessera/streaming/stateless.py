"""Fitted operators on streams.

The reference has no streaming.  Four of its fitted-model operators are
stateless row maps with small fitted tables and apply unchanged to a
streaming DataFrame: projection of dense vectors (D9, ``PcaModel.transform``),
cluster assignment (C5, ``assign_nearest``), regression prediction (R8,
``predict_ols``) and the TF-IDF transform with its norm (E2,
``tfidf_transform_rows``: counts, weights and norm inside the document's row).
No watermark or state store is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apply_fitted(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a fitted, stateless transform to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    return transform(stream)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str):
    """Drive a streaming query to completion into a memory table (tests,
    small demos); returns the stopped query."""
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
