"""Exact dedup with stateful streaming, in DataFrame operations only.

Arrivals (digest, stable identifier, content locator) are written as a table in the shared folder and streamed into a
keyed aggregate.  Its state lies on disk (RocksDB) and never expires: per digest, the largest identifier with its
locator, and how many rows arrived.  Later arrivals go on from the same state (``advance``).  The state is then read back
as a table.

A digest alone doesn't decide: for every digest that was hit (more than one arrival) the full bytes are grouped, and
digests under which texts differ are resolved by their texts.  Equal texts are counted in each task before the shuffle,
and the joins on the digest are plain sort-merge joins that AQE can split, so a group with a third of all rows is no
single task's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrange, lower_az
from tessera.session import reliable_checkpoint, shared_dir

ARRIVAL = "id {kind}, row_file string, row_no long, digest string, text_sha256 string"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store for each partition: don't set disk aside for its logs
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def advance(spark: SparkSession, arrivals: str, kind: str, state: str) -> DataFrame:
    """Streams what is new in the folder ``arrivals`` into the state kept in the folder ``state`` and returns the state:
    digest, keep (id, row_file, row_no) and group_size."""
    own = spark.newSession()
    for k, v in {**STATE_CONF, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(ARRIVAL.format(kind=kind)).parquet(arrivals)
    keyed = stream.groupBy("digest").agg(F.max(F.struct("id", "row_file", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    query = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = own.read.format("statestore").load(state)
    keep, size = kept.schema["value"].dataType.names
    reliable = kept.select("key.digest", F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{size}`").alias("group_size"))
    path = f"{shared_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    reliable.write.parquet(path)
    return spark.read.parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row_file``, ``row_no``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    The row with the largest id stays (a null id is smaller than any other); of rows that also share the id, one stays:
    that with the largest place.  An empty table gives an empty result.  Other columns are not read.  ``digest`` may be
    any function of the text: results stay exact if it collides."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = arrange(docs, {id_col: "id", text_col: "text"}, text=None).drop("block")
    rows = rows.withColumn("text", lower_az(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.withColumn("digest", digest(F.col("text")))
    whole = F.col("digest") if digest is sha256 else sha256(F.col("text"))

    base = f"{shared_dir(spark).rstrip('/')}/dedup-{uuid.uuid4().hex}"
    rows.select("id", "row_file", "row_no", "digest", whole.alias("text_sha256")).write.parquet(f"{base}/arrivals")
    arrivals = spark.read.schema(ARRIVAL.format(kind=kind)).parquet(f"{base}/arrivals")
    state = advance(spark, f"{base}/arrivals", kind, f"{base}/state")

    hits = state.where("group_size > 1").select("digest", "group_size")
    same = rows.join(hits, "digest").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("group_size").alias("group_size"))
    differ = reliable_checkpoint(same.where("n <> group_size").select(digest(F.col("text")).alias("digest")).distinct())

    own = ["id", "row_file", "row_no", "text_sha256"]
    keep = [F.col("keep.id").alias("keep_id"), "group_size", F.struct("row_file", "row_no") == F.struct("keep.row_file", "keep.row_no")]
    if differ.isEmpty():
        decided = arrivals.join(state, "digest").select(*own, *keep[:2], keep[2].alias("kept"))
    else:  # texts differ under one digest: those digests are decided by text
        sure = arrivals.join(state.join(differ, "digest", "left_anti"), "digest").select(*own, *keep[:2], keep[2].alias("kept"))
        open_rows = rows.withColumn("text_sha256", whole).join(differ, "digest", "left_semi")
        by_text = open_rows.groupBy("text").agg(F.max(F.struct("id", "row_file", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        decided = sure.unionByName(open_rows.join(by_text, "text").select(*own, *keep[:2], keep[2].alias("kept")))
    return decided.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", "row_file", "row_no")
