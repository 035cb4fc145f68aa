"""Session helpers.

``shared_dir`` returns the folder used to cut lineage (``checkpoint()``) and
to keep persisted stage outputs.  On a cluster that is the shared folder
named by ``spark.checkpoint.dir``; only a local-mode session without it
gets a private scratch folder (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local-mode session tuned for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the session's ``spark.checkpoint.dir`` if set.

    A local-mode session without the setting gets a fresh scratch folder
    (never on a cluster: there it must be a shared file system).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{_CHECKPOINT_KEY} is not set; point it to a shared folder (HDFS/S3/...) "
                "so lineage can be cut reliably"
            )
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def reliable_checkpoint(df):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and read it back: lineage is cut, the data survives executor loss, and
    the input is computed once (``Dataset.checkpoint`` would compute it a
    second time to write it).  What was shuffled to make it is deleted with it made."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    out = spark.read.parquet(path)
    out._tessera_table = path
    return out


def release(df) -> None:
    """Deletes a table that ``reliable_checkpoint`` wrote, when nothing is going to read it any more."""
    path = getattr(df, "_tessera_table", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df):
    """Spread CPU-heavy per-row work (tokenising, vector maths) over the cores
    when the scan yields fewer partitions than the cluster has slots (e.g. a
    single-row-group file).  Large inputs already have many splits and are
    left untouched, so no shuffle is added at scale."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the plan as is
        return df
    if parts < slots:
        return df.repartition(slots)
    return df
