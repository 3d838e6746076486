"""Session and scratch-space helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins at run time: it turns a
# shuffled join into a broadcast only when the measured side is small, and it
# splits skewed join partitions (a hot text, author or conversation).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of tables that nobody refers to any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # streaming state (running text counts, id de-duplication) lives in
    # RocksDB on local disk rather than on the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "threadmill",
              extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("THREADMILL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset in a local session (tests) a private folder is
    created; a cluster without it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="threadmill-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)  # private to this process
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage of an intermediate that several later steps read: a
    reliable checkpoint into the shared checkpoint folder (survives the loss
    of the executors that computed it; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """A wide intermediate that several later steps read, as a compressed table in the shared
    checkpoint folder: a fraction of the bytes of a checkpoint. It stays until the user clears the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    # Spark drops the shuffle files of finished jobs when the driver collects its garbage (by itself every half hour)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-heavy work on a small table (AQE would
    coalesce a small shuffle into one task): the configured shuffle
    partitions, at least the cluster's default parallelism."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = 0
    return max(n, spark.sparkContext.defaultParallelism)


BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df, rows: int = BROADCAST_ROWS):
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which is
    checked; otherwise as it is, and Spark joins it by a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
