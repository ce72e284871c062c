"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold for every session this library builds. Shuffle partition count is
# a local default only; on a cluster it comes from the cluster's own configuration.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "orbitcart", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only where
    it is unset on a local master (tests) a private folder under the system temp directory is
    created; elsewhere a machine's own folder would be out of the executors' reach.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="orbitcart-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table written under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def written_table(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to a new folder below the shared checkpoint folder and read it again.

    Cuts lineage like a checkpoint, and later joins are planned with the files' real sizes.
    """
    path = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of ended steps.

    Spark deletes them when the driver's JVM has collected the plans that made them, which an idle heap
    may put off for half an hour, while each later step adds its own files to the disks.
    """
    gc.collect()  # the Python side holds the plans too
    spark.sparkContext._jvm.System.gc()
