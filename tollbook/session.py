"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes and splits hot join
# partitions; forceOptimizeSkewedJoin lets it do so even where the join output
# partitioning would have been reused afterwards.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Python is sent at most 8 MB of rows (or one row) at once (64 MB by default): a worker's memory does not grow with the table
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is named a temporary folder is taken,
    but only by a local master: executors elsewhere could not see it."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tollbook-", dir="/tmp")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder."""
    return f"{shared_folder(spark)}/tollbook-{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, for frames that a plan uses more than once."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
