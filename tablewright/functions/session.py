"""Session helpers: where shared intermediate files may be written."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# A small side is broadcast only when its row count is checked against this.
BROADCAST_ROWS = 10_000
# About how many bytes a batch for a Python worker has; one longer row is a batch of its own.
WORKER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WORKER_BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only for a local session."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tablewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of finished jobs; it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table computed once and broadcast if it has at most `limit` rows, else as it is."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bound_batches(spark: SparkSession) -> None:
    """Ends batches for Python workers by bytes too, not by 10,000 rows alone, however long these are; a bound that the
    session already has stays. Spark reads the bound when a query runs, so it is kept for the session."""
    if spark.conf.get(WORKER_BATCH, None) is None:
        spark.conf.set(WORKER_BATCH, str(WORKER_BATCH_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Enough partitions to keep every core busy in an iterative fit; a large table is left alone."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, where it isn't installed on them; functions in Python need it there."""
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tablewright-")) / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
