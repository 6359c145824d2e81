"""Checkpoints in the folder that all machines share, and sizes of batches."""

from __future__ import annotations

import gc
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where the session leaves Spark's own limit of 64 MB: buffers double as they grow and are copied on
#: both sides of the pipe, so a batch of texts takes several times its size outside the heap.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a folder of this machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="sonarlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has shuffle files deleted that no plan can read any more.

    Spark deletes them once the driver's memory manager finds their plans gone. Behind a checkpoint that is soon true, but a
    driver with memory to spare may not look for hours, while each step adds its files to the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Batches of texts at most BATCH_BYTES long, unless the session says otherwise."""
    if spark.conf.get(BATCH_KEY).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


#: Has Spark delete a query's shuffle files when it ends, whatever the driver's memory manager has found by then.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that are made and run inside leave no shuffle files: for results that are collected or checkpointed."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)
