"""What the operators share: Arrow map stages, and where shared files go."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sonarlake import ship
from sonarlake.shared import checkpointed, shared_dir, small_batches

__all__ = ["KEPT", "SLICE", "checkpointed", "enter_stage", "fresh_dir", "map_slices", "shared_dir", "small_batches"]

#: Rows of a batch that a Python stage works on at once.
SLICE = 256
#: What empties the caches that modules keep in a worker from task to task.
KEPT: list[Callable[[], None]] = []
_stage: int | None = None


def enter_stage() -> None:
    """Has a Python worker give back what it holds of earlier stages: caches, and memory that is free but not yet the machine's.

    Workers live on from stage to stage, beside the executor's heap, so what each operator leaves in them adds up.
    """
    global _stage
    task = TaskContext.get()
    if task is None or task.stageId() == _stage:
        return
    _stage = task.stageId()
    for empty in KEPT:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def map_slices(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose batches are cut to at most SLICE rows, so that long texts don't pile up."""

    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def sliced(batches):
        enter_stage()

        def cut():
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    yield b.slice(at, SLICE)

        yield from work(cut())

    return df.mapInArrow(sliced, schema)
