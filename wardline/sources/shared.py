"""The folder that driver and executors share, and tasks that keep no memory."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where it names none and driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"/tmp/wardline-checkpoints-{uuid.uuid4().hex}")
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved_parts(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of its own in the shared folder, and read back from it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this Python worker has freed goes back to the machine, else idle workers hold the most they ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def leaner(task):
    """A task over batches, or over one group, that gives memory back when it ends."""
    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def over_batches(batches):
            yield from task(batches)
            give_back()

        return over_batches

    @functools.wraps(task)
    def over_group(group):
        try:
            return task(group)
        finally:
            give_back()

    return over_group
