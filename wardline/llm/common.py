"""What the corpus operators share: the shared folder, saved tables and small column rules."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.shared import cut, give_back, leaner, shared_dir

__all__ = ["WORD", "as_int", "cut", "documents", "embeddings", "forget_caches", "free_name", "give_back", "hash52", "leaner", "let_go", "saved", "shared_dir", "word_count", "worker_cache"]

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there and lost executors only read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: dict = {}


def worker_cache(name, make):
    """What a Python worker keeps from task to task: one thing at a time, so that stages don't add up their memory."""
    if name not in _caches:
        forget_caches()
        _caches[name] = make()
    return _caches[name]


def forget_caches() -> None:
    """For tasks that need none: what earlier stages left in this Python worker goes."""
    _caches.clear()
    give_back()


def let_go(spark: SparkSession) -> None:
    """What is no longer in use goes now: the driver's memory, and the shuffle files, broadcasts and checkpoints that Spark removes once their handles are collected."""
    gc.collect()
    spark.range(1).count()  # until another job has run, Spark holds the last one's plan, and with it its shuffles
    give_back()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash52(*cols: Column) -> Column:
    """A number below 2^52 from the md5 of the columns' text, the same in any engine and exact as a double."""
    joined = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_int(row, name: str) -> int:
    """A count or sum of a one-row frame, 0 for an empty table."""
    return int(row[name] or 0)
