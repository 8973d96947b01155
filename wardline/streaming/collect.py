"""Collecting a stream over many runs into a table that appears only when it is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.pull import hadoop_path


def collect_stream(stream: DataFrame, staging: str, final: str, checkpoint: str, complete: Callable[[DataFrame], bool] | None = None) -> bool:
    """Works off what the stream has now, and makes staging the final table once that is complete; true if it is.

    Each batch is written to a folder of its own number, over whatever a killed run left there, so that every row comes
    once however often runs are killed and started again with the same folders. `complete` judges all rows collected
    so far (None: the first run that ends completes the table, be it empty). The table comes by one rename, so a reader sees none of
    it or all; staging and final must lie in one file system whose renames are whole. Once it is there, nothing more is pulled.
    """
    spark = stream.sparkSession
    files, there = hadoop_path(spark, final)
    if files.exists(there):
        return True

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staging}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    _, here = hadoop_path(spark, staging)
    if not files.exists(here) or complete and not complete(spark.read.schema(stream.schema).parquet(staging)):
        return False
    files.mkdirs(there.getParent())
    if not files.rename(here, there):
        raise OSError(f"{staging} can't be renamed to {final}")
    return True


def read_collected(spark: SparkSession, final: str) -> DataFrame:
    """The final table, without its numbers of batches."""
    return spark.read.parquet(final).drop("batch")


def reached(label: str, targets: dict) -> Callable[[DataFrame], bool]:
    """For `complete`: every label has its target of rows."""

    def judged(rows: DataFrame) -> bool:
        counts = rows.where(F.col(label).isin(*targets)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        found = {r[0]: r[1] for r in counts.collect()}  # one row a target
        return all(found.get(k, 0) >= n for k, n in targets.items())

    return judged
