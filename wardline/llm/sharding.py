"""Sharding by sampled splitters, with DataFrame operations only.

Law `bytes`: records are ordered by a hash of their text, then of their id, so equal texts lie next to
each other; the order is cut into shards of equal bytes. A size-weighted sample of keys gives quantile
boundaries; they part the order into ranges, and ranges that turn out overfull (one text with very many
copies) are subdivided. Exact sizes of the ranges, and running sums inside each, give every record's
place, so no task holds more than a range and shard sizes differ by less than one record.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import as_int, cut, documents, hash52

SHARDS = 8


def splitters(keyed: DataFrame, total: int, n_ranges: int, per_range: int = 64) -> list[float]:
    """Quantiles of a size-weighted key sample; a key that fills more than one quantile gets a range of its own."""
    share = F.least(F.lit(1.0), F.col("size") * F.lit(n_ranges * per_range / max(total, 1)))
    drawn = keyed.where(hash52(F.lit("draw"), F.col("doc_id"), F.col("shard_key")) / float(1 << 52) < share)
    at = [i / n_ranges for i in range(1, n_ranges)]
    found = drawn.agg(F.percentile_approx("shard_key", at, max(10_000, 20 * n_ranges)).alias("q")).first()["q"] or []
    bounds = set(found) | {x + 1 for x, y in zip(found, found[1:], strict=False) if x == y}
    return [float("-inf"), *sorted(map(float, bounds)), float("inf")]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, range_bytes: int = 64 << 20, most_ranges: int = 16_384) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in its shard).

    Null text counts as empty. Equal texts lie together unless a shard's end falls among them. Repeated
    rows are records of their own (which of two equal rows comes first can't be told). Empty tables give
    no rows; other columns of docs are ignored. The boundaries number at most most_ranges, a bound on what
    the driver holds; larger ranges are subdivided like overfull ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hash52(text).alias("shard_key"), hash52(F.col("doc_id")).alias("copy_key"))
    keyed = cut(keyed)
    total = as_int(keyed.agg(F.sum("size").alias("t")).first(), "t")
    n_ranges = min(max(4 * shards, -(-total // range_bytes)), most_ranges)
    bounds = splitters(keyed, total, n_ranges)
    keyed = keyed.withColumn("as_double", F.col("shard_key").cast("double"))
    keyed = (Bucketizer(splits=bounds, inputCol="as_double", outputCol="coarse").transform(keyed) if len(bounds) > 2 else keyed.withColumn("coarse", F.lit(0.0))).withColumn("coarse", F.col("coarse").cast("int"))
    # Overfull ranges are subdivided by key, or by copy where they hold one key only.
    fullness = keyed.groupBy("coarse").agg(F.sum("size").alias("full"), F.count(F.lit(1)).alias("n"), F.min("shard_key").alias("low"), F.max("shard_key").alias("high"))
    pieces = F.ceil(F.greatest(F.col("full") / (2.0 * max(total / n_ranges, 1)), F.col("n") / 200_000.0))
    cuts = fullness.select(F.col("coarse").alias("c"), pieces.alias("pieces"), "low", "high")
    one = F.col("low") == F.col("high")
    fine = F.when(one, F.floor(F.col("copy_key") / float(1 << 52) * F.col("pieces"))).otherwise(F.floor((F.col("shard_key") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("pieces")))
    keyed = keyed.join(cuts, F.col("coarse") == F.col("c")).withColumn("fine", F.coalesce(fine, F.lit(0)).cast("long"))
    ranges = keyed.groupBy("coarse", "fine").agg(F.sum("size").alias("range_size"))
    before = W.orderBy("coarse", "fine").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(F.col("coarse").alias("rc"), F.col("fine").alias("rf"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("coarse", "fine").orderBy("shard_key", "copy_key", "doc_id", "size")
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(starts, (F.col("coarse") == F.col("rc")) & (F.col("fine") == F.col("rf"))).withColumn("place", start)
    placed = placed.withColumn("shard", F.expr(f"CAST(least({shards - 1}, (place * {shards}) div {max(total, 1)}) AS INT)"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard_key", "copy_key", "coarse", "fine", "shard"))
    parts = placed.groupBy("shard", "coarse", "fine").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("coarse", "fine").rowsBetween(W.unboundedPreceding, -1)
    firsts = parts.select(F.col("shard").alias("s"), F.col("coarse").alias("rc"), F.col("fine").alias("rf"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    at = F.row_number().over(W.partitionBy("shard", "coarse", "fine").orderBy("shard_key", "copy_key", "doc_id", "size")) - 1
    joined = placed.join(firsts, (F.col("shard") == F.col("s")) & (F.col("coarse") == F.col("rc")) & (F.col("fine") == F.col("rf")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + at).cast("long").alias("slot"))


def op2_shard_documents(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
