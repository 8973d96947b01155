"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source the keys are cut into ranges of bounded
size; sums of the ranges and running sums inside each give every document's place in the source's
random order without a task that holds a whole source. The budget cuts that order exactly: words
before the cut are taken once more than words after it.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import cut, documents, hash52, word_count

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def source_targets(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_rank, n_rows, source_size, target.

    Targets are in proportion to the weights but never above cap x the source's size; what the cap
    cuts off goes to the others by weight. With sources in ascending order of cap / weight the level
    is found by running sums: the first source whose cap is above the level ends the capped ones.
    """
    per = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = per.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", (F.col("source_size") * cap).cast("double"))
    before = W.orderBy(F.col("ceiling") / F.col("weight"), "source_rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    open_level = F.min(F.when(F.col("ceiling") >= F.col("level") * F.col("weight"), F.struct(F.col("ceiling") / F.col("weight"), "source_rank", "level"))).over(everything)
    target = F.least(F.col("ceiling"), F.coalesce(open_level["level"] * F.col("weight"), F.col("ceiling")))
    return levels.select("source", "source_rank", "n_rows", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, rows_per_range: int = 5_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and the columns of carry as the struct row).

    taken: words of the document that the mix takes, repeats counted. Their sum in each source is the
    whole part of its target. Null or empty text has size 0 and is taken 0 times; null sources are one
    source, the last; repeated rows are documents of their own (which of two equal rows comes first can't
    be told); an empty table gives no rows. Other columns of docs, whatever their names, are ignored.
    """
    keyed = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), hash52(F.lit(seed), F.col("doc_id"), F.col("text")).alias("mix_key"), F.spark_partition_id().alias("mix_origin"),
        *([F.struct(*(F.col(c) for c in carry)).alias("row")] if carry else []),
    )
    if not carry:
        keyed = cut(keyed)
    targets = cut(source_targets(keyed.select("source", "size"), weights, share, cap))
    n_ranges = F.ceil(F.col("n_rows") / rows_per_range)
    placed = keyed.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("mix_range", F.floor(F.col("mix_key") * n_ranges / float(1 << 52)))
    # Rows repeated more often than a range may hold stand at its end, parted by where they came from.
    hot = placed.groupBy("source_rank", "mix_key").count().where(F.col("count") > rows_per_range).select(F.col("source_rank").alias("hot_rank"), F.col("mix_key").alias("hot_key"))
    placed = placed.join(hot, (F.col("source_rank") == F.col("hot_rank")) & (F.col("mix_key") == F.col("hot_key")), "left")
    placed = placed.withColumn("hot_key", F.coalesce("hot_key", F.lit(-1))).withColumn("mix_origin", F.when(F.col("hot_key") < 0, 0).otherwise(F.col("mix_origin")))
    parts = ("mix_range", "hot_key", "mix_origin")
    sums = placed.select("source_rank", *parts, "size").groupBy("source_rank", *parts).agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("source_rank").orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"), *(F.col(c).alias(f"at_{c}") for c in ("source_rank", *parts)))
    inside = W.partitionBy("source_rank", *parts).orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    same = [F.col(c) == F.col(f"at_{c}") for c in ("source_rank", *parts)]
    placed = placed.join(starts, functools.reduce(operator.and_, same))
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("mix_start")))
    return placed.withColumn("mix_start", start).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def take_words(docs: DataFrame, **rules) -> DataFrame:
    """The mixed corpus, with the columns of docs: whole copies, and at each source's cut the words before it.

    A document taken for one and a half times its words comes twice, the second time up to the cut. Null,
    empty and wordless texts have no words to take and don't come; repeated rows are documents of their
    own; columns keep their names, whatever they are; empty tables give no rows.
    """
    mixed = mix_sources(docs, carry=tuple(docs.columns), **rules)
    whole = F.expr("CASE WHEN size > 0 THEN CAST(taken div size AS INT) ELSE 0 END")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("words", F.explode(copies))
    pieces = F.regexp_extract_all(F.col("row")["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("words") < 0, F.col("row")["text"]).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest("words", F.lit(0))), ""))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("words") < 0, F.col("row")["n_chars"]).otherwise(F.length(text).cast("long"))
    return rows.select(*(out[c].alias(c) for c in docs.columns))


def op8_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH keyed AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 13) AS k FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank FROM per),
weighed AS (SELECT *, CASE source_rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (source_size * 2)::DOUBLE AS ceiling FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(ceiling) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY ceiling / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT level AS lv FROM levels WHERE ceiling >= level * weight ORDER BY ceiling / weight, source_rank LIMIT 1),
targets AS (SELECT source, source_size, least(ceiling, coalesce((SELECT lv FROM found) * weight, ceiling)) AS target FROM levels),
placed AS (
  SELECT k.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mix_start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
cuts AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - mix_start)) AS BIGINT) AS taken
FROM cuts
"""
