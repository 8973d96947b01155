"""Splits that keep groups together, and checks for leakage between them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.cleaning import with_places

SPLITS = ("train", "validation", "test")


def group_summary(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """group, samples, positives and the majority label (1 only above half)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col(label)).cast("long").alias("positives")).withColumn("majority", (F.col("positives") > F.col("samples") / 2).cast("int"))


def split_by_rank(rank: Column, n: Column, ratios: dict[str, float], whole=F.round) -> Column:
    """The split of place rank (from 1) of n: shares in order, made whole numbers, the last takes what is left."""
    *names, last = ratios
    out, upto = F.when(F.lit(False), ""), F.lit(0)
    for name in names:
        upto = upto + whole(n * F.lit(float(ratios[name])))
        out = out.when(rank <= upto, name)
    return out.otherwise(last)


def domain_split(df: DataFrame, ratios=None, group: str = "registered_domain", label: str | None = None, seed: int = 42, whole=F.round) -> DataFrame:
    """df with `split`: whole groups in hash order, in the given shares of groups; within each majority label if label is given.

    The order depends on group and seed alone. Ranking is over groups, in 256 hash ranges whose counts
    are added up, so no task sorts all of them.
    """
    ratios = ratios or {"train": 0.72, "validation": 0.13, "test": 0.15}
    groups = group_summary(df, group, label).select(group, F.col("majority").alias("_stratum")) if label else df.select(group).distinct().withColumn("_stratum", F.lit(0))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit(""))))
    groups = groups.withColumn("_h", digest).withColumn("_range", F.substring(digest, 1, 2))
    counts = groups.groupBy("_stratum", "_range").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("_stratum").orderBy("_range")
    starts = counts.select(F.col("_stratum").alias("s"), F.col("_range").alias("r"), F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("_stratum")).alias("of"))
    ranked = groups.join(starts, (F.col("_stratum") == F.col("s")) & (F.col("_range") == F.col("r")))
    rank = F.col("start") + F.row_number().over(W.partitionBy("_stratum", "_range").orderBy("_h", group))
    placed = ranked.select(F.col(group).alias("_g"), split_by_rank(rank, F.col("of"), ratios, whole).alias("split"))
    return df.join(placed, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_holdout(df: DataFrame, key: str, label: str = "label", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows split by hash rank within each label."""
    return domain_split(df, {"train": 1 - share, "test": share}, key, label, seed)


def fixed_count_split(df: DataFrame, counts: dict[int, dict[str, int]], order_col: str, label: str = "label") -> DataFrame:
    """Splits of given sizes per class, by order; rows beyond the sizes have none. Places come from ranges of the order, so no task holds a class."""
    out = F.lit(None).cast("string")
    for cls, sizes in counts.items():
        at = 0
        for name, n in sizes.items():
            out = F.when((F.col(label) == cls) & (F.col("_place") > at) & (F.col("_place") <= at + n), name).otherwise(out)
            at += n
    return with_places(df, order_col, label, "_place").withColumn("split", out).drop("_place")


def assigned(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    """The rows that came with this split; names count without regard to case and blanks around them."""
    return df.where(F.lower(F.trim(split)) == name.lower())


def pool_split(df: DataFrame, key: str, ratios=(0.6, 0.2), names=("train", "validation", "evaluation"), seed: int = 42) -> DataFrame:
    """A pool in hash order cut at whole numbers of rows, rounded down; the rest goes to the last."""
    shares = {names[0]: ratios[0], names[1]: ratios[1], names[2]: 1 - sum(ratios)}
    return domain_split(df, shares, key, seed=seed, whole=F.floor)


def leakage_report(df: DataFrame, keys: list[str], split: str = "split", names=SPLITS) -> DataFrame:
    """For each key and pair of splits, how many values both have; one grouping per key."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("c"), split).select("c.*", split)
    seen = cells.where("value IS NOT NULL").groupBy("key", "value").agg(*(F.max((F.col(split) == s).cast("int")).alias(s) for s in names))
    pairs = seen.groupBy("key").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in combinations(names, 2)))
    return pairs.withColumn("total", sum((F.col(f"{a}_{b}") for a, b in combinations(names, 2)), F.lit(0)))


def label_validity(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Per split the labels that occur, and whether they are 0 and 1 only."""
    out = df.groupBy(split).agg(F.sort_array(F.collect_set(F.col(label).cast("string"))).alias("labels"), F.count_if(F.col(label).isNull()).alias("null_labels"))
    return out.withColumn("valid", (F.size(F.array_except("labels", F.array(F.lit("0"), F.lit("1")))) == 0) & (F.col("null_labels") == 0))


def leakage_verdict(report: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: contaminated, labels_valid, overall_pass."""
    a = report.agg((F.coalesce(F.sum("total"), F.lit(0)) > 0).alias("contaminated"))
    b = labels.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("labels_valid"))
    return a.crossJoin(b).withColumn("overall_pass", ~F.col("contaminated") & F.col("labels_valid"))


def pairing_violations(left: DataFrame, right: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Keys that break a one-to-one pairing: missing on a side, repeated, or with different labels."""
    side = lambda df, s: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{s}"), F.min(label).alias(f"{label}_{s}"))
    both = side(left, "left").join(side(right, "right"), key, "full_outer")
    problem = F.when(F.col("n_left").isNull(), "missing_left").when(F.col("n_right").isNull(), "missing_right").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").when(~F.col(f"{label}_left").eqNullSafe(F.col(f"{label}_right")), "label_differs")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def class_distribution(df: DataFrame, split: str = "split", label: str = "label", html: str | None = None) -> DataFrame:
    """Rows, positives and shares per split, and over all (split null)."""
    more = [F.round(F.avg(F.col(html).cast("double")), 4).alias("html_share")] if html else []
    return df.rollup(split).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"), F.round(F.avg(F.col(label).cast("double")), 4).alias("positive_share"), *more)
