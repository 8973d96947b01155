"""Metrics, curves and thresholds; grids run over counts by threshold bucket, never over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.cleaning import running_sums
from wardline.sources.shared import cut


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def from_counts(df: DataFrame) -> DataFrame:
    """df (tn, fp, fn, tp) with the usual rates to four places; a rate without cases is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return df.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "detection_rate": ratio(tp, tp + fn),
    })


def confusion(df: DataFrame, predicted: Column, label: str = "label", by=()) -> DataFrame:
    yes, true = F.coalesce(predicted, F.lit(False)), F.col(label) == 1
    return df.groupBy(*by).agg(F.count_if(~yes & ~true).alias("tn"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(yes & true).alias("tp"))


def metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, by=()) -> DataFrame:
    return from_counts(confusion(df, F.col(score) >= threshold, label, by))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def curve(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """One row per distinct score with the counts at and above it; summed over ranges of scores."""
    out = running_sums(score_histogram(df, label, score, by), F.desc("score"), ["pos", "neg"], by)
    return out.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "all_pos", "neg_all": "all_neg"})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    out = curve(df, label, score, by).groupBy(*by).agg(area.alias("a"), F.first("all_pos").alias("p"), F.first("all_neg").alias("n"))
    return out.select(*by, F.round(F.try_divide(F.col("a"), (F.col("p") * F.col("n")).cast("double")), 6).alias("roc_auc"))


def pr_areas(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """pr_auc by trapezoids from the point (recall 0, precision 1), and average precision by steps."""
    points = curve(df, label, score, by).where("all_pos > 0").withColumns({"tp0": F.col("tp") - F.col("pos"), "fp0": F.col("fp") - F.col("neg")})
    precision = lambda t, f: F.coalesce(F.try_divide(F.col(t), F.col(t) + F.col(f)), F.lit(1.0))
    steps = points.select(*by, precision("tp", "fp").alias("p"), precision("tp0", "fp0").alias("p0"), (F.col("tp") / F.col("all_pos")).alias("r"), (F.col("tp0") / F.col("all_pos")).alias("r0"))
    gain = F.col("r") - F.col("r0")
    return steps.groupBy(*by).agg(F.round(F.sum(gain * (F.col("p") + F.col("p0")) / 2), 6).alias("pr_auc"), F.round(F.sum(gain * F.col("p")), 6).alias("average_precision"))


def compare_models(df: DataFrame, scores: list[str], label: str = "label", threshold: float = 0.5) -> DataFrame:
    """The metrics of several score columns, one row each."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores))).alias("x")).select(label, "x.*")
    return metrics(long, label, "score", threshold, ["model"]).join(roc_auc(long, label, "score", ["model"]), "model")


def bucket_of(score: Column, limits: list[float]) -> Column:
    """How many of the ascending limits a score reaches: a binary search as a tree of comparisons. Null for null."""
    value = score.cast("double")

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= limits[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return F.when(value.isNotNull(), tree(0, len(limits)))


def suffix_counts(df: DataFrame, limits: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """limit, tp, fp, all_pos, all_neg: per limit what reaches it. No rows from an empty table.

    Rows are counted by bucket, map side first, and the buckets, one more than limits, summed from above;
    nothing grows with rows or distinct scores times limits. Null scores count nowhere.
    """
    limits = sorted({float(x) for x in limits})
    counts = df.where(F.col(score).isNotNull()).groupBy(bucket_of(F.col(score), limits).alias("bucket")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), F.lit(True).alias("found"))
    places = df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(limits)] + [(0, None)], "bucket int, limit double")
    held = places.join(counts, "bucket", "left").fillna(0, ["pos", "neg"])
    every, above = W.partitionBy(), W.partitionBy().orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0)  # over one row a limit
    sums = {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "all_pos": F.sum("pos").over(every), "all_neg": F.sum("neg").over(every), "any": F.max("found").over(every)}
    return held.select("bucket", "limit", *(v.alias(c) for c, v in sums.items())).where("any AND bucket > 0").drop("bucket", "any")


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", low: int = 10, high: int = 90, unit: float = 0.01) -> DataFrame:
    """Metrics at each threshold from low to high units."""
    at = suffix_counts(df, [round(k * unit, 6) for k in range(low, high + 1)], label, score)
    return from_counts(at.select(F.col("limit").alias("threshold"), (F.col("all_neg") - F.col("fp")).alias("tn"), "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), "tp"))


def best_threshold(sweep: DataFrame, by: str = "f1") -> DataFrame:
    """The first threshold with the best value."""
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct(F.col(by), -F.col("threshold"))).alias("b"))
    return best.select("b.*")


def threshold_grid(df: DataFrame, safe: list, phish: list, positive_from: str = "phishing", label: str = "label", score: str = "score") -> DataFrame:
    """Metrics of each pair (safe_max, phish_min), safe_max below phish_min, over whole-number scores or probabilities.

    positive_from 'suspicious' counts everything from safe_max as positive, 'phishing' from phish_min.
    """
    out = limit_pairs(df, [(x, y) for x in safe for y in phish if x < y], label, score)
    side = "s" if positive_from == "suspicious" else "p"
    tp, fp = F.col(f"{side}_tp"), F.col(f"{side}_fp")
    seen = (F.col("s_tp") + F.col("s_fp") - F.col("p_tp") - F.col("p_fp")).alias("suspicious")
    return from_counts(out.select("safe_max", "phish_min", (F.col("all_neg") - fp).alias("tn"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"), tp.alias("tp"), seen))


def limit_pairs(df: DataFrame, pairs: list[tuple[float, float]], label: str, score: str) -> DataFrame:
    """safe_max, phish_min, and the suffix counts at each (s_tp, s_fp, p_tp, p_fp, all_pos, all_neg); pairs twice in the list count once."""
    at = cut(suffix_counts(df, [x for pair in pairs for x in pair], label, score))
    cells = df.sparkSession.createDataFrame(sorted({(float(a), float(b)) for a, b in pairs}), "safe_max double, phish_min double")
    first = at.select(F.col("limit").alias("safe_max"), F.col("tp").alias("s_tp"), F.col("fp").alias("s_fp"), "all_pos", "all_neg")
    return cells.join(F.broadcast(first), "safe_max").join(F.broadcast(at.select(F.col("limit").alias("phish_min"), F.col("tp").alias("p_tp"), F.col("fp").alias("p_fp"))), "phish_min")


def best_cell(grid: DataFrame, by: str = "f1") -> DataFrame:
    """The best cell; ties go to the smaller safe_max, then phish_min."""
    return grid.agg(F.max_by(F.struct(*grid.columns), F.struct(F.col(by), -F.col("safe_max"), -F.col("phish_min"))).alias("b")).select("b.*")


def threshold_sensitivity(df: DataFrame, configs: list[tuple[float, float]], label: str = "label", score: str = "score") -> DataFrame:
    """For each pair of limits and class: how many are safe, suspicious, phishing; a suspicious negative counts as false positive."""
    cells, out = limit_pairs(df, configs, label, score), []
    for name, total, side in (("positive", "all_pos", "tp"), ("negative", "all_neg", "fp")):
        safe, phishing = F.col(total) - F.col(f"s_{side}"), F.col(f"p_{side}")
        part = cells.select("safe_max", "phish_min", safe.alias("safe"), F.greatest(F.col(f"s_{side}") - phishing, F.lit(0)).alias("suspicious"), phishing.alias("phishing"))
        out.append(part.withColumn("population", F.lit(name)).withColumn("flagged_share", ratio(F.col("suspicious") + F.col("phishing"), F.col("safe") + F.col("suspicious") + F.col("phishing"))))
    return reduce(DataFrame.unionByName, out)


def metric_deltas(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Old, new and difference of each metric of two one-row tables; and by how many percent of the old it fell."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in columns))).alias("x")).select("x.*")
    both = long(a, "old").join(long(b, "new"), "metric")
    return both.withColumn("delta", F.round(F.col("new") - F.col("old"), 4)).withColumn("reduction_pct", F.round(F.coalesce(F.try_divide(F.col("old") - F.col("new"), F.col("old")), F.lit(0.0)) * 100, 4))


def hard_negative_fpr(df: DataFrame, score: str, threshold: float, flag: str = "is_hard_negative") -> DataFrame:
    return df.where(F.col(flag)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("flagged")).withColumn("fpr", ratio(F.col("flagged"), F.col("n")))


def false_positives(df: DataFrame, old: str, new: str, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Negatives that either version flags, with both scores and which version it was."""
    a, b = F.col(old) >= threshold, F.col(new) >= threshold
    which = F.when(a & b, "both").when(a, "old_only").when(b, "new_only")
    return df.where((F.col(label) == 0) & (a | b)).withColumn("flagged_by", which)


def score_agreement(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(old, new), 6).alias("correlation"), F.round(F.avg((F.col(new) > F.col(old)).cast("double")), 6).alias("new_higher"), F.round(F.avg(old), 6).alias("mean_old"), F.round(F.avg(new), 6).alias("mean_new"))


def set_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in a, in b and in both."""
    seen = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return seen.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
