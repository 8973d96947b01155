"""Profiles, value counts, outcome statistics, rankings and histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.cleaning import running_sums
from wardline.sources.shared import cut

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def real(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def exact_quantiles(df: DataFrame, columns: list[str], by=(), quantiles=QUANTILES) -> DataFrame:
    """by, column_name and p<percent> of each quantile, interpolated: values are counted, the counts summed over ranges of values, and the wanted places looked up."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), real(F.col(c).cast("double")).alias("value")) for c in columns))
    keys = [*by, "column_name"]
    counts = df.select(*by, F.inline(cells)).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(counts, F.col("value"), ["n"], keys)
    out = []
    for q in quantiles:
        at = (F.col("n_all") - 1) * q
        here = lambda k: F.max(F.when((F.col("n_upto") > k) & (F.col("n_upto") - F.col("n") <= k), F.col("value")))
        low, high, rest = here(F.floor(at)), here(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * rest).alias(f"p{round(q * 100)}"))
    return placed.groupBy(*keys).agg(*out)


def profile(df: DataFrame, columns: list[str], by=(), exact: bool = True) -> DataFrame:
    """n, mean, std, min, max, quantiles, nulls, NaNs and infinities of each column, one row each.

    exact=False takes approximate quantiles in the same pass over the rows, whose state is bounded.
    """
    cells = []
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    for c in columns:
        v = F.col(c).cast("double")
        r = real(v)
        about = [] if exact else [F.round(F.percentile_approx(r, q, 10_000).cast("double"), 6).alias(p) for p, q in zip(names, QUANTILES, strict=True)]
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.count(r).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_samp(r), 6).alias("std"), F.min(r).alias("least"), F.max(r).alias("largest"), *about,
            F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinities"),
        ))
    out = df.groupBy(*by).agg(F.array(*cells).alias("a")).select(*by, F.inline("a"))
    if not exact:
        return out
    found = exact_quantiles(df, columns, by)
    renamed = found.select(*(F.col(k).alias(f"_{k}") for k in (*by, "column_name")), *(F.round(p, 6).alias(p) for p in names))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*by, "column_name")))
    return out.join(renamed, same, "left").select(*by, "column_name", "n", "mean", "std", "least", "largest", *names, "nulls", "nans", "infinities")


def shares(df: DataFrame, column: str, limit: float, by=()) -> DataFrame:
    """Share above a limit and share of zeros."""
    v = F.col(column)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((v > limit).cast("double")), 6).alias("above"), F.round(F.avg((v == 0).cast("double")), 6).alias("zero"))


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    row = df.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.corr(c, target), 6).alias("correlation")) for c in columns)).alias("a"))
    return row.select(F.inline("a"))


def conditional_means(df: DataFrame, column: str, conditions: dict[str, Column]) -> DataFrame:
    row = df.agg(F.array(*(F.struct(F.lit(k).alias("condition"), F.count_if(c).alias("n"), F.round(F.avg(F.when(c, F.col(column))), 6).alias("mean")) for k, c in conditions.items())).alias("a"))
    return row.select(F.inline("a"))


def unusual_values(df: DataFrame, key: str, columns: list[str], ignore=()) -> DataFrame:
    """key, feature, value of every value that isn't zero, for columns not ignored."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns if c not in ignore))
    return df.select(key, F.inline(cells)).where("value <> 0")


def side_by_side(df: DataFrame, populations: dict[str, Column], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.where(c).select(F.lit(k).alias("population"), *columns) for k, c in populations.items()))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*(count(c).alias(f"distinct_{c}") for c in columns))


def pattern_lists(df: DataFrame, key: str, patterns: dict[str, Column]) -> DataFrame:
    """pattern, key, n: every row that shows a pattern, and beside it how many do."""
    named = df.select(key, F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in patterns.items())), lambda x: x.isNotNull())).alias("pattern"))
    counts = named.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))  # one row per pattern
    return named.join(F.broadcast(counts), "pattern").select("pattern", key, "n")


def outcome_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, successes, rate, and mean queries, steps and reduction of searches."""
    success, before, after = F.col("success").cast("boolean"), F.col("original_probability"), F.col("final_probability")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(success).alias("successes"), F.round(F.avg(success.cast("double")), 4).alias("success_rate"),
        F.round(F.avg("queries"), 4).alias("mean_queries"), F.round(F.avg("steps"), 4).alias("mean_steps"), F.round(F.avg(before - after), 4).alias("mean_reduction"),
    )


def transfer_matrix(df: DataFrame, source: str, evaluators: list[str], threshold: float = 0.5) -> DataFrame:
    """For each source and evaluator, the share of rows that the evaluator still scores at or above the threshold."""
    long = df.select(source, F.inline(F.array(*(F.struct(F.lit(e).alias("evaluator"), F.col(e).cast("double").alias("p")) for e in evaluators))))
    return long.groupBy(source, "evaluator").agg(F.round(F.avg((F.col("p") >= threshold).cast("double")), 4).alias("detected_share"))


def degradation(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Means before and after, and the loss, for each named pair of columns."""
    cells = F.array(*(F.struct(F.lit(k).alias("model"), F.round(F.avg(F.col(a).cast("double")), 4).alias("before"), F.round(F.avg(F.col(b).cast("double")), 4).alias("after")) for k, (a, b) in pairs.items()))
    return df.agg(cells.alias("a")).select(F.inline("a")).withColumn("loss", F.round(F.col("before") - F.col("after"), 4))


def method_comparison(df: DataFrame, method: str, detected: list[str]) -> DataFrame:
    return df.groupBy(method).agg(F.count(F.lit(1)).alias("n"), *(F.round(1 - F.avg(F.col(c).cast("double")), 4).alias(f"evaded_{c}") for c in detected))


def group_means(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 6).alias("mean"))


def ranked(df: DataFrame, order: str, by=(), most: int | None = None, key: str | None = None, name: str = "place") -> DataFrame:
    """Places by falling value (ties by key), within groups; at most so many."""
    w = W.partitionBy(*by).orderBy(F.desc(order), *([key] if key else []))
    out = df.withColumn(name, F.row_number().over(w))
    return out if most is None else out.where(F.col(name) <= most)


def extremes(df: DataFrame, order: str, key: str, n: int = 5) -> DataFrame:
    """The n largest and the n smallest, each by a bounded top-n."""
    top = df.orderBy(F.desc(order), key).limit(n).withColumn("end", F.lit("largest"))
    return top.unionByName(df.orderBy(F.asc(order), key).limit(n).withColumn("end", F.lit("smallest")))


def largest(df: DataFrame, order: str, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(order), key).limit(n)


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key; an aggregate, so a key of any size is one row from each task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("r")).select("r.*")


def history(df: DataFrame, key: str, time: str, tie: str, n: int = 20) -> DataFrame:
    """The last n rows of each key, newest first; ranked in parts of a key before over all of it."""
    w = lambda *by: W.partitionBy(key, *by).orderBy(F.desc(time), F.desc(tie))
    part = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(32)))
    few = part.withColumn("_r", F.row_number().over(w("_part"))).where(F.col("_r") <= n).drop("_r", "_part")
    return few.withColumn("place", F.row_number().over(w())).where(F.col("place") <= n)


def ttl_reuse(df: DataFrame, key: list[str], time: str, tie: str, ttl_seconds: float = 300.0) -> DataFrame:
    """df with `fresh`: false where a row comes less than ttl after the key's last fresh row. Hits don't extend it.

    tie must be unique within a key. Time is cut into stretches of ttl: each row's successor, the first one
    ttl or more after it, lies in the next stretch of its key or is the first of a later one. A row that
    comes ttl or more after the one before is fresh; from those all that successors lead to are found by
    doubling the jumps, so no task folds a whole key.
    """
    ttl = int(ttl_seconds * 1e6)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = cut(df.select(F.struct(*key).alias("k"), F.col(tie).alias("tie"), t.alias("t")).withColumn("s", F.floor(F.col("t") / ttl)))
    one = F.struct("t", "tie")
    of_key = W.partitionBy("k").orderBy("s")
    stretches = rows.groupBy("k", "s").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    stretches = stretches.select("k", "s", "low", F.lag("high").over(of_key).alias("before"), F.lead("low").over(of_key).alias("after"), F.lead("s").over(of_key).alias("next_s"))
    stretches = cut(stretches)
    start = F.col("before").isNull() | (F.col("low.t") - F.col("before.t") >= ttl)
    marked = cut(stretches.where(start).select("k", F.col("low.tie").alias("tie")))
    # Successors in the next stretch: rows from there and questions from the stretch before, latest first.
    asks = rows.select("k", (F.col("s") + 1).alias("s"), (F.col("t") + ttl).alias("t"), F.lit(None).cast(dict(rows.dtypes)["tie"]).alias("tie"), F.col("tie").alias("asker"))
    both = rows.select("k", "s", "t", "tie", F.lit(None).cast(dict(rows.dtypes)["tie"]).alias("asker")).unionByName(asks)
    latest_first = W.partitionBy("k", "s").orderBy(F.desc("t"), F.desc_nulls_last("tie")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("to", F.last("tie", ignorenulls=True).over(latest_first)).where("asker IS NOT NULL").select("k", (F.col("s") - 1).alias("s"), F.col("asker").alias("tie"), "to")
    # Without one there, it is the first row of the next stretch after that one.
    later = stretches.select("k", "s", F.when(F.col("next_s") > F.col("s") + 1, F.col("after.tie")).alias("skip"))
    beyond = stretches.select("k", (F.col("s") - 1).alias("s"), F.col("after.tie").alias("past"))
    jumps = found.join(later, ["k", "s"]).join(beyond, ["k", "s"], "left").select("k", "tie", F.coalesce("to", "skip", "past").alias("to")).where("to IS NOT NULL")
    jumps = cut(jumps)
    while True:
        new = cut(marked.join(jumps, ["k", "tie"]).select("k", F.col("to").alias("tie")).distinct().join(marked, ["k", "tie"], "left_anti"))
        if new.isEmpty():
            break
        marked = cut(marked.unionByName(new))
        jumps = cut(jumps.alias("a").join(jumps.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.to") == F.col("b.tie"))).select("a.k", "a.tie", "b.to"))
    fresh = marked.select(F.col("k").alias("_k"), F.col("tie").alias("_f"))
    return df.join(fresh, (F.struct(*key) == F.col("_k")) & (F.col(tie) == F.col("_f")), "left").withColumn("fresh", F.col("_f").isNotNull()).drop("_f", "_k")


def debounced(df: DataFrame, key: list[str], time: str, gap: str = "800 milliseconds") -> DataFrame:
    """One row per burst: the moment a quiet gap has passed after its last event, and how many events it had."""
    stamped = df.withColumn("_t", F.col(time).cast("timestamp"))
    out = stamped.groupBy(*key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*key, F.col("w.end").alias("acts_at"), "events")


def windowed_counts(df: DataFrame, what: list[str], time: str, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    stamped = df.withColumn("_t", F.col(time).cast("timestamp"))
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return stamped.groupBy(w.alias("w"), *what).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *what, "n")
