"""Filters, de-duplication, quotas, samples and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions.urls import normalised
from wardline.sources.shared import cut


def with_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn(url_col, normalised(F.col(url_col)))


def has_scheme_and_host(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def web_only(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.where(F.coalesce(F.col(url_col).rlike("^https?://"), F.lit(False)))


def valid_rows(df: DataFrame, url_col: str = "url", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with scheme, host and a label of 0 or 1; the others)."""
    ok = has_scheme_and_host(F.col(url_col)) & F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return df.where(ok), df.where(~ok)


def dedupe_urls(df: DataFrame, mode: str = "exact", order_col: str | None = None, url_col: str = "url") -> DataFrame:
    """One row per URL: the first by order_col, or any where the order doesn't matter. folded: case and outer blanks don't count."""
    key = {"exact": F.col(url_col), "folded": F.lower(F.trim(url_col))}[mode]
    keyed = df.withColumn("_key", key)
    if order_col is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    columns = df.columns
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*columns), order_col).alias("r"))
    return first.select("r.*")


def filter_pages(df: DataFrame, min_url: int = 8, min_html: int = 200, url_col: str = "url", html_col: str = "html") -> DataFrame:
    return df.where((F.length(url_col) >= min_url) & (F.length(html_col) >= min_html))


def drop_null_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.na.drop(subset=[url_col])


def null_share(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(column).isNull().cast("double")), 6).alias("null_share"))


def numeric_filled(df: DataFrame, label: str = "label") -> DataFrame:
    """Numeric columns only, nulls as 0 except in the label."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")]
    return df.select(*numeric).na.fill(0, subset=[c for c in numeric if c != label])


def with_html_flag(df: DataFrame, html_col: str = "html") -> DataFrame:
    return df.withColumn("html_available", (F.col(html_col).isNotNull() & (F.length(html_col) > 0)).cast("int"))


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in an order given by a hash of key and seed, whatever the partitioning."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def select_hard_negatives(df: DataFrame, keywords, n: int, key: str = "sample_id", html_col: str = "html", seed: int = 42, kind: str = "keyword") -> DataFrame:
    """n seeded rows whose html holds a keyword, with where they come from."""
    low = F.lower(F.coalesce(F.col(html_col), F.lit("")))
    hit = reduce(lambda a, b: a | b, (low.contains(k.lower()) for k in keywords))
    return exact_sample(df.where(hit), n, key, seed).withColumn("label", F.lit(0)).withColumn("hard_negative_type", F.lit(kind)).withColumn("filter_criteria", F.lit("|".join(keywords)))


def with_places(df: DataFrame, order_col: str, by: str | None = None, name: str = "place") -> DataFrame:
    """df with places from 1 in order, within `by` if given; no task holds more than a range of rows.

    Rows are dealt to ranges of the order, the ranges counted, and places numbered inside each from where
    the earlier ranges end. Rows that tie come in any order.
    """
    keys = [by] if by else []
    ranged = cut(df.repartitionByRange(*keys, order_col).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias("_by") for k in keys), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_at")
    joined = ranged.join(starts, same & F.col(by).eqNullSafe(F.col("_by")) if by else same)
    place = F.col("_start") + F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order_col))
    return joined.withColumn(name, place).select(*df.columns, name)


def running_sums(df: DataFrame, order: Column, columns: list[str], by=()) -> DataFrame:
    """df with the columns' sums up to each row in order (<column>_upto) and over all (<column>_all), within `by`.

    Rows are dealt to ranges of the order and summed inside each from where the earlier ranges end, so no
    task holds a whole group. The order must not tie inside a group.
    """
    ranged = cut(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in columns))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        *(F.col(k).alias(f"_by_{k}") for k in by), F.col("_part").alias("_at"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start_{c}") for c in columns), *(F.sum(c).over(W.partitionBy(*by)).alias(f"{c}_all") for c in columns),
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by), F.col("_part") == F.col("_at"))
    inside = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    upto = {f"{c}_upto": F.col(f"_start_{c}") + F.sum(c).over(inside) for c in columns}
    return ranged.join(starts, same).withColumns(upto).select(*df.columns, *upto, *(f"{c}_all" for c in columns))


def quota(df: DataFrame, key: str, limits: int | dict, order_col: str) -> DataFrame:
    """The first rows of each key in order, as many as its limit; keys without a limit have none.

    Ranks are found per key and hash of the order column first, so one task never holds a whole key:
    only rows that are among the first of their part go on.
    """
    most = F.lit(limits) if isinstance(limits, int) else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(key)), F.lit(0))
    part = F.pmod(F.xxhash64(order_col), F.lit(64))
    own = df.withColumn("_part", part).withColumn("_place", F.row_number().over(W.partitionBy(key, "_part").orderBy(order_col)))
    few = own.where(F.col("_place") <= most)
    return few.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(order_col))).where(F.col("_place") <= most).drop("_part", "_place")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def head(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*order if isinstance(order, (list, tuple)) else (order,)).limit(n)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys both have."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("shared_keys"))


def rejection_counts(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first rule they fail; `accepted` for the others."""
    reason = F.coalesce(*(F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in rules), F.lit("accepted"))
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must each have every key once: a repeated key raises an error when it runs."""
    once = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(dict(df.dtypes)[key])).otherwise(F.col(key))).drop("_n")
    return once(left).join(once(right), key)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """df with the table's value for its key, null where there's none."""
    return df.join(table.select(key, value).dropDuplicates([key]), key, "left")


def prefix_matches(df: DataFrame, short: DataFrame, column: str, prefix: str, bucket: int = 8) -> DataFrame:
    """Rows of df with every prefix of `short` that they begin with; the first characters are the join's key, shorter prefixes come by their own length."""
    text, p = F.col(column), F.col(prefix)
    sized = short.select(prefix, F.least(F.length(prefix), F.lit(bucket)).alias("_n")).where("_n > 0").distinct()
    keyed = df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(bucket)))).withColumn("_k", F.substring(column, F.lit(1), F.col("_n"))).where(F.length("_k") == F.col("_n"))
    return keyed.join(sized.withColumn("_k", F.substring(prefix, F.lit(1), F.col("_n"))), ["_n", "_k"]).where(text.startswith(p)).drop("_n", "_k")
