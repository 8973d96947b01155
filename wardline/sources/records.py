"""Records of unknown shape, as variants: broken ones apart, fields found over all rows, nested lists as rows, columns by path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.shared import cut


def parsed_records(df: DataFrame, text: str = "value", name: str = "record") -> tuple[DataFrame, DataFrame]:
    """(rows with their JSON as a variant in place of the text, rows whose text is no JSON).

    A null or blank text is no record and goes with neither. A text that is the JSON null is a record.
    """
    read = df.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").withColumn("_read", F.try_parse_json(text))
    good = read.where("_read IS NOT NULL")
    return good.withColumn(name, F.col("_read")).drop("_read", *({text} - {name})), read.where("_read IS NULL").drop("_read")


def kind(value: str):
    """What a variant is: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID (the JSON null)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def record_fields(df: DataFrame, value: str = "record") -> DataFrame:
    """path, kind and n: how often each kind of value stands under each path, over all rows; entries of arrays share `[]`.

    Works down one level of nesting at a time, counting in place before the shuffle; only what holds further values is
    kept for the next level. Keys are quoted where they aren't plain words, so different paths never look alike.
    """
    spark = df.sparkSession
    level = df.where(F.col(value).isNotNull()).select(F.lit("$").alias("path"), F.col(value).alias("v"))
    found = []
    while True:
        level = cut(level.withColumn("kind", kind("v")))
        if level.isEmpty():
            break
        found.append(level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        inside = level.where(F.col("kind").isin("OBJECT", "ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        key = F.when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.to_json(F.struct("key")), F.lit("]")))
        step = F.when(F.col("kind") == "ARRAY", F.lit("[]")).otherwise(key)
        level = inside.select(F.concat("path", step).alias("path"), F.col("value").alias("v"))
    nothing = spark.createDataFrame([], "path string, kind string, n long")
    return reduce(DataFrame.unionByName, found, nothing)


def record_entries(df: DataFrame, path: str, value: str = "record", name: str = "entry") -> DataFrame:
    """One row per entry of the list under path, with its place from 0; records without such a list give none."""
    inner = df.withColumn("_list", F.try_variant_get(value, path, "variant")).where(kind("_list") == "ARRAY")
    out = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return out.select(*df.columns, F.col("pos").alias("place"), F.col("value").alias(name))


def record_columns(df: DataFrame, columns: dict[str, tuple[str, str]], value: str = "record") -> DataFrame:
    """df with a column for each name -> (path, type), null where there is none or it can't be of that type, and `unfit`: the sorted names of the latter."""
    raw = {n: F.try_variant_get(value, path, "variant") for n, (path, _) in columns.items()}
    got = {n: F.try_variant_get(value, path, as_) for n, (path, as_) in columns.items()}
    unfit = [F.when(raw[n].isNotNull() & ~F.is_variant_null(raw[n]) & got[n].isNull(), F.lit(n)) for n in sorted(columns)]
    return df.select("*", *(c.alias(n) for n, c in got.items()), F.array_compact(F.array(*unfit)).alias("unfit"))
