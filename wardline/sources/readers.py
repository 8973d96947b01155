"""Readers and writers. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import fixed
from wardline.operators.cleaning import with_places

URL_CSV = "url string, label string, source string, _corrupt_record string"
SAMPLE = "sample_id string, url string, label int, html string, screenshot_available boolean"


def label_number(label: Column, positive=fixed.POSITIVE_LABELS, negative=fixed.NEGATIVE_LABELS) -> Column:
    """1, 0, or null where the label's meaning isn't known."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text.isin(*positive), 1).when(text.isin(*negative), 0)


def read_labelled_pair(spark: SparkSession, positive: str, negative: str, columns: list[str] | None = None) -> DataFrame:
    """Two Parquet tables, one per class, with the class as label. columns prunes the scan."""
    parts = [spark.read.parquet(path).withColumn("label", F.lit(label)) for path, label in ((positive, 1), (negative, 0))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.select(*columns, "label") if columns else both


def read_sample_dirs(spark: SparkSession, root: str) -> DataFrame:
    """<id>/Label/label.txt, <id>/URL/url.txt and <id>/RAW-HTML/index.html as samples; screenshots are only noted."""
    part = r"([^/]+)/(Label/label\.txt|URL/url\.txt|RAW-HTML/index\.html)$"
    files = spark.read.text([f"{root}/*/Label/*", f"{root}/*/URL/*", f"{root}/*/RAW-HTML/*"], wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    named = files.select(F.regexp_extract("path", part, 1).alias("sample_id"), F.regexp_extract("path", part, 2).alias("part"), "value").where("sample_id <> ''")
    wide = named.groupBy("sample_id").pivot("part", ["Label/label.txt", "URL/url.txt", "RAW-HTML/index.html"]).agg(F.first("value"))
    return wide.select("sample_id", F.trim(F.col("`URL/url.txt`")).alias("url"), label_number(F.col("`Label/label.txt`")).alias("label"), F.col("`RAW-HTML/index.html`").alias("html"), F.lit(False).alias("screenshot_available"))


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples from Parquet where the folder holds any, else from sample folders; what is there is asked of Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if there is not None and len(there):
        return standard_samples(spark.read.parquet(root))
    return read_sample_dirs(spark, root)


def standard_samples(raw: DataFrame, names=None) -> DataFrame:
    """Raw page records under the standard names; unknown labels are null."""
    names = names or {"folder_name": "sample_id", "URL": "url", "Class": "label", "full_html": "html"}
    df = raw.withColumnsRenamed(names)
    shot = F.col("image_path").isNotNull() if "image_path" in df.columns else F.lit(False)
    return df.select("sample_id", "url", label_number(F.col("label")).alias("label"), "html", shot.alias("screenshot_available"))


def read_url_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects with a reason) of a CSV with url, label and source."""
    raw = spark.read.schema(URL_CSV).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("url").isNull(), "no_url")
        .when(~F.trim("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), "bad_url").when(label_number(F.col("label")).isNull(), "bad_label")
    )
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(F.trim("url").alias("url"), label_number(F.col("label")).alias("label"), "source")
    return good, judged.where("reason IS NOT NULL").select("url", "label", "source", "reason")


def synthetic_ids(df: DataFrame, order_col: str, label: str = "label", names=None) -> DataFrame:
    """sample_id <CLASS>_<six digits> by class, numbered from 0 in order."""
    names = names or {0: "LEGIT", 1: "PHISH"}
    prefix = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    name = F.coalesce(F.try_element_at(prefix, F.col(label)), F.lit("UNKNOWN"))
    return with_places(df, order_col, label, "_place").withColumn("sample_id", F.format_string("%s_%06d", name, F.col("_place") - 1)).drop("_place")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame, label: str = "label", **facts) -> DataFrame:
    """One JSON record: rows, rows by class, share of positives, and the facts given."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    share = F.round(F.try_divide(F.col("positive"), F.col("rows")), 4).alias("positive_share")
    return counts.select(F.to_json(F.struct("rows", "positive", "negative", share, *(F.lit(v).alias(k) for k, v in facts.items()))).alias("value"))


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, field: str = "results") -> DataFrame:
    """One row per entry of the nested list in JSON result records."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def inspect_columns(df: DataFrame) -> DataFrame:
    """column_name, rows, nulls, longest (characters) and least value of each column, in one pass."""
    cells = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(text.isNull()).alias("null_count"), F.max(F.length(text)).cast("long").alias("longest"), F.min(text).alias("least")))
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


SPREAD_ROWS = 1_000  # rows a task


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """df, read straight from files, dealt to tasks of about `rows` rows and to all cores where the files give fewer splits: work on each row that takes long makes more tasks on a larger table, not longer ones. A table of enough splits is not shuffled; rows are counted in the files' footers."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
