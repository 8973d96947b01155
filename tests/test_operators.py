import pytest
from pyspark.sql import functions as F

from wardline.operators import cleaning, evaluation, models, robustness, scoring, splits, summaries
from wardline.plans import robustness_queries, url_queries
from wardline.sources import readers
from wardline.sources.elements import page_elements
from wardline.streaming import streams


def test_metrics_of_known_counts(spark):
    got = evaluation.from_counts(spark.createDataFrame([(911, 36, 17, 737)], "tn int, fp int, fn int, tp int")).first()
    assert [got[c] for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")] == [0.9688, 0.9534, 0.9775, 0.9653, 0.0380, 0.0225]


def test_empty_and_single_class(spark):
    empty = spark.createDataFrame([], "label int, score double")
    assert evaluation.metrics(empty).first()["f1"] == 0.0
    one = spark.createDataFrame([(1, 0.4), (1, 0.2)], "label int, score double")
    assert evaluation.roc_auc(one).first()["roc_auc"] is None
    assert evaluation.metrics(one).first()["precision"] == 0.0


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert evaluation.roc_auc(df).first()["roc_auc"] == 0.875


@pytest.mark.parametrize("parts", [1, 7])
def test_split_keeps_groups_and_ignores_partitions(spark, parts):
    df = spark.range(2000).select("id", (F.col("id") % 97).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label")).repartition(parts)
    out = splits.domain_split(df, group="g", label="label")
    assert out.count() == 2000 and out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.leakage_report(out, ["g"]).first()["total"] == 0
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert abs(got["train"] - 0.72 * 97) <= 2


def test_even_group_has_majority_zero(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], "g string, label int")
    assert splits.group_summary(df, "g").first()["majority"] == 0


def test_dedupe_modes(spark):
    df = spark.createDataFrame([(2, "http://A "), (1, "http://a"), (3, "http://a")], "k int, url string")
    assert [r["k"] for r in cleaning.dedupe_urls(df, "exact", "k").orderBy("k").collect()] == [1, 2]
    assert [r["k"] for r in cleaning.dedupe_urls(df, "folded", "k").collect()] == [1]


def test_unique_join_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id int, a string")
    with pytest.raises(Exception, match="repeated key"):
        cleaning.unique_join(a, spark.createDataFrame([(1, "z")], "id int, b string"), "id").collect()


def test_ttl_reuse_is_not_extended_by_hits(spark):
    rows = [(i, "u", s) for i, s in enumerate((0, 200, 299, 300, 599, 601))]
    df = spark.createDataFrame(rows, "k int, u string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["fresh"] for r in summaries.ttl_reuse(df, ["u"], "ts", "k").orderBy("k").collect()]
    assert got == [True, False, False, True, False, True]


def test_label_synonyms(spark):
    df = spark.createDataFrame([(" Phishing",), ("legit",), ("0",), ("what",), (None,)], "c string")
    assert [r[0] for r in df.select(readers.label_number(F.col("c"))).collect()] == [1, 0, 0, None, None]


def test_sample_folders(spark, tmp_path):
    for name, label in (("a", "phishing"), ("b", "benign")):
        for part, file, text in (("Label", "label.txt", label), ("URL", "url.txt", f"http://{name}.test\n"), ("RAW-HTML", "index.html", "<p>\n</p>")):
            (tmp_path / name / part).mkdir(parents=True)
            (tmp_path / name / part / file).write_text(text)
    got = readers.read_samples(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["label"], r["html"]) for r in got] == [("a", 1, "<p>\n</p>"), ("b", 0, "<p>\n</p>")]


def test_url_csv_rejects(spark, tmp_path):
    (tmp_path / "u.csv").write_text("url,label,source\nhttp://a.test/,1,x\nnope,1,x\nhttp://b.test/,maybe,x\n")
    good, bad = readers.read_url_csv(spark, str(tmp_path / "u.csv"))
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["bad_label", "bad_url"]


def test_labelled_pair_and_manifest(spark, tmp_path):
    for name, n in (("p", 3), ("n", 5)):
        spark.range(n).select(F.col("id").cast("string").alias("url")).write.parquet(str(tmp_path / name))
    both = readers.read_labelled_pair(spark, str(tmp_path / "p"), str(tmp_path / "n"), ["url"])
    assert both.columns == ["url", "label"] and '"positive_share":0.375' in readers.manifest(both).first()["value"]
    readers.write_splits(both.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    readers.write_csv(both, str(tmp_path / "c"), ["label", "url"])
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 8 and spark.read.csv(str(tmp_path / "c"), header=True).columns == ["label", "url"]


def test_model_guards(spark):
    df = spark.createDataFrame([(1, 0.1)], "label int, x double")
    with pytest.raises(ValueError, match="missing"):
        models.require(df, ["y"])
    with pytest.raises(ValueError, match="classes"):
        models.require(df, ["x"])


def test_component_learns(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1) * 0.5).alias("x"), F.rand(2).alias("y"))
    fit = models.fit_component(df, df, ["x", "y"], boosted={"maxIter": 3, "maxDepth": 2}, forest={"numTrees": 3, "maxDepth": 3})
    assert evaluation.metrics(fit.transform(df), score="probability").first()["accuracy"] > 0.95


def test_worst_cases_are_of_all_pages_and_changes(spark, sf_dir):
    df = robustness_queries.pages_of(spark, sf_dir)
    got = {r["page_id"]: r for r in robustness_queries.worst_cases(spark, sf_dir).collect()}
    assert set(got) == {r["page_id"] for r in df.select("page_id").collect()}
    single = scoring.scan_urls(robustness.perturb_urls(df.select("page_id", "url"))).groupBy("page_id").agg(F.min("phishing_probability").alias("p")).collect()
    alive = [r for r in single if got[r["page_id"]]["original_probability"] >= 0.2]
    assert alive and all(got[r["page_id"]]["final_probability"] + 0.005 * got[r["page_id"]]["steps"] <= r["p"] + 0.005 + 1e-9 for r in alive)
    assert max(r["steps"] for r in got.values()) <= 3 and all(r["final_probability"] <= r["original_probability"] for r in got.values())


def test_samples_from_parquet_and_results(spark, tmp_path):
    raw = spark.createDataFrame([("a", "http://a.test", "Phishing", "<p>", "x.png"), ("b", "http://b.test", "odd", None, None)], "folder_name string, URL string, Class string, full_html string, image_path string")
    raw.write.parquet(str(tmp_path / "pages"))
    got = readers.read_samples(spark, str(tmp_path / "pages")).orderBy("sample_id").collect()
    assert [tuple(r) for r in got] == [("a", "http://a.test", 1, "<p>", True), ("b", "http://b.test", None, None, False)]
    (tmp_path / "r.json").write_text('{"run": 1, "results": [{"name": "x", "score": 0.5}, {"name": "y", "score": 1.5}]}')
    rows = readers.read_results(spark, str(tmp_path / "r.json"), "run int, results array<struct<name:string,score:double>>")
    assert sorted(tuple(r) for r in rows.collect()) == [("x", 0.5), ("y", 1.5)]


def test_small_cleaning_steps(spark):
    df = spark.createDataFrame([(1, "http://a.test", "<p>"), (2, None, ""), (3, "b.test", None)], "sample_id int, url string, html string")
    assert [r["sample_id"] for r in cleaning.drop_null_urls(df).orderBy("sample_id").collect()] == [1, 3]
    assert [r["html_available"] for r in cleaning.with_html_flag(df).orderBy("sample_id").collect()] == [1, 0, 0]
    assert [r["url"] for r in cleaning.with_url(df).orderBy("sample_id").collect()] == ["http://a.test", None, "http://b.test"]
    a, b = ([r["sample_id"] for r in cleaning.shuffled(df.repartition(n), "sample_id").collect()] for n in (1, 3))
    assert a == b and sorted(a) == [1, 2, 3]
    assert [r["sample_id"] for r in cleaning.head(df, ["sample_id"], 2).collect()] == [1, 2]


def test_outcomes_of_what_a_model_looks_at(spark):
    outcomes = spark.createDataFrame([("url_fragment", 1), ("page_meta", 2), ("url_fragment", 3)], "perturbation string, page_id int")
    models_ = spark.createDataFrame([("url", "url_fragment"), ("url", "url_fragment"), ("page", "page_meta")], "model string, perturbation string")
    assert sorted((r["model"], r["page_id"]) for r in robustness.compatible(outcomes, models_).collect()) == [("page", 2), ("url", 1), ("url", 3)]


def test_page_changes_tell_how_far_they_move(spark):
    long = "<html><body><p>" + "word " * 50_000 + "</p></body></html>"
    pages_ = spark.createDataFrame([(1, "http://a.test", "<body><p>login password</p></body>"), (2, "http://b.test", long)], "page_id int, url string, html string")
    got = {(r["page_id"], r["perturbation"]): r for r in robustness.perturb_pages(page_elements(pages_)).drop("elements").collect()}
    assert got[1, "page_padding"]["length_change"] == len(robustness.PADDING) and got[1, "page_padding"]["valid"]
    assert not got[1, "page_text_as_image"]["valid"] and got[1, "page_text_as_image"]["length_change"] == -len("login password")
    assert {k for k in robustness.PAGE_CHANGES if (2, k) not in got} == {"page_long_hidden_start"}


def test_debounced_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:01"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 00:00:00"), ("u", "2024-01-02 00:00:00"), ("v", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "user string, at string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.debounced_stream(stream, ["user"], "at", "5 seconds", "1 minute")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["user"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]  # the last bursts wait for the watermark


def test_expected_rows_count_once_where_keys_repeat(spark):
    expected = spark.createDataFrame([("u", "a", "SAFE"), ("u", "b", "SAFE"), ("v", "a", "SAFE"), ("w", "b", "SAFE"), (None, "b", "SAFE")], "url string, category string, expected string")
    scans = spark.createDataFrame([("u", "SAFE"), ("u", "SAFE"), ("v", "SAFE"), ("v", "PHISHING"), (None, "SAFE")], "url string, verdict string")
    got = {r["category"]: r[1:] for r in scoring.expected_matrix(scans, expected).collect()}
    assert got == {"a": (2, 1, 0), "b": (3, 1, 2)}


def test_pages_that_share_an_address_are_rows_of_their_own(spark, tmp_path):
    rows = [(i, f"http://host{i % 3}.example/a", "<p>x</p>") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["category"]: (r["n"], r["missing"]) for r in url_queries.expected_matrix(spark, str(tmp_path)).collect()}
    assert got == {f"c{k}": (sum(i % 4 == k for i in range(30)), sum(i % 4 == k and i % 5 == 0 for i in range(30))) for k in range(4)}
