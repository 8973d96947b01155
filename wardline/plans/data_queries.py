"""Queries over labelled rows, events and vectors, with DuckDB SQL that says the same in its own way."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from wardline.operators import augment, cleaning, evaluation, models, sketches, splits, summaries
from wardline.plans.url_queries import table
from wardline.sources import readers, records
from wardline.sources.shared import saved_parts

# Labelled rows: documents with a label; scores are made of n_chars.
LABELLED = """l AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, (n_chars % 101) / 100.0::DOUBLE AS score, ((n_chars * 7) % 101) / 100.0::DOUBLE AS score2, n_chars % 101 AS points
  FROM documents d JOIN labels USING (doc_id))"""


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    n = F.col("n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumns({"score": n % 101 / 100.0, "score2": n * 7 % 101 / 100.0, "points": n % 101})


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def metrics_sql(yes: str, label: str = "toxic", by: str = "", source: str = "l", more: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""m AS (SELECT {head}{more}count(*) FILTER (NOT ({yes}) AND {label} = 0) AS tn, count(*) FILTER ({yes} AND {label} = 0) AS fp, count(*) FILTER (NOT ({yes}) AND {label} = 1) AS fn, count(*) FILTER ({yes} AND {label} = 1) AS tp FROM {source}{group}),
r AS (SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 4) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 4), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 4), 0) AS recall,
  coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 4), 0) AS f1, coalesce(round(fp / nullif(fp + tn, 0)::DOUBLE, 4), 0) AS fpr, coalesce(round(fn / nullif(fn + tp, 0)::DOUBLE, 4), 0) AS fnr, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 4), 0) AS detection_rate FROM m)"""


CURVE = """h AS (SELECT {by}{score} AS score, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM {source} GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM h WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def split_sql(key: str, ratios: dict[str, float], stratum: str, groups: str, seed: int = 42, whole: str = "round") -> str:
    """The split of each group: places in the order of md5 within its stratum."""
    cases, upto = [], "0"
    names = list(ratios)
    for name in names[:-1]:
        upto = f"{upto} + {whole}(n * {ratios[name]}::DOUBLE)"
        cases.append(f"WHEN place <= {upto} THEN '{name}'")
    return f"""g AS ({groups}), o AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws(':', '{seed}', coalesce(CAST({key} AS VARCHAR), ''))), {key}) AS place, count(*) OVER (PARTITION BY {stratum}) AS n FROM g),
s AS (SELECT *, CASE {' '.join(cases)} ELSE '{names[-1]}' END AS split FROM o)"""


R = {"train": 0.72, "validation": 0.13, "test": 0.15}
GROUPS = "SELECT source || '/' || CAST(n_chars % 40 AS VARCHAR) AS dom, CAST(sum(toxic) > count(*) / 2.0::DOUBLE AS INTEGER) AS majority FROM l GROUP BY 1"


def with_domain(df):
    return df.withColumn("dom", F.concat_ws("/", "source", (F.col("n_chars") % 40).cast("string")))


def domain_split(spark, sf_dir):
    return splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic").select("doc_id", "dom", "split")


def domain_split_plain(spark, sf_dir):
    return splits.domain_split(with_domain(labelled(spark, sf_dir)), {"train": 0.6, "validation": 0.15, "test": 0.25}, "dom").groupBy("split").agg(F.count_distinct("dom").alias("groups"), F.count(F.lit(1)).alias("n"))


def split_report(spark, sf_dir):
    df = splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic")
    return splits.leakage_report(df, ["dom", "source", "doc_id"])


def split_verdict(spark, sf_dir):
    df = splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic")
    return splits.leakage_verdict(splits.leakage_report(df, ["dom"]), splits.label_validity(df, label="toxic"))


def split_classes(spark, sf_dir):
    df = splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic")
    return splits.class_distribution(df, label="toxic")


def split_labels(spark, sf_dir):
    df = splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic")
    out = splits.label_validity(df, label="toxic")
    return out.select("split", F.array_join("labels", ",").alias("labels"), "null_labels", "valid")


SPLIT = f"WITH {LABELLED}, {split_sql('dom', R, 'majority', GROUPS)}, x AS (SELECT l.*, s.dom, s.split FROM l JOIN s ON s.dom = l.source || '/' || CAST(l.n_chars % 40 AS VARCHAR))"


def holdout(spark, sf_dir):
    return splits.stratified_holdout(labelled(spark, sf_dir), "doc_id", "toxic").select("doc_id", "split")


def assigned_split(spark, sf_dir):
    return splits.assigned(documents(spark, sf_dir).select("doc_id", F.concat(F.lit(" "), F.initcap("lang")).alias("split")), "de").select("doc_id")


def pool(spark, sf_dir):
    return splits.pool_split(labelled(spark, sf_dir).where("toxic = 1"), "doc_id").select("doc_id", "split")


def fixed_counts(spark, sf_dir):
    df = splits.fixed_count_split(labelled(spark, sf_dir), {0: {"train": 40, "test": 10}, 1: {"train": 8, "test": 4}}, "doc_id", "toxic")
    return df.where("split IS NOT NULL").select("doc_id", "split")


def group_labels(spark, sf_dir):
    return splits.group_summary(with_domain(labelled(spark, sf_dir)), "dom", "toxic")


def pairing(spark, sf_dir):
    df = labelled(spark, sf_dir)
    left = df.where("doc_id % 9 > 0").select("doc_id", "toxic")
    right = df.where("doc_id % 7 > 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    return splits.pairing_violations(left, right.unionByName(right.where("doc_id % 13 = 0")), "doc_id", "toxic")


def dedupe_exact(spark, sf_dir):
    return cleaning.dedupe_urls(documents(spark, sf_dir), "exact", "doc_id", "text").select("doc_id", "n_chars")


def dedupe_folded(spark, sf_dir):
    return cleaning.dedupe_urls(documents(spark, sf_dir), "folded", "doc_id", "text").select("doc_id", "n_chars")


def long_texts(spark, sf_dir):
    return cleaning.filter_pages(documents(spark, sf_dir), 2, 1000, "lang", "text").select("doc_id", "n_chars")


def web_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("label", (F.col("page_id") % 3).cast("int"))
    good, bad = cleaning.valid_rows(cleaning.web_only(df))
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


def class_quota(spark, sf_dir):
    return cleaning.quota(documents(spark, sf_dir).select("doc_id", "lang"), "lang", {"en": 50, "de": 20, "fr": 10}, "doc_id")


def seeded_sample(spark, sf_dir):
    return cleaning.exact_sample(documents(spark, sf_dir).select("doc_id", "lang"), 100, "doc_id")


def hard_negatives(spark, sf_dir):
    return cleaning.select_hard_negatives(documents(spark, sf_dir), ["token", "license"], 50, "doc_id", "text").select("doc_id", "label", "hard_negative_type", "filter_criteria")


def id_joins(spark, sf_dir):
    docs, marked = documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return cleaning.only_ids(docs, marked, "doc_id").withColumn("marked", F.lit(True)).unionByName(cleaning.without_ids(docs, marked, "doc_id").withColumn("marked", F.lit(False))).groupBy("lang", "marked").agg(F.count(F.lit(1)).alias("n"))


def united(spark, sf_dir):
    out = cleaning.union_all(documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"))
    return out.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


def shared_keys(spark, sf_dir):
    return cleaning.shared_keys(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")



def rejections(spark, sf_dir):
    return cleaning.rejection_counts(documents(spark, sf_dir), [("short", F.col("n_chars") < 200), ("spanish", F.col("lang") == "es"), ("odd", F.col("doc_id") % 2 == 1)])


def paired_rows(spark, sf_dir):
    return cleaning.unique_join(documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def looked_up(spark, sf_dir):
    return cleaning.lookup(documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", "quality")


def prefixes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    short = table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 3).alias("prefix")).distinct()
    return cleaning.prefix_matches(docs.select("doc_id", "text"), short, "text", "prefix").select("doc_id", "prefix")


def null_share(spark, sf_dir):
    df = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return cleaning.null_share(df, "quality")


def filled(spark, sf_dir):
    df = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("toxic", "label")
    return cleaning.numeric_filled(df)


def inspected(spark, sf_dir):
    return readers.inspect_columns(documents(spark, sf_dir)).select("column_name", "row_count", "null_count", "longest")


def sample_ids(spark, sf_dir):
    return readers.synthetic_ids(labelled(spark, sf_dir), "doc_id", "toxic").select("doc_id", "sample_id")


def label_numbers(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, (" Phish", "benign", "SAFE ", "1", "0", "maybe", "malicious"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", readers.label_number(word).alias("label"))


def manifest(spark, sf_dir):
    out = readers.manifest(labelled(spark, sf_dir), "toxic", source="documents")
    return out.select(F.from_json("value", "rows long, positive long, negative long, positive_share double, source string").alias("v")).select("v.*")


def replicated(spark, sf_dir):
    return augment.replicate(labelled(spark, sf_dir).select("doc_id", "toxic"), 5).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("copy").alias("copies"))


def bootstrapped(spark, sf_dir):
    return augment.bootstrap_noise(labelled(spark, sf_dir).select("doc_id", "toxic", "score"), ["score"], 500, "doc_id", "toxic")


def dealt_in_turn(spark, sf_dir):
    return augment.round_robin(labelled(spark, sf_dir).select("doc_id"), "doc_id", ["a", "b", "c", "d"])


def perturbed_copies(spark, sf_dir):
    one = augment.one_perturbed_copy(labelled(spark, sf_dir).select("doc_id", "toxic"), "doc_id", ["p", "q", "r"], "toxic")
    four = augment.perturbed_copies(labelled(spark, sf_dir).select("doc_id", "toxic"), "doc_id", ["p", "q", "r", "s"], "toxic")
    return one.withColumn("kind", F.lit("one")).unionByName(four.withColumn("kind", F.lit("all"))).select("doc_id", "source_id", "perturbation", "kind")


def hard_negative_union(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("label", F.col("toxic")).select("doc_id", "label")
    return augment.with_hard_negatives(df.where("doc_id % 4 > 0"), df.where("doc_id % 4 = 0")).groupBy("label", "is_hard_negative").agg(F.count(F.lit(1)).alias("n"))


def metric_table(spark, sf_dir):
    return evaluation.metrics(labelled(spark, sf_dir), "toxic", "score", 0.5, ["lang"])


def roc_areas(spark, sf_dir):
    return evaluation.roc_auc(labelled(spark, sf_dir), "toxic", "score", ["lang"])


def pr_areas(spark, sf_dir):
    return evaluation.pr_areas(labelled(spark, sf_dir), "toxic", "score")


def compared_models(spark, sf_dir):
    return evaluation.compare_models(labelled(spark, sf_dir), ["score", "score2"], "toxic")


def sweep(spark, sf_dir):
    return evaluation.threshold_sweep(labelled(spark, sf_dir), "toxic", "score")


def best_threshold(spark, sf_dir):
    return evaluation.best_threshold(evaluation.threshold_sweep(labelled(spark, sf_dir), "toxic", "score")).select("threshold", "f1")


SAFE, PHISH = [5, 10, 15, 20, 25], [40, 45, 50, 55, 60, 65, 70, 75]


def grid(spark, sf_dir):
    return evaluation.threshold_grid(labelled(spark, sf_dir), SAFE, PHISH, "phishing", "toxic", "points")


def best_cell(spark, sf_dir):
    cells = evaluation.threshold_grid(labelled(spark, sf_dir), SAFE, PHISH, "suspicious", "toxic", "points")
    return evaluation.best_cell(cells).select("safe_max", "phish_min", "f1", "suspicious")


CONFIGS = [(15, 50), (20, 50), (25, 55), (30, 60), (15, 45), (10, 40)]


def sensitivity(spark, sf_dir):
    return evaluation.threshold_sensitivity(labelled(spark, sf_dir), CONFIGS, "toxic", "points")


def deltas(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return evaluation.metric_deltas(evaluation.metrics(df, "toxic", "score"), evaluation.metrics(df, "toxic", "score2"), ["accuracy", "precision", "recall", "f1", "fpr"])


def hard_fpr(spark, sf_dir):
    return evaluation.hard_negative_fpr(labelled(spark, sf_dir).withColumn("is_hard_negative", (F.col("toxic") == 0) & (F.col("n_chars") > 2000)), "score", 0.5)


def false_alarms(spark, sf_dir):
    return evaluation.false_positives(labelled(spark, sf_dir), "score", "score2", label="toxic").select("doc_id", "score", "score2", "flagged_by")


def agreement(spark, sf_dir):
    return evaluation.score_agreement(labelled(spark, sf_dir), "score", "score2")


def alignment(spark, sf_dir):
    return evaluation.set_alignment(documents(spark, sf_dir).where("doc_id % 2 = 0"), table(spark, sf_dir, "labels"), "doc_id")


def event_profile(spark, sf_dir):
    return summaries.profile(events(spark, sf_dir), ["value"], ["event_type"])


DAYS = tuple(range(1, 8))


def events_by_day(spark, sf_dir):
    return events(spark, sf_dir).select(F.dayofweek("ts").alias("day"), "event_type", "value", "user_id")


def sketched_events(spark, sf_dir):
    """Sketches of the events by day of the week and kind, as stored and read back."""
    return saved_parts(sketches.sketched(events_by_day(spark, sf_dir), ["day", "event_type"], ["value"], ["user_id", "event_type"]), "sketches")


def sketched_moments(spark, sf_dir):
    return sketches.moments(sketches.merged(sketched_events(spark, sf_dir), ["event_type"]), ["event_type"]).where("column_name = 'value'")


def sketched_estimates(spark, sf_dir):
    by_day = sketches.merged(sketched_events(spark, sf_dir), ["day"])
    return sketches.estimates(sketches.merged(by_day)).unionByName(sketches.estimates(by_day, ["day"]), allowMissingColumns=True)


def sketched_overlaps(spark, sf_dir):
    return sketches.sketched_overlaps(sketched_events(spark, sf_dir), "day", list(DAYS), events_by_day(spark, sf_dir))


RECORDS_SQL = """t AS (SELECT event_id, '{"id": ' || event_id || ', "results": [' || props || ', {"k": "' || event_type || '"}]' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '}' END AS text FROM events)"""


def event_records(spark, sf_dir):
    """Events as JSON records with a nested list of two kinds of entries; every fifth one is broken."""
    close = F.when(F.col("event_id") % 5 == 0, "").otherwise("}")
    text = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "results": ['), "props", F.lit(', {"k": "'), "event_type", F.lit('"}]'), close)
    return records.parsed_records(events(spark, sf_dir).select("event_id", text.alias("text")), "text")


def record_fields(spark, sf_dir):
    return records.record_fields(event_records(spark, sf_dir)[0])


def record_entries(spark, sf_dir):
    entries = records.record_entries(event_records(spark, sf_dir)[0], "$.results").drop("record")
    out = records.record_columns(entries, {"k": ("$.k", "int")}, "entry")
    return out.select("event_id", F.col("place").cast("int").alias("place"), "k", F.array_join("unfit", ",").alias("unfit"))


def rejected_records(spark, sf_dir):
    return event_records(spark, sf_dir)[1].select("event_id", "text")


def value_shares(spark, sf_dir):
    return summaries.shares(events(spark, sf_dir), "value", 20.0, ["event_type"])


def correlated(spark, sf_dir):
    return summaries.correlations(labelled(spark, sf_dir), "toxic", ["score", "score2", "n_chars", "quality"])


def means_by_condition(spark, sf_dir):
    return summaries.conditional_means(labelled(spark, sf_dir), "n_chars", {"toxic": F.col("toxic") == 1, "clean": F.col("toxic") == 0, "good": F.col("quality") == 1})


def unusual(spark, sf_dir):
    return summaries.unusual_values(labelled(spark, sf_dir), "doc_id", ["toxic", "quality", "points"], ["quality"])


def populations(spark, sf_dir):
    return summaries.side_by_side(labelled(spark, sf_dir), {"toxic": F.col("toxic") == 1, "english": F.col("lang") == "en"}, ["doc_id", "score"])


def counted_values(spark, sf_dir):
    df = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return summaries.value_counts(df, "quality")


def distincts(spark, sf_dir):
    return summaries.distinct_counts(documents(spark, sf_dir), ["lang", "source", "text"])


def pattern_lists(spark, sf_dir):
    return summaries.pattern_lists(labelled(spark, sf_dir), "doc_id", {"toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 5000, "low": F.col("score") < 0.1})


def ranked_rows(spark, sf_dir):
    return summaries.ranked(labelled(spark, sf_dir).select("doc_id", "source", "score"), "score", ["source"], 3, "doc_id")


def extremes(spark, sf_dir):
    return summaries.extremes(labelled(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id")


def largest(spark, sf_dir):
    return summaries.largest(documents(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id")


def latest_events(spark, sf_dir):
    return summaries.latest(events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def event_history(spark, sf_dir):
    return summaries.history(events(spark, sf_dir).select("event_id", "ts", "user_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


def reused(spark, sf_dir):
    return summaries.ttl_reuse(events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "event_id", 7200.0).select("event_id", "fresh")


def debounced(spark, sf_dir):
    return summaries.debounced(events(spark, sf_dir), ["user_id"], "ts", "1 hour").groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.max("events").alias("largest"))


def tumbling(spark, sf_dir):
    return summaries.windowed_counts(events(spark, sf_dir), ["event_type"], "ts", "6 hours").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def sliding(spark, sf_dir):
    return summaries.windowed_counts(events(spark, sf_dir), ["event_type"], "ts", "6 hours", "2 hours").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def group_means(spark, sf_dir):
    return summaries.group_means(labelled(spark, sf_dir), "lang", "score")


def searches(df):
    """Outcomes of searches, made of labelled rows."""
    n = F.col("n_chars")
    return df.withColumns({"method": F.element_at(F.array(F.lit("beam"), F.lit("annealing"), F.lit("tree")), (n % 3 + 1).cast("int")), "target": F.col("lang"), "success": n % 5 == 0, "queries": n % 50, "steps": n % 4, "original_probability": F.col("score"), "final_probability": F.col("score") * F.col("score2")})


SEARCHES = f"WITH {LABELLED}, o AS (SELECT *, ['beam', 'annealing', 'tree'][n_chars % 3 + 1] AS method, lang AS target, n_chars % 5 = 0 AS success, n_chars % 50 AS queries, n_chars % 4 AS steps, score AS p0, score * score2 AS p1 FROM l)"


def search_stats(spark, sf_dir):
    return summaries.outcome_stats(searches(labelled(spark, sf_dir)), ["target", "method"])


def transfer(spark, sf_dir):
    return summaries.transfer_matrix(searches(labelled(spark, sf_dir)), "target", ["score", "score2"])


def degradation(spark, sf_dir):
    return summaries.degradation(searches(labelled(spark, sf_dir)), {"first": ("original_probability", "final_probability"), "second": ("score2", "final_probability")})


def methods(spark, sf_dir):
    df = searches(labelled(spark, sf_dir)).withColumns({"a": F.col("score") >= 0.5, "b": F.col("score2") >= 0.5})
    return summaries.method_comparison(df, "method", ["a", "b"])


def concepts(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    dims = vectors.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    centres = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("concept"))
    named = centres.select(F.concat(F.lit("concept_"), F.col("label")).alias("name"), "concept")
    return models.concept_findings(vectors, named, "vec_id").select("vec_id", F.array_join("concepts", ",").alias("concepts"))


def embedding_model(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    model = models.fit_on_embeddings(vectors.where("vec_id % 5 > 0"))
    return models.predict_embeddings(model, vectors.where("vec_id % 5 = 0")).select("vec_id", "label", "predicted")


COLUMNS = ["score", "score2", "n_chars", "quality"]
SMALL = {"boosted": {"maxIter": 8, "maxDepth": 3}, "forest": {"numTrees": 8, "maxDepth": 4}}


def split_rows(spark, sf_dir):
    df = splits.domain_split(with_domain(labelled(spark, sf_dir)), R, "dom", "toxic").withColumn("label", F.col("toxic").cast("int"))
    return [df.where(F.col("split") == s) for s in R]


def component_model(spark, sf_dir):
    train, validation, test = split_rows(spark, sf_dir)
    models.require(train, COLUMNS)
    component = models.fit_component(train, validation, COLUMNS, **SMALL)
    return component.transform(test).select("doc_id", "label", "probability")


def model_importances(spark, sf_dir):
    train, validation, _ = split_rows(spark, sf_dir)
    return summaries.largest(models.fit_component(train, validation, COLUMNS, **SMALL).importances(spark, COLUMNS), "importance", "feature", 10)


def logistic_model(spark, sf_dir):
    train, _, _ = split_rows(spark, sf_dir)
    return models.coefficients(models.fit_logistic(train, COLUMNS), spark, COLUMNS)


def fusion_model(spark, sf_dir):
    _, validation, test = split_rows(spark, sf_dir)
    a, b, c = models.fit_fusion(validation, "score", "score2")
    return test.select("doc_id", (1 / (1 + F.exp(-(a * F.col("score") + b * F.col("score2") + c)))).alias("probability"))


def cross_validation(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("label", F.col("toxic").cast("int"))
    return models.cross_validated(df.select("doc_id", "label", *COLUMNS), COLUMNS, "doc_id").select("doc_id", "fold", "probability")


def sql_of_sweep() -> str:
    return f"WITH {LABELLED}, g AS (SELECT round(step * 0.01::DOUBLE, 6) AS threshold, l.* FROM l, range(10, 91) AS t(step)), {metrics_sql('score >= threshold', by='threshold', source='g')}"


def cells(positive: str) -> str:
    pairs = ", ".join(f"({float(s)}::DOUBLE, {float(p)}::DOUBLE)" for s in SAFE for p in PHISH)
    return f"WITH {LABELLED}, g AS (SELECT l.*, safe_max, phish_min FROM l, (VALUES {pairs}) AS t(safe_max, phish_min)), {metrics_sql(f'points >= {positive}', by='safe_max, phish_min', source='g', more='count(*) FILTER (points >= safe_max AND points < phish_min) AS suspicious, ')}"


QUERIES = {
    "domain_split": (domain_split, f"{SPLIT} SELECT doc_id, dom, split FROM x"),
    "domain_split_plain": (domain_split_plain, f"WITH {LABELLED}, {split_sql('dom', {'train': 0.6, 'validation': 0.15, 'test': 0.25}, '1', 'SELECT dom, count(*) AS m FROM (' + GROUPS.split(' GROUP')[0].replace(', CAST(sum(toxic) > count(*) / 2.0::DOUBLE AS INTEGER) AS majority', '') + ') GROUP BY dom')} SELECT split, count(*) AS groups, CAST(sum(m) AS BIGINT) AS n FROM s GROUP BY split"),
    "split_report": (split_report, SPLIT + ", k AS (SELECT 'dom' AS key, dom AS v, split FROM x UNION ALL SELECT 'source', source, split FROM x UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), split FROM x), f AS (SELECT key, v, max(split = 'train')::INT AS a, max(split = 'validation')::INT AS b, max(split = 'test')::INT AS c FROM k GROUP BY key, v) SELECT key, CAST(sum(a * b) AS BIGINT) AS train_validation, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS validation_test, CAST(sum(a * b + a * c + b * c) AS BIGINT) AS total FROM f GROUP BY key"),
    "split_verdict": (split_verdict, "SELECT false AS contaminated, true AS labels_valid, true AS overall_pass"),
    "split_classes": (split_classes, f"{SPLIT} SELECT split, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives, round(avg(toxic), 4) AS positive_share FROM x GROUP BY ROLLUP (split)"),
    "split_labels": (split_labels, f"{SPLIT} SELECT split, string_agg(DISTINCT CAST(toxic AS VARCHAR), ',' ORDER BY CAST(toxic AS VARCHAR)) AS labels, count(*) FILTER (toxic IS NULL) AS null_labels, true AS valid FROM x GROUP BY split"),
    "stratified_holdout": (holdout, f"WITH {LABELLED}, {split_sql('doc_id', {'train': 0.8, 'test': 0.2}, 'majority', 'SELECT doc_id, toxic AS majority FROM l')} SELECT doc_id, split FROM s"),
    "pool_split": (pool, f"WITH {LABELLED}, {split_sql('doc_id', {'train': 0.6, 'validation': 0.2, 'evaluation': 0.2}, '1', 'SELECT doc_id FROM l WHERE toxic = 1', whole='floor')} SELECT doc_id, split FROM s"),
    "assigned_split": (assigned_split, "SELECT doc_id FROM documents WHERE lang = 'de'"),
    "fixed_count_split": (fixed_counts, f"WITH {LABELLED}, o AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM l) SELECT doc_id, CASE WHEN r <= CASE toxic WHEN 0 THEN 40 ELSE 8 END THEN 'train' ELSE 'test' END AS split FROM o WHERE r <= CASE toxic WHEN 0 THEN 50 ELSE 12 END"),
    "group_labels": (group_labels, f"WITH {LABELLED} SELECT source || '/' || CAST(n_chars % 40 AS VARCHAR) AS dom, count(*) AS samples, CAST(sum(toxic) AS BIGINT) AS positives, CAST(sum(toxic) > count(*) / 2.0::DOUBLE AS INTEGER) AS majority FROM l GROUP BY 1"),
    "pairing_violations": (pairing, f"WITH {LABELLED}, a AS (SELECT doc_id, toxic FROM l WHERE doc_id % 9 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END AS t2, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS n FROM l WHERE doc_id % 7 > 0), j AS (SELECT doc_id, CASE WHEN toxic IS NULL THEN 'missing_left' WHEN t2 IS NULL THEN 'missing_right' WHEN n > 1 THEN 'repeated' WHEN toxic <> t2 THEN 'label_differs' END AS problem FROM a FULL JOIN b USING (doc_id)) SELECT * FROM j WHERE problem IS NOT NULL"),
    "dedupe_exact": (dedupe_exact, "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"),
    "dedupe_folded": (dedupe_folded, "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1"),
    "filter_lengths": (long_texts, "SELECT doc_id, n_chars FROM documents WHERE length(lang) >= 2 AND length(text) >= 1000"),
    "valid_rows": (web_pages, "SELECT page_id, url, CAST(page_id % 3 AS INTEGER) AS label, page_id % 3 < 2 AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS ok FROM pages WHERE regexp_matches(url, '^https?://')"),
    "class_quota": (class_quota, "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END"),
    "seeded_sample": (seeded_sample, "SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100"),
    "hard_negatives": (hard_negatives, "SELECT doc_id, 0 AS label, 'keyword' AS hard_negative_type, 'token|license' AS filter_criteria FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'license') ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 50"),
    "id_joins": (id_joins, "SELECT lang, doc_id IN (SELECT doc_id FROM labels) AS marked, count(*) AS n FROM documents GROUP BY 1, 2"),
    "union_all": (united, "SELECT lang, quality, count(*) AS n FROM (SELECT lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT NULL, quality FROM labels) GROUP BY 1, 2"),
    "shared_keys": (shared_keys, "SELECT count(*) AS shared_keys FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)"),
    "rejection_counts": (rejections, "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'es' THEN 'spanish' WHEN doc_id % 2 = 1 THEN 'odd' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1"),
    "unique_join": (paired_rows, "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "lookup": (looked_up, "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "prefix_matches": (prefixes, "SELECT doc_id, prefix FROM documents JOIN (SELECT DISTINCT substr(text, 1, 3) AS prefix FROM benchmark) ON starts_with(text, prefix)"),
    "null_share": (null_share, "SELECT round(avg(CAST(quality IS NULL AS DOUBLE)), 6) AS null_share FROM documents LEFT JOIN labels USING (doc_id)"),
    "numeric_filled": (filled, "SELECT doc_id, n_chars, coalesce(quality, 0) AS quality, toxic AS label FROM documents LEFT JOIN labels USING (doc_id)"),
    "inspect_columns": (inspected, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, max(length(CAST({c} AS VARCHAR))) AS longest FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))),
    "sample_ids": (sample_ids, f"WITH {LABELLED} SELECT doc_id, printf('%s_%06d', CASE toxic WHEN 0 THEN 'LEGIT' ELSE 'PHISH' END, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) AS sample_id FROM l"),
    "label_numbers": (label_numbers, "SELECT doc_id, [1, 0, 0, 1, 0, NULL, 1][doc_id % 7 + 1] AS label FROM documents"),
    "manifest": (manifest, f"WITH {LABELLED} SELECT count(*) AS rows, count(*) FILTER (toxic = 1) AS positive, count(*) FILTER (toxic = 0) AS negative, round(avg(toxic), 4) AS positive_share, 'documents' AS source FROM l"),
    "replicate": (replicated, f"WITH {LABELLED} SELECT toxic, count(*) * 5 AS n, count(*) * 15 AS copies FROM l GROUP BY toxic"),
    "bootstrap_noise": (bootstrapped, None),
    "round_robin": (dealt_in_turn, f"WITH {LABELLED} SELECT doc_id, ['a', 'b', 'c', 'd'][(row_number() OVER (ORDER BY doc_id) - 1) % 4 + 1] AS assigned FROM l"),
    "perturbed_copies": (perturbed_copies, f"WITH {LABELLED}, p AS (SELECT doc_id, ['p', 'q', 'r'][(row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1] AS perturbation, 'one' AS kind FROM l WHERE toxic = 1 UNION ALL SELECT doc_id, unnest(['p', 'q', 'r', 's']), 'all' FROM l WHERE toxic = 1) SELECT CAST(doc_id AS VARCHAR) || '__' || perturbation AS doc_id, doc_id AS source_id, perturbation, kind FROM p"),
    "hard_negative_union": (hard_negative_union, f"WITH {LABELLED} SELECT CASE WHEN doc_id % 4 = 0 THEN 0 ELSE toxic END AS label, doc_id % 4 = 0 AS is_hard_negative, count(*) AS n FROM l GROUP BY 1, 2"),
    "metrics": (metric_table, f"WITH {LABELLED}, {metrics_sql('score >= 0.5', by='lang')} SELECT * FROM r"),
    "roc_auc": (roc_areas, f"WITH {LABELLED}, {CURVE.format(by='lang, ', score='score', source='l', part='PARTITION BY lang')} SELECT lang, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(any_value(p) * any_value(n), 0), 6) AS roc_auc FROM c GROUP BY lang"),
    "pr_areas": (pr_areas, f"WITH {LABELLED}, {CURVE.format(by='', score='score', source='l', part='')}, x AS (SELECT score, tp / (tp + fp)::DOUBLE AS p, tp / p::DOUBLE AS r FROM c), y AS (SELECT p, r, lag(p, 1, 1.0) OVER (ORDER BY score DESC) AS p0, lag(r, 1, 0.0) OVER (ORDER BY score DESC) AS r0 FROM x) SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc, round(sum((r - r0) * p), 6) AS average_precision FROM y"),
    "compare_models": (compared_models, f"WITH {LABELLED}, g AS (SELECT 'score' AS model, toxic, score FROM l UNION ALL SELECT 'score2', toxic, score2 FROM l), {metrics_sql('score >= 0.5', by='model', source='g')}, {CURVE.format(by='model, ', score='score', source='g', part='PARTITION BY model')}, z AS (SELECT model, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(any_value(p) * any_value(n), 0), 6) AS roc_auc FROM c GROUP BY model) SELECT r.*, roc_auc FROM r JOIN z USING (model)"),
    "threshold_sweep": (sweep, sql_of_sweep() + " SELECT * FROM r"),
    "best_threshold": (best_threshold, sql_of_sweep() + " SELECT threshold, f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1"),
    "threshold_grid": (grid, cells("phish_min") + " SELECT * FROM r"),
    "best_cell": (best_cell, cells("safe_max") + " SELECT safe_max, phish_min, f1, suspicious FROM r ORDER BY f1 DESC, safe_max, phish_min LIMIT 1"),
    "threshold_sensitivity": (sensitivity, f"WITH {LABELLED}, g AS (SELECT points, toxic, a::DOUBLE AS safe_max, b::DOUBLE AS phish_min FROM l, (VALUES {', '.join(map(str, CONFIGS))}) AS t(a, b)), c AS (SELECT safe_max, phish_min, CASE toxic WHEN 1 THEN 'positive' ELSE 'negative' END AS population, count(*) FILTER (points < safe_max) AS safe, count(*) FILTER (points >= safe_max AND points < phish_min) AS suspicious, count(*) FILTER (points >= phish_min) AS phishing FROM g GROUP BY 1, 2, 3) SELECT *, round((suspicious + phishing) / (safe + suspicious + phishing)::DOUBLE, 4) AS flagged_share FROM c"),
    "metric_deltas": (deltas, f"WITH {LABELLED}, g AS (SELECT 1 AS v, toxic, score FROM l UNION ALL SELECT 2, toxic, score2 FROM l), {metrics_sql('score >= 0.5', by='v', source='g')}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, max({c}) FILTER (v = 1) AS old, max({c}) FILTER (v = 2) AS new FROM r" for c in ("accuracy", "precision", "recall", "f1", "fpr")) + ") SELECT *, round(new - old, 4) AS delta, round(coalesce((old - new) / nullif(old, 0), 0) * 100, 4) AS reduction_pct FROM k"),
    "hard_negative_fpr": (hard_fpr, f"WITH {LABELLED} SELECT count(*) AS n, count(*) FILTER (score >= 0.5) AS flagged, round(avg(CAST(score >= 0.5 AS DOUBLE)), 4) AS fpr FROM l WHERE toxic = 0 AND n_chars > 2000"),
    "false_positives": (false_alarms, f"WITH {LABELLED} SELECT doc_id, score, score2, CASE WHEN score >= 0.5 AND score2 >= 0.5 THEN 'both' WHEN score >= 0.5 THEN 'old_only' ELSE 'new_only' END AS flagged_by FROM l WHERE toxic = 0 AND (score >= 0.5 OR score2 >= 0.5)"),
    "score_agreement": (agreement, f"WITH {LABELLED} SELECT count(*) AS n, round(corr(score, score2), 6) AS correlation, round(avg(CAST(score2 > score AS DOUBLE)), 6) AS new_higher, round(avg(score), 6) AS mean_old, round(avg(score2), 6) AS mean_new FROM l"),
    "set_alignment": (alignment, "SELECT (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS n_a, (SELECT count(*) FROM labels) AS n_b, (SELECT count(*) FROM labels WHERE doc_id % 2 = 0) AS n_both"),
    "record_fields": (record_fields, f"""WITH {RECORDS_SQL}, f AS (SELECT regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, j.type AS type FROM (SELECT text FROM t WHERE json_valid(text)) v, LATERAL (SELECT * FROM json_tree(v.text)) j)
        SELECT path, CASE WHEN type = 'VARCHAR' THEN 'STRING' WHEN type LIKE '%BIGINT' THEN 'BIGINT' ELSE type END AS kind, count(*) AS n FROM f GROUP BY 1, 2"""),
    "record_entries": (record_entries, f"""WITH {RECORDS_SQL}, e AS (SELECT event_id, p AS place, json_extract(text, '$.results[' || p || '].k') AS v FROM t, range(2) r(p) WHERE json_valid(text))
        SELECT event_id, CAST(place AS INTEGER) AS place, TRY_CAST(v AS INTEGER) AS k, CASE WHEN TRY_CAST(v AS INTEGER) IS NULL THEN 'k' ELSE '' END AS unfit FROM e"""),
    "rejected_records": (rejected_records, f"WITH {RECORDS_SQL} SELECT event_id, text FROM t WHERE NOT json_valid(text)"),
    "sketched_moments": (sketched_moments, """SELECT event_type, 'value' AS column_name, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, count(value) AS n,
        round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS largest FROM events GROUP BY event_type"""),
    "sketched_estimates": (sketched_estimates, None),
    # Set sketches are exact up to 16,384 values of a union, of which the events' days stay below.
    "sketched_overlaps": (sketched_overlaps, f"""WITH m AS (SELECT 'user_id' AS column_name, dayofweek(ts) + 1 AS day, CAST(user_id AS VARCHAR) AS v FROM events UNION SELECT 'event_type', dayofweek(ts) + 1, event_type FROM events)
        SELECT column_name, {', '.join(f'count(*) FILTER (a.day = {a} AND b.day = {b}) AS "{a}_{b}"' for a, b in combinations(DAYS, 2))} FROM m a JOIN m b USING (column_name, v) GROUP BY column_name"""),
    "event_profile": (event_profile, f"SELECT event_type, 'value' AS column_name, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS largest, {', '.join(f'round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}' for p in summaries.QUANTILES)}, count(*) FILTER (value IS NULL) AS nulls, 0 AS nans, 0 AS infinities FROM events GROUP BY event_type"),
    "value_shares": (value_shares, "SELECT event_type, count(*) AS n, round(avg(CAST(value > 20 AS DOUBLE)), 6) AS above, round(avg(CAST(value = 0 AS DOUBLE)), 6) AS zero FROM events GROUP BY event_type"),
    "correlations": (correlated, f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, toxic), 6) AS correlation FROM l" for c in ("score", "score2", "n_chars", "quality"))),
    "conditional_means": (means_by_condition, f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{k}' AS condition, count(*) AS n, round(avg(n_chars), 6) AS mean FROM l WHERE {c}" for k, c in (("toxic", "toxic = 1"), ("clean", "toxic = 0"), ("good", "quality = 1")))),
    "unusual_values": (unusual, f"WITH {LABELLED} SELECT doc_id, 'toxic' AS feature, toxic::DOUBLE AS value FROM l WHERE toxic <> 0 UNION ALL SELECT doc_id, 'points', points::DOUBLE FROM l WHERE points <> 0"),
    "side_by_side": (populations, f"WITH {LABELLED} SELECT 'toxic' AS population, doc_id, score FROM l WHERE toxic = 1 UNION ALL SELECT 'english', doc_id, score FROM l WHERE lang = 'en'"),
    "value_counts": (counted_values, "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality"),
    "distinct_counts": (distincts, "SELECT count(DISTINCT lang) AS distinct_lang, count(DISTINCT source) AS distinct_source, count(DISTINCT text) AS distinct_text FROM documents"),
    "pattern_lists": (pattern_lists, f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{k}' AS pattern, doc_id, count(*) OVER () AS n FROM l WHERE {c}" for k, c in (("toxic", "toxic = 1"), ("long", "n_chars > 5000"), ("low", "score < 0.1")))),
    "ranked": (ranked_rows, f"WITH {LABELLED}, o AS (SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM l) SELECT * FROM o WHERE place <= 3"),
    "extremes": (extremes, f"WITH {LABELLED} (SELECT doc_id, n_chars, 'largest' AS \"end\" FROM l ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL (SELECT doc_id, n_chars, 'smallest' FROM l ORDER BY n_chars, doc_id LIMIT 5)"),
    "largest": (largest, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20"),
    "latest_events": (latest_events, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "event_history": (event_history, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20"),
    "ttl_reuse": (reused, """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events), f AS (
      SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL
      UNION ALL SELECT user_id, event_type, (SELECT min(e.t) FROM e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.t >= f.t + 7200000000) AS t FROM f WHERE t IS NOT NULL)
      SELECT event_id, f.t IS NOT NULL AS fresh FROM e LEFT JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.t = f.t"""),
    "debounced": (debounced, "WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 1 HOUR, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT user_id, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, count(*) AS bursts, max(n) AS largest FROM c GROUP BY user_id"),
    "tumbling_windows": (tumbling, "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sliding_windows": (sliding, "SELECT CAST(floor(epoch(ts) / 7200) * 7200 - k * 7200 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events, range(3) AS t(k) GROUP BY 1, 2"),
    "group_means": (group_means, f"WITH {LABELLED} SELECT lang, count(*) AS n, round(avg(score), 6) AS mean FROM l GROUP BY lang"),
    "search_stats": (search_stats, f"{SEARCHES} SELECT target, method, count(*) AS attempts, count(*) FILTER (success) AS successes, round(avg(success::DOUBLE), 4) AS success_rate, round(avg(queries), 4) AS mean_queries, round(avg(steps), 4) AS mean_steps, round(avg(p0 - p1), 4) AS mean_reduction FROM o GROUP BY 1, 2"),
    "transfer_matrix": (transfer, f"{SEARCHES} SELECT target, 'score' AS evaluator, round(avg(CAST(score >= 0.5 AS DOUBLE)), 4) AS detected_share FROM o GROUP BY target UNION ALL SELECT target, 'score2', round(avg(CAST(score2 >= 0.5 AS DOUBLE)), 4) FROM o GROUP BY target"),
    "degradation": (degradation, f"{SEARCHES}, a AS (SELECT 'first' AS model, round(avg(p0), 4) AS before, round(avg(p1), 4) AS after FROM o UNION ALL SELECT 'second', round(avg(score2), 4), round(avg(p1), 4) FROM o) SELECT *, round(before - after, 4) AS loss FROM a"),
    "method_comparison": (methods, f"{SEARCHES} SELECT method, count(*) AS n, round(1 - avg(CAST(score >= 0.5 AS DOUBLE)), 4) AS evaded_a, round(1 - avg(CAST(score2 >= 0.5 AS DOUBLE)), 4) AS evaded_b FROM o GROUP BY method"),
    "concept_findings": (concepts, """WITH d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS t(i) GROUP BY label, i), c AS (SELECT 'concept_' || label AS name, list(m ORDER BY i) AS v FROM d GROUP BY label),
      p AS (SELECT vec_id, name FROM embeddings, c WHERE list_cosine_similarity(embedding::DOUBLE[], v) > 0.4) SELECT vec_id, string_agg(name, ',' ORDER BY name) AS concepts FROM p GROUP BY vec_id"""),
    "embedding_model": (embedding_model, None),
    "component_model": (component_model, None),
    "model_importances": (model_importances, None),
    "logistic_model": (logistic_model, None),
    "fusion_model": (fusion_model, None),
    "cross_validation": (cross_validation, None),
}
