"""Queries over controlled changes of features, addresses and pages, and over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.functions import fixed, urls
from wardline.operators import augment, models, pages, robustness, scoring, summaries
from wardline.plans import data_queries
from wardline.plans.url_queries import BANKS, FEATURE_SQL, VERDICT_SQL, pages_of, table
from wardline.sources import pull
from wardline.sources.elements import page_elements
from wardline.sources.readers import spread
from wardline.sources.shared import cut, shared_dir
from wardline.streaming import collect, streams

MOVED = ["url_length", "domain_entropy", "digit_ratio", "brand_impersonation_score", "suspicious_keywords", "sub_domain_count"]


def features(spark, sf_dir):
    return urls.url_features(pages_of(spark, sf_dir)).withColumn("label", (F.col("page_id") % 2).cast("int"))


def page_score(df):
    return F.col("url_length") / 200 + F.col("domain_entropy") / 10 + F.col("brand_impersonation_score") / 10 - F.col("digit_ratio")


def moved_features(spark, sf_dir):
    return robustness.perturb_features(features(spark, sf_dir).select("page_id", *MOVED), MOVED, key="page_id").groupBy("changed_feature", "changed_by").agg(*(F.round(F.sum(c), 3).alias(c) for c in MOVED))


def only_target_moved(spark, sf_dir):
    df = features(spark, sf_dir).select("page_id", *MOVED)
    return robustness.only_target_moved(robustness.perturb_features(df, MOVED, key="page_id"), df, MOVED, "page_id").select("changed_feature", "changed_by", "others_moved", F.round("mean_shift", 4).alias("mean_shift"))


def fragility(spark, sf_dir):
    return robustness.feature_fragility(features(spark, sf_dir).select("page_id", "label", *MOVED), MOVED, page_score, 0.62)


def fragility_ranking(spark, sf_dir):
    return summaries.extremes(robustness.fragility_ranking(fragility(spark, sf_dir)), "worst_drop", "changed_feature", 3)


def scored(df):
    return scoring.scan_urls(df).select("page_id", "risk_score", "verdict", *(["perturbation"] if "perturbation" in df.columns else []))


def url_outcomes(spark, sf_dir):
    df = pages_of(spark, sf_dir)
    return robustness.outcome_summary(robustness.paired_outcomes(scored(df), scored(robustness.perturb_urls(df)), "page_id", 25))


def changed_addresses(spark, sf_dir):
    return robustness.perturb_urls(pages_of(spark, sf_dir)).select("page_id", "perturbation", "url")


def page_outcomes(spark, sf_dir):
    """Pages are read and analysed once; only scores are kept to pair clean and changed ones."""
    elements = page_elements(spread(table(spark, sf_dir, "pages")))
    kept = urls.rule_url_score(urls.url_features(elements)).select("page_id", "url", "html_available", "structural_score", "brand_impersonation_score", "elements")
    df = scoring.rule_page_score(robustness.changed_page_features(kept, clean=True, banks=BANKS))
    df = df.withColumn("risk_score", scoring.fuse_by_points(F.col("structural_score"), F.col("semantic_score"), F.col("html_available")))
    scores = cut(df.select("page_id", "perturbation", "risk_score", scoring.verdict(F.col("risk_score")).alias("verdict")))
    clean, changed = (scores.where(F.col("perturbation").eqNullSafe(robustness.CLEAN) == own) for own in (True, False))
    return robustness.outcome_summary(robustness.paired_outcomes(clean, changed, "page_id", 15))


def second_score(df):
    """Another detector over the same features: more points for subdomains and telling paths."""
    out = urls.rule_url_score(urls.url_features(df))
    score = F.least(F.col("structural_score") + 5 * F.col("sub_domain_count") + 10 * F.col("has_redirect_param"), F.lit(100))
    return out.withColumn("risk_score", score).withColumn("verdict", scoring.verdict(F.col("risk_score"))).select("page_id", "risk_score", "verdict", *(["perturbation"] if "perturbation" in df.columns else []))


def model_comparison(spark, sf_dir):
    df = pages_of(spark, sf_dir)
    moved = robustness.perturb_urls(df)
    outcomes = {name: robustness.paired_outcomes(score(df), score(moved), "page_id", 25) for name, score in (("first", scored), ("second", second_score))}
    return robustness.model_comparison(outcomes)


def fit_addresses(rows):
    """A logistic model over the 32 features of an address, as a function that scores rows."""
    columns = list(fixed.URL_FEATURES)
    model = models.fit_logistic(cut(urls.url_features(rows).select("label", *columns)), columns, prefix="address")

    def score(df):
        out = model.transform(urls.url_features(df)).withColumn("risk_score", F.round(100 * models.probability("address")))
        return out.select(*df.columns, "risk_score", scoring.verdict(F.col("risk_score")).alias("verdict"))

    return score


def addresses(spark, sf_dir):
    """Training and test rows of addresses, halves by a hash; positive is what has a query or fragment."""
    df = pages_of(spark, sf_dir).withColumn("label", F.coalesce(F.col("url").rlike("[?#]"), F.lit(False)).cast("int"))
    half = F.pmod(F.xxhash64("page_id"), F.lit(2))
    return df.where(half == 0), df.where(half == 1)


def retrained_comparison(spark, sf_dir):
    train, test = addresses(spark, sf_dir)
    return augment.retrained_outcomes(train, test, fit_addresses, list(robustness.URL_CHANGES), "page_id")


def page_change_validity(spark, sf_dir):
    moved = robustness.changed_page_features(page_elements(spread(table(spark, sf_dir, "pages"))), banks={})
    return moved.groupBy("perturbation").agg(F.count(F.lit(1)).alias("pages"), F.count_if("valid").alias("valid"), F.sum("length_change").alias("length_change"), F.sum("steps").alias("steps"))


def changed_training_rows(spark, sf_dir):
    df = pages_of(spark, sf_dir).withColumn("label", (F.col("page_id") % 2).cast("int"))
    return augment.changed_copies(df, "page_id", list(robustness.URL_CHANGES)).select("page_id", "source_id", "perturbation", "url")


def one_changed_row(spark, sf_dir):
    df = pages_of(spark, sf_dir).withColumn("label", (F.col("page_id") % 2).cast("int"))
    return augment.one_changed_copy(df, "page_id", list(robustness.URL_CHANGES)).select("page_id", "source_id", "perturbation", "url")


def suspicious_alignment(spark, sf_dir):
    df = scoring.scan_urls(pages_of(spark, sf_dir))
    return df.select("page_id", scoring.alignment(F.col("risk_score") + 40, (F.col("page_id") % 10) / 10).alias("structural_semantic_alignment"))


HYBRID = ("url_length", "hostname_length", "domain_entropy", "sub_domain_count", "text_length", "external_links", "scripts", "iframes")


def hybrid_model(spark, sf_dir):
    """A model over URL and page features together, fitted on four fifths of the pages (label: a digit in the path) and used in a scan of all."""
    df = table(spark, sf_dir, "pages")
    features_ = cut(urls.url_features(pages.analysed_pages(df)).select("page_id", *HYBRID, F.col("url").rlike("[?#]").cast("int").alias("label")))
    model = models.fit_logistic(features_.where(F.pmod(F.xxhash64("page_id"), F.lit(5)) > 0), list(HYBRID), prefix="hybrid")
    predict = lambda d: model.transform(d).withColumn("model_probability", models.probability("hybrid"))
    return scoring.scan_with_model(df, predict).select("page_id", "model_probability", "structural_score", "risk_score", "verdict")


def feature_blindness(spark, sf_dir):
    elements = page_elements(spread(table(spark, sf_dir, "pages")))
    return robustness.feature_blindness(urls.url_features(pages_of(spark, sf_dir)), urls.url_features(robustness.perturb_pages(elements).drop("elements")), "page_id")


def worst_cases(spark, sf_dir):
    score = lambda df: scoring.scan_urls(df).withColumn("probability", F.col("phishing_probability"))
    return robustness.worst_case_sweep(pages_of(spark, sf_dir), score, key="page_id", target=0.2)


def page_score_of(df):
    """The rules' scores of address and page, fused, as a probability."""
    out = scoring.rule_page_score(urls.rule_url_score(urls.url_features(df)))
    return out.withColumn("probability", F.round((fixed.SHARES[0] * F.col("structural_score") + fixed.SHARES[1] * F.col("semantic_score")) / 100, 6))


def page_worst_cases(spark, sf_dir):
    elements = page_elements(spread(table(spark, sf_dir, "pages")))
    return robustness.page_worst_cases(elements, page_score_of, key="page_id", banks=BANKS, target=0.05)


def search_records(spark, sf_dir):
    df = scoring.scan_urls(pages_of(spark, sf_dir)).select("page_id", F.col("phishing_probability").alias("original_probability"), (F.col("phishing_probability") * 0.5).alias("final_probability"), (F.col("page_id") % 4).cast("int").alias("steps"))
    return robustness.search_outcomes(df, 0.2)


def stream_of(spark, sf_dir, name):
    """A stream over a given table's files, whether the table is a folder or one file."""
    frame = table(spark, sf_dir, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4)
    return files.parquet(f"{sf_dir}/{name}.parquet") if folder else files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def worked_off(spark, stream, mode: str = "append"):
    """What a stream gives once all available files are worked off: a table in the shared folder."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    last = {}

    def keep(batch, _):
        last["frame"] = cut(batch)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return last["frame"] if last else spark.createDataFrame([], stream.schema)


def stream_scores(spark, sf_dir):
    return worked_off(spark, streams.ingest(stream_of(spark, sf_dir, "pages"))).select("page_id", "structural_score")


def stream_distinct(spark, sf_dir):
    return worked_off(spark, streams.dedupe_stream(stream_of(spark, sf_dir, "events").select("user_id", "event_type"), F.concat_ws("/", "user_id", "event_type")))


def stream_counts(spark, sf_dir):
    return worked_off(spark, streams.running_counts(stream_of(spark, sf_dir, "events"), [("low", F.col("value") < 5), ("errors", F.col("event_type") == "error")]), "complete")


def stream_windows(spark, sf_dir):
    out = worked_off(spark, streams.windowed_stream(stream_of(spark, sf_dir, "events"), ["event_type"], "ts", "6 hours", late="31 days"), "complete")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def stream_latest(spark, sf_dir):
    return worked_off(spark, streams.latest_stream(stream_of(spark, sf_dir, "events"), "user_id", "ts", "event_id"), "complete").select("user_id", "event_id")


def stream_quota(spark, sf_dir):
    return worked_off(spark, streams.quota_stream(stream_of(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 25, "event_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def pulled_scores(spark, sf_dir):
    """Pages are published in three parts and pulled by three runs of one stream; the last one finds the publisher's end."""
    root = f"{shared_dir(spark)}/pull-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    part = F.pmod(F.xxhash64("page_id"), F.lit(3))
    for k in range(3):
        pages.where(part == k).write.parquet(f"{root}/in/part-{k}")
        if k == 2:
            pull.end(spark, f"{root}/in")
        stream = streams.ingest(pull.published_stream(spark, f"{root}/in", pages.schema)).select("page_id", "structural_score")
        collect.collect_stream(stream, f"{root}/staging", f"{root}/final", f"{root}/state", lambda _: pull.ended(spark, f"{root}/in"))
    return collect.read_collected(spark, f"{root}/final")


def stream_reuse(spark, sf_dir):
    """The events arrive in files without any order of time, a few at a time; the last one closes the stream."""
    rows, late = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "31 days"
    arrived = f"{shared_dir(spark)}/arrived-{uuid.uuid4().hex}"
    rows.repartition(8, F.xxhash64("event_id")).write.parquet(arrived)
    streams.closing_row(rows, "ts", late).write.mode("append").parquet(arrived)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(arrived)
    return worked_off(spark, streams.ttl_stream(stream, ["user_id", "event_type"], "ts", "event_id", 7200.0, late)).select("event_id", "fresh")


def bound_sql(c: str, share: str) -> str:
    low, high = robustness.bounds(c)
    out = f"{c} * (1 + {share})"
    out = out if low is None else f"greatest({out}, {low}::DOUBLE)"
    return out if high is None else f"least({out}, {high}::DOUBLE)"


CHANGES_SQL = f"WITH {FEATURE_SQL}, k AS (SELECT page_id, CAST(page_id % 2 AS INTEGER) AS label, {', '.join(f'{c}::DOUBLE AS {c}' for c in MOVED)} FROM feat), s AS (SELECT k.*, f AS changed_feature, b::DOUBLE AS changed_by FROM k, (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {b})' for c in MOVED for b in (-0.05, 0.05))}) AS t(f, b)), p AS (SELECT page_id, label, changed_feature, changed_by, {', '.join(f'CASE WHEN changed_feature = {chr(39)}{c}{chr(39)} THEN ' + bound_sql(c, 'changed_by') + f' ELSE {c} END AS {c}' for c in MOVED)} FROM s)"

URL_PARTS = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def encoded_sql(part: str) -> str:
    first = f"regexp_extract({part}, '[A-Za-z0-9]', 0)"
    return f"regexp_extract({part}, '^[^A-Za-z0-9]*', 0) || '%' || lpad(hex({first}), 2, '0') || regexp_extract({part}, '^[^A-Za-z0-9]*[A-Za-z0-9](.*)$', 1)"


def plainer_sql(part: str) -> str:
    for old, new in robustness.PLAINER.items():
        part = f"replace({part}, '{old}', '{new}')"
    return part


def parameter_sql(pair: str) -> str:
    return f"CASE WHEN query <> '' THEN query || '&{pair}' ELSE '{pair}' END"


WORD = "'[A-Za-z0-9]'"
#: name -> (path, query, fragment, whether the change applies)
URL_CHANGE_SQL = {
    "url_display_parameter": ("path", parameter_sql("display=compact"), "fragment", "true"),
    "url_tracking_parameter": ("path", parameter_sql("tracking_id_0=abc123"), "fragment", "true"),
    "url_fragment": ("path", "query", "'section_0'", "fragment = ''"),
    "url_plainer_words": (plainer_sql("path"), plainer_sql("query"), "fragment", "true"),
    "url_percent_encoding": (
        f"CASE WHEN regexp_matches(path, {WORD}) THEN {encoded_sql('path')} WHEN regexp_matches(query, {WORD}) THEN path ELSE '/%2F' END",
        f"CASE WHEN NOT regexp_matches(path, {WORD}) AND regexp_matches(query, {WORD}) THEN {encoded_sql('query')} ELSE query END",
        "fragment", f"regexp_matches(path, {WORD}) OR regexp_matches(query, {WORD}) OR (path IN ('', '/') AND query = '')",
    ),
}
CHANGED_URLS_SQL = f"""parts AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+:)?(//[^/?#]*)?', 0) AS head, regexp_extract(url, {URL_PARTS}, 3) AS path, regexp_extract(url, {URL_PARTS}, 4) AS query, regexp_extract(url, {URL_PARTS}, 5) AS fragment FROM pages WHERE url IS NOT NULL),
edited AS ({" UNION ALL ".join(f"SELECT page_id, {k} AS k, '{name}' AS perturbation, head, {p} AS path, {x} AS query, {f} AS fragment FROM parts WHERE {cond}" for k, (name, (p, x, f, cond)) in enumerate(URL_CHANGE_SQL.items(), 1))}),
changed AS (SELECT page_id, k, perturbation, head || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS url FROM edited)"""
#: Pages and changed pages through the same feature SQL: page_id * 10 is the page, page_id * 10 + k its change k.
URL_OUTCOMES_SQL = f"""WITH {CHANGED_URLS_SQL}, chg AS (SELECT page_id * 10 AS page_id, url FROM pages UNION ALL SELECT page_id * 10 + k, url FROM changed), {FEATURE_SQL.replace("FROM pages)", "FROM chg)")},
o AS (SELECT c.perturbation, x.points AS before, y.points AS after FROM changed c JOIN pts x ON x.page_id = c.page_id * 10 JOIN pts y ON y.page_id = c.page_id * 10 + c.k),
v AS (SELECT *, {VERDICT_SQL.replace("points", "before")} AS vb, {VERDICT_SQL.replace("points", "after")} AS va FROM o),
g AS (SELECT perturbation, count(*) AS samples, count(*) FILTER (before >= 25) AS clean_detected, count(*) FILTER (before >= 25 AND after < 25) AS evasions, count(*) FILTER (vb <> va) AS verdict_changes, round(avg(after - before), 4) AS mean_change, round(avg(CAST(after >= 60 AS DOUBLE)), 6) AS recall_after FROM v GROUP BY perturbation)
SELECT *, coalesce(round(evasions::DOUBLE / nullif(clean_detected, 0), 4), 0) AS evasion_rate, round(2 * recall_after / (1 + recall_after), 4) AS recall_derived_f1 FROM g"""


def rate_sql(a: str, b: str) -> str:
    return f"coalesce(round(({a})::DOUBLE / nullif({b}, 0), 4), 0)"


RATES_SQL = {
    "accuracy": ("tp + tn", "tp + tn + fp + fn"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"),
    "fpr": ("fp", "fp + tn"), "fnr": ("fn", "fn + tp"), "detection_rate": ("tp", "tp + fn"),
}
POINTS_SQL = "url_length / 200::DOUBLE + domain_entropy / 10::DOUBLE + brand_impersonation_score / 10::DOUBLE - digit_ratio"
COUNTS_SQL = "count(*) FILTER (s < 0.62::DOUBLE AND label = 0) AS tn, count(*) FILTER (s >= 0.62::DOUBLE AND label = 0) AS fp, count(*) FILTER (s < 0.62::DOUBLE AND label = 1) AS fn, count(*) FILTER (s >= 0.62::DOUBLE AND label = 1) AS tp"
AREA_SQL = "round(avg(CASE WHEN a.s > b.s THEN 1::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0::DOUBLE END), 6)"
FRAGILITY_SQL = f"""{CHANGES_SQL}, scored AS (SELECT *, {POINTS_SQL} AS s FROM p), plain AS (SELECT *, {POINTS_SQL} AS s FROM k),
counted AS (SELECT changed_feature, changed_by, {COUNTS_SQL} FROM scored GROUP BY 1, 2), counted_plain AS (SELECT {COUNTS_SQL} FROM plain),
base AS (SELECT {rate_sql(*RATES_SQL["f1"])} AS f1_before, {rate_sql(*RATES_SQL["accuracy"])} AS accuracy_before FROM counted_plain),
area AS (SELECT a.changed_feature, a.changed_by, {AREA_SQL} AS roc_auc FROM scored a JOIN scored b ON a.changed_feature = b.changed_feature AND a.changed_by = b.changed_by AND a.label = 1 AND b.label = 0 GROUP BY 1, 2),
area_before AS (SELECT {AREA_SQL} AS roc_auc_before FROM plain a JOIN plain b ON a.label = 1 AND b.label = 0),
together AS (SELECT counted.*, {", ".join(f"{rate_sql(*v)} AS {k}" for k, v in RATES_SQL.items())}, f1_before, accuracy_before, roc_auc, roc_auc_before FROM counted, base, area_before, area WHERE area.changed_feature = counted.changed_feature AND area.changed_by = counted.changed_by),
drops AS (SELECT *, round(f1_before - f1, 4) AS f1_drop, round(accuracy_before - accuracy, 4) AS accuracy_drop, round(roc_auc_before - roc_auc, 6) AS roc_auc_drop FROM together)"""
RANKING_SQL = f"""{FRAGILITY_SQL}, rank AS (SELECT changed_feature, max(f1_drop) AS worst_drop, round(avg(f1_drop), 6) AS mean_drop FROM drops GROUP BY 1)
(SELECT *, 'largest' AS "end" FROM rank ORDER BY worst_drop DESC, changed_feature LIMIT 3) UNION ALL (SELECT *, 'smallest' FROM rank ORDER BY worst_drop, changed_feature LIMIT 3)"""

SCORES_SQL = f"WITH {FEATURE_SQL} SELECT page_id, points AS structural_score FROM pts JOIN pages USING (page_id) WHERE length(pages.url) >= 8 AND length(html) >= 200"

QUERIES = {
    "perturb_features": (moved_features, f"{CHANGES_SQL} SELECT changed_feature, changed_by, {', '.join(f'round(sum({c}), 3) AS {c}' for c in MOVED)} FROM p GROUP BY 1, 2"),
    "only_target_moved": (only_target_moved, f"{CHANGES_SQL} SELECT p.changed_feature, p.changed_by, 0 AS others_moved, round(avg(CASE p.changed_feature {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN CASE WHEN k.{c} <> 0 THEN (p.{c} - k.{c}) / k.{c} END' for c in MOVED)} END), 4) AS mean_shift FROM p JOIN k USING (page_id) GROUP BY 1, 2"),
    "feature_fragility": (fragility, f"{FRAGILITY_SQL} SELECT * FROM drops"),
    "fragility_ranking": (fragility_ranking, RANKING_SQL),
    "url_change_outcomes": (url_outcomes, URL_OUTCOMES_SQL),
    "changed_addresses": (changed_addresses, f"WITH {CHANGED_URLS_SQL} SELECT page_id, perturbation, url FROM changed"),
    "page_change_outcomes": (page_outcomes, None),
    "model_comparison": (model_comparison, f"""{URL_OUTCOMES_SQL.split("o AS (SELECT")[0]}
second AS (SELECT *, least(points + 5 * sub_domain_count + 10 * has_redirect_param, 100) AS more FROM pts), judged AS (SELECT 'first' AS model, page_id, points FROM pts UNION ALL SELECT 'second', page_id, more FROM second),
o AS (SELECT x.model, c.perturbation, x.points AS before, y.points AS after FROM changed c JOIN judged x ON x.page_id = c.page_id * 10 JOIN judged y ON y.page_id = c.page_id * 10 + c.k AND x.model = y.model),
v AS{URL_OUTCOMES_SQL.split("v AS")[1].replace("SELECT perturbation, count", "SELECT model, perturbation, count").replace("GROUP BY perturbation", "GROUP BY model, perturbation")}"""),
    "page_change_validity": (page_change_validity, None),
    "retrained_comparison": (retrained_comparison, None),
    "changed_training_rows": (changed_training_rows, f"WITH {CHANGED_URLS_SQL} SELECT page_id || '__' || perturbation AS page_id, page_id AS source_id, perturbation, url FROM changed WHERE page_id % 2 = 1"),
    "one_changed_row": (one_changed_row, f"WITH {CHANGED_URLS_SQL}, dealt AS (SELECT page_id AS id, (row_number() OVER (ORDER BY page_id) - 1) % 5 + 1 AS turn FROM pages WHERE page_id % 2 = 1) SELECT page_id || '__' || perturbation AS page_id, page_id AS source_id, perturbation, url FROM changed JOIN dealt ON id = page_id AND turn = k"),
    "structural_semantic_alignment": (suspicious_alignment, f"WITH {FEATURE_SQL} SELECT page_id, CAST(points + 40 > 50 AND page_id % 10 > 5 AS INTEGER) AS structural_semantic_alignment FROM pts"),
    "hybrid_model": (hybrid_model, None),
    "feature_blindness": (feature_blindness, " UNION ALL ".join(f"SELECT '{n}' AS perturbation, count(*) AS rows, 0 AS values_changed FROM pages" for n in robustness.PAGE_CHANGES)),
    "worst_cases": (worst_cases, None),
    "page_worst_cases": (page_worst_cases, None),
    "search_records": (search_records, f"WITH {FEATURE_SQL}, o AS (SELECT page_id, round(points / 100.0::DOUBLE, 4) AS original_probability, round(points / 100.0::DOUBLE, 4) * 0.5::DOUBLE AS final_probability, CAST(page_id % 4 AS INTEGER) AS steps FROM pts) SELECT *, final_probability < 0.2 AS success, round(original_probability - final_probability, 6) AS reduction, coalesce(round((original_probability - final_probability) / nullif(original_probability, 0), 6), 0) AS relative_reduction, round(final_probability + 0.005::DOUBLE * steps, 6) AS objective FROM o"),
    "stream_scores": (stream_scores, SCORES_SQL),
    "pulled_scores": (pulled_scores, SCORES_SQL),
    "stream_distinct": (stream_distinct, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_counts": (stream_counts, "SELECT CASE WHEN value < 5 THEN 'low' WHEN event_type = 'error' THEN 'errors' ELSE 'accepted' END AS reason, count(*) AS n FROM events GROUP BY 1"),
    "stream_windows": (stream_windows, "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_latest": (stream_latest, "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "stream_quota": (stream_quota, "SELECT event_type, least(count(*), 25) AS n FROM events GROUP BY event_type"),
    "stream_reuse": (stream_reuse, data_queries.QUERIES["ttl_reuse"][1]),
}
