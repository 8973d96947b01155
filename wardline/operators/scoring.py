"""Page scores, fused scores, verdicts, reasons and whole scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.functions.urls import evidence_list, netloc, normalised, rule_url_score, score_of, typo_flag, url_evidence, url_features, url_parts, url_reasons
from wardline.operators.pages import analysed_pages, page_evidence, page_reasons

NOTE = {
    True: "Webpage could not be fetched — decision based primarily on URL structure.",
    False: "Webpage could not be fetched — URL structure was analysed only.",
}


def step(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)


def rule_page_score(df: DataFrame, weights=None, limits=None, name: str = "semantic_score") -> DataFrame:
    """Additive page score, 0 to 100; df has page features, has_external_form_action and brand_impersonation_score."""
    w, at, c = weights or fixed.PAGE_WEIGHTS, limits or fixed.PAGE_LIMITS, F.col
    urgency, login = c("urgency_indicators"), c("login_indicators")
    points = (
        step(c("password_fields") > 0, w["password_field"]) + step(c("has_external_form_action"), w["external_form_action"])
        + step((c("forms") > 0) & (c("credential_indicators") >= at["credential"]), w["credential_form"])
        + F.when(urgency >= at["urgency_high"], w["urgency"]).when(urgency >= at["urgency_any"], w["urgency"] // 2).otherwise(0)
        + step(c("payment_indicators") >= at["payment"], w["payment"])
        + F.when(login >= at["login_high"], w["login_high"]).when(login >= at["login_some"], w["login_some"]).otherwise(0)
        + step((c("brand_indicators") > 0) & (c("brand_impersonation_score") >= 0.5), w["brand_mismatch"])
        + step(c("iframes") > 0, w["iframe"]) + step(c("external_links") >= at["external_links"], w["external_links"])
    )
    return df.withColumn(name, F.least(F.greatest(points, F.lit(0)), F.lit(100)))


def verdict(score: Column, safe_max=fixed.SAFE_MAX, phishing_min=fixed.PHISHING_MIN) -> Column:
    return F.when(score >= phishing_min, "PHISHING").when(score >= safe_max, "SUSPICIOUS").otherwise("SAFE")


def fuse(df: DataFrame, mode: str = "rule", shares=fixed.SHARES, coefficients=None, available: str = "html_available") -> DataFrame:
    """df with risk_score and fusion_mode.

    rule and weighted: a weighted mean of both scores. learned: a logistic curve over both probabilities
    (phishing_probability, page_probability) with coefficients a, b, c. Without a page, the URL decides.
    """
    if mode == "learned":
        a, b, c = coefficients
        fused = 100 / (1 + F.exp(-(a * F.col("phishing_probability") + b * F.col("page_probability") + c)))
    elif mode in ("rule", "weighted"):
        fused = shares[0] * F.col("structural_score") + shares[1] * F.col("semantic_score")
    else:
        raise ValueError(f"fusion mode {mode!r}: one of rule, weighted, learned")
    has = F.coalesce(F.col(available).cast("boolean"), F.lit(False))
    return df.withColumn("risk_score", score_of(F.when(has, fused).otherwise(F.col("structural_score")) / 100)).withColumn("fusion_mode", F.when(has, "combined").otherwise("structural_only"))


def fuse_by_points(score: Column, page_score: Column, has: Column, shares=fixed.SHARES) -> Column:
    return F.least(F.greatest(F.rint(F.when(has, shares[0] * score + shares[1] * page_score).otherwise(score)), F.lit(0)), F.lit(100)).cast("int")


def verdict_by_table(df: DataFrame, limits: DataFrame, score: str = "risk_score") -> DataFrame:
    """Verdicts from a one-row table of calibrated safe_max and phishing_min."""
    return df.crossJoin(F.broadcast(limits.select("safe_max", "phishing_min").limit(1))).withColumn("verdict", verdict(F.col(score), F.col("safe_max"), F.col("phishing_min"))).drop("safe_max", "phishing_min")


def assembled_reasons(df: DataFrame, first: str = "structural_evidence", second: str = "semantic_evidence", available: str = "html_available", name: str = "reasons") -> DataFrame:
    """URL reasons, page reasons where there is a page, else a note that depends on whether anything was said."""
    has = F.coalesce(F.col(available).cast("boolean"), F.lit(False))
    none = F.array().cast("array<string>")
    page = F.when(has, F.coalesce(F.col(second), none)).otherwise(none)
    note = evidence_list((~has & (F.size(first) > 0), NOTE[True]), (~has & (F.size(first) == 0), NOTE[False]))
    return df.withColumn(name, F.concat(F.col(first), page, note))


def scan(pages: DataFrame, url_col: str = "url", html_col: str = "html", safe_max=fixed.SAFE_MAX, phishing_min=fixed.PHISHING_MIN, banks=None, reasons: str = "evidence") -> DataFrame:
    """The whole scan by rules: URL and page features, both scores, fused score, verdict and reasons.

    Result columns: those of pages without html, scores, fusion_mode, verdict, features and
    page_features (structs), structural_evidence, semantic_evidence and reasons (lists).
    """
    df = pages.withColumn(url_col, normalised(F.coalesce(F.col(url_col), F.lit(""))))
    df = rule_url_score(url_evidence(url_features(analysed_pages(df, url_col, html_col, banks=banks), url_col)))
    df = page_evidence(rule_page_score(df), url_col)
    if reasons == "derived":
        df = page_reasons(url_reasons(df, "structural_evidence"), "semantic_evidence")
    df = df.withColumn("risk_score", fuse_by_points(F.col("structural_score"), F.col("semantic_score"), F.col("html_available"))).withColumn("fusion_mode", F.when(F.col("html_available"), "combined").otherwise("structural_only"))
    df = assembled_reasons(df).withColumn("verdict", verdict(F.col("risk_score"), safe_max, phishing_min))
    page_cols = ["page_title", "text_length", "password_fields", "text_email_fields", "forms", "form_actions", "external_links", "iframes", "scripts", "login_indicators", "credential_indicators", "payment_indicators", "urgency_indicators", "brand_indicators"]
    keep = [c for c in pages.columns if c != html_col]
    return df.select(*keep, "html_available", "struct_ok", "phishing_probability", "structural_score", "semantic_score", "risk_score", "fusion_mode", "verdict", F.struct(*fixed.URL_FEATURES).alias("features"), F.struct(*page_cols).alias("page_features"), "structural_evidence", "semantic_evidence", "reasons")


def scan_urls(df: DataFrame, url_col: str = "url", safe_max=fixed.SAFE_MAX, phishing_min=fixed.PHISHING_MIN) -> DataFrame:
    """The scan without pages: risk_score is the URL's score."""
    out = rule_url_score(url_features(df, url_col))
    return out.withColumn("risk_score", F.col("structural_score")).withColumn("verdict", verdict(F.col("risk_score"), safe_max, phishing_min))


# What a form's target is reported as.
FORM_ELSEWHERE = "Credential Harvesting: Form submits to '%s'"
FORM_RAW_IP = "Form action targets raw IP address"


def form_target_flags(elements: DataFrame, url_col: str = "url", name: str = "suspicious_forms", flags: str = "form_flags") -> DataFrame:
    """elements with the flags of every form's action as written, in order, and whether there is any: sent to another host than the page's, or to a raw IP address."""
    own = netloc(normalised(F.coalesce(F.col(url_col), F.lit(""))))
    actions = F.filter(F.transform(F.filter("elements", lambda e: e["tag"] == "form"), lambda e: F.coalesce(F.try_element_at(e["attrs"], F.lit("action")), F.lit(""))), lambda a: a != "")

    def of_action(a: Column) -> Column:
        host = netloc(a)
        elsewhere = F.when((host != "") & (host != own), F.array(F.format_string(FORM_ELSEWHERE, host)))
        raw_ip = F.when(a.rlike(r"^https?://[0-9]{1,3}(\.[0-9]{1,3}){3}"), F.array(F.lit(FORM_RAW_IP)))
        none = F.array().cast("array<string>")
        return F.concat(F.coalesce(elsewhere, none), F.coalesce(raw_ip, none))

    out = elements.withColumn(flags, F.coalesce(F.flatten(F.transform(actions, of_action)), F.array().cast("array<string>")))
    return out.withColumn(name, F.size(flags) > 0)


def alignment(score: Column, page_probability: Column) -> Column:
    """1 where both the URL's score (above 50) and the page's probability (above one half) are suspicious."""
    return F.coalesce((score > 50) & (page_probability > 0.5), F.lit(False)).cast("int")


def scan_with_model(pages: DataFrame, model, url_col: str = "url", html_col: str = "html", coefficients=None, probability: str = "model_probability", safe_max=fixed.SAFE_MAX, phishing_min=fixed.PHISHING_MIN) -> DataFrame:
    """The scan of a table of pages whose page score is a model's: model(features) adds `probability` to URL and page features.

    With coefficients both probabilities are fused by the learned curve, else by shares of the scores.
    """
    df = analysed_pages(pages.withColumn(url_col, normalised(F.coalesce(F.col(url_col), F.lit("")))), url_col, html_col)
    df = model(rule_url_score(url_features(df, url_col))).withColumn("semantic_score", score_of(F.col(probability))).withColumn("page_probability", F.col(probability))
    fused = fuse(df, "learned" if coefficients else "rule", coefficients=coefficients)
    return fused.withColumn("verdict", verdict(F.col("risk_score"), safe_max, phishing_min))


def threat_score(df: DataFrame, url_col: str = "url", model_probability: str | None = None, form_flags: str | None = None) -> DataFrame:
    """Basic score: near-brand domain 40, plain http 20, suspicious form 40; with a model 0.7 of it, cut to whole points."""
    out = url_parts(df, url_col)
    near, plain = typo_flag(F.col("u.base_domain")), F.col("u.address").startswith("http://")
    forms = F.col(form_flags) if form_flags else F.lit(False)
    rules = F.least(step(near.isNotNull(), 40) + step(plain, 20) + step(forms, 40), F.lit(100))
    both = rules if model_probability is None else F.least(F.floor(0.7 * F.floor(F.col(model_probability) * 100) + 0.3 * rules), F.lit(100))
    return out.withColumns({"near_brand": near, "plain_http": plain, "rule_points": rules, "threat": both.cast("int")}).withColumn("threat_verdict", verdict(F.col("threat"))).withColumn("is_dangerous", F.col("threat") >= 50).drop("u")


def expected_matrix(scans: DataFrame, expected: DataFrame, key: str = "url") -> DataFrame:
    """By category: how many expected verdicts were met. expected: key, category, expected.

    Each expected row counts once, however many scans its key has: it is met if all their verdicts are the
    expected one, and missing if no scan gave any.
    """
    found = scans.groupBy(key).agg(F.min("verdict").alias("_least"), F.max("verdict").alias("_most"))
    met = (F.col("_least") == F.col("expected")) & (F.col("_most") == F.col("expected"))
    return expected.join(found, key, "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(met).alias("matched"), F.count_if(F.col("_least").isNull()).alias("missing"))


def scan_summary(scans: DataFrame, score: str = "risk_score") -> DataFrame:
    """Verdict counts; rows without a score count as failed, with score -1."""
    filled = scans.select(F.coalesce("verdict", F.lit("FAILED")).alias("verdict"), F.coalesce(F.col(score), F.lit(-1)).alias("score"))
    return filled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("score").alias("least_score"), F.max("score").alias("largest_score"))
