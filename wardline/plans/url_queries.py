"""Queries over URLs and pages, with DuckDB SQL that says the same in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import fixed, phrases, urls
from wardline.operators import pages, scoring, summaries
from wardline.sources.elements import exploded, page_elements
from wardline.sources.readers import spread

FEATURES = list(fixed.URL_FEATURES)
#: Frequent words of the given tables stand in for the phrase banks there; the real banks are tested on small pages.
BANKS = {"login": ("the", "and"), "credential": ("of",), "payment": ("der", "und"), "urgency": ("les", "que"), "brand": ("token", "of the")}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def hits_sql(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {q(w)}) AS INTEGER)" for w in words) + ")"


RISK_SQL = "CASE " + " ".join(f"WHEN ends_with(host, {q(e)}) THEN {r}::DOUBLE" for e, r in sorted(fixed.ENDING_RISK.items(), key=lambda x: -len(x[0]))) + f" ELSE {fixed.OTHER_RISK}::DOUBLE END"
BRAND_LIST = "[" + ", ".join(map(q, fixed.BRANDS)) + "]"

PARTS_SQL = r"""
a AS (SELECT page_id, url, CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'http://' || trim(url) END AS address FROM pages),
b AS (SELECT *, regexp_extract(address, '^[^:/?#]+://([^/?#]*)', 1) AS netloc, regexp_replace(regexp_extract(address, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
  regexp_extract(address, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(address, '^[^#]*#(.*)$', 1) AS fragment FROM a),
c AS (SELECT *, lower(regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1)) AS host, regexp_extract(regexp_replace(netloc, '^.*@', ''), '^[^:]*:(.*)$', 1) AS port FROM b),
d AS (SELECT *, string_split(host, '.') AS labels FROM c),
u AS (SELECT *, CASE WHEN len(labels) >= 2 THEN labels[-2] || '.' || labels[-1] ELSE host END AS base, CASE WHEN len(labels) > 2 THEN labels[1:len(labels) - 2] ELSE [] END AS subs FROM d)"""

FEATURE_SQL = rf"""{PARTS_SQL},
near AS (SELECT page_id, list_transform({BRAND_LIST}, lambda x: levenshtein(base, x)) AS dist, list_transform({BRAND_LIST}, lambda x: greatest(length(base), length(x))) AS most,
  list_transform({BRAND_LIST}, lambda x: contains(base, split_part(x, '.', 1)) AND base <> split_part(x, '.', 1)) AS inside FROM u),
best AS (SELECT *, list_min(dist) AS least_dist, list_position(dist, list_min(dist)) AS idx FROM near),
ent AS (SELECT page_id, -sum(n / t * log2(n / t)) AS bits FROM (SELECT page_id, ch, count(*)::DOUBLE AS n, any_value(length(host))::DOUBLE AS t FROM (SELECT page_id, host, unnest(string_split(host, '')) AS ch FROM u) GROUP BY page_id, ch) GROUP BY page_id),
feat AS (SELECT u.page_id, u.url, length(address) AS url_length, length(host) AS hostname_length, length(path) AS path_length, length(query) AS query_length,
  len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS url_depth, CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS num_params,
  CAST(regexp_matches(host, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') AS INTEGER) AS has_ip, CAST(contains(address, '@') AS INTEGER) AS has_at,
  CAST(port <> '' AND port NOT IN ('0', '80', '443') AS INTEGER) AS has_port, CAST(contains(path, '//') AS INTEGER) AS double_slash, CAST(contains(host, '-') AS INTEGER) AS prefix_suffix,
  greatest(0, len(labels) - 2) AS sub_domain_count, CAST(len(labels) >= 5 AS INTEGER) AS excessive_dots, CAST(len(list_filter(subs, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0 AS INTEGER) AS numeric_subdomain,
  CAST(contains(host, 'xn--') AS INTEGER) AS punycode_present, CAST(contains(host, 'https') AND NOT starts_with(host, 'https') AS INTEGER) AS https_token,
  CAST({" OR ".join(f"host = {q(s)} OR ends_with(host, {q('.' + s)})" for s in fixed.SHORTENERS)} AS INTEGER) AS is_shortening, {RISK_SQL} AS tld_risk_score,
  CAST({any_sql("lower(query)", fixed.REDIRECT_WORDS)} AS INTEGER) AS has_redirect_param, CAST(regexp_matches(lower(path), '\.[\p{{L}}\p{{N}}_]{{2,4}}\.[\p{{L}}\p{{N}}_]{{2,4}}($|\?)') AS INTEGER) AS double_extension,
  CAST(regexp_matches(host, '%[0-9a-f]{{2}}') AS INTEGER) AS hex_encoded, round(bits, 4) AS domain_entropy,
  round(len(regexp_extract_all(address, '[0-9]'))::DOUBLE / length(address), 4) AS digit_ratio, length(address) - length(translate(address, '!$%^&*()+=[]{{}}|;''<>?,', '')) AS special_char_count,
  CASE WHEN len(regexp_extract_all(host, '\p{{L}}')) > 0 THEN round(len(regexp_extract_all(host, '[b-df-hj-np-tv-z]'))::DOUBLE / len(regexp_extract_all(host, '\p{{L}}')), 4) ELSE 0 END AS consonant_ratio,
  coalesce(list_max(list_transform(list_filter(regexp_split_to_array(address, '[./\-_?&=]'), lambda x: regexp_matches(x, '^\p{{L}}+$')), lambda x: length(x))), 0) AS longest_word_length,
  CASE WHEN list_contains({BRAND_LIST}, base) THEN 0 ELSE round(list_max(list_concat(
    list_transform(list_zip(dist, most), lambda x: CASE WHEN 1 - x[1]::DOUBLE / x[2] > 0.6 AND x[1] > 0 THEN 1 - x[1]::DOUBLE / x[2] ELSE 0::DOUBLE END),
    list_transform(inside, lambda x: CASE WHEN x THEN 0.85::DOUBLE ELSE 0::DOUBLE END))), 4) END AS brand_impersonation_score,
  CAST(NOT list_contains({BRAND_LIST}, base) AND {any_sql("array_to_string(subs, '.')", [b.split(".")[0] for b in fixed.BRANDS])} AS INTEGER) AS subdomain_brand_match,
  least({hits_sql("lower(address)", fixed.URL_WORDS)}, 6) AS suspicious_keywords, round(least({hits_sql("lower(path)", fixed.PATH_WORDS)} / 3.0::DOUBLE, 1.0::DOUBLE), 4) AS login_path_score,
  CASE WHEN list_contains({BRAND_LIST}, base) THEN 99 ELSE least_dist END AS levenshtein_min, CASE WHEN list_contains({BRAND_LIST}, base) THEN 1 ELSE round(least_dist::DOUBLE / most[idx], 4) END AS levenshtein_ratio
  FROM u JOIN best USING (page_id) JOIN ent USING (page_id)),
pts AS (SELECT *, least(greatest(20 * has_ip + 20 * has_at + 15 * is_shortening + 15 * punycode_present + CASE WHEN tld_risk_score >= 0.8 THEN 20 ELSE 0 END + CASE WHEN brand_impersonation_score >= 0.7 THEN 25 ELSE 0 END
  + 5 * suspicious_keywords + CASE WHEN levenshtein_min = 1 THEN 20 WHEN levenshtein_min = 2 THEN 10 ELSE 0 END, 0), 100) AS points FROM feat)"""
VERDICT_SQL = "CASE WHEN points >= 60 THEN 'PHISHING' WHEN points >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END"


def url_parts(spark, sf_dir):
    out = urls.url_parts(pages_of(spark, sf_dir))
    return out.select("page_id", *(f"u.{c}" for c in ("address", "netloc", "hostname", "path", "query", "fragment", "port", "base_domain", "root_domain")))


def url_features(spark, sf_dir):
    return urls.url_features(pages_of(spark, sf_dir)).select("page_id", *FEATURES)


def url_scores(spark, sf_dir):
    return scoring.scan_urls(pages_of(spark, sf_dir)).select("page_id", "phishing_probability", "risk_score", "verdict")


def url_verdicts(spark, sf_dir):
    return scoring.scan_urls(pages_of(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("score_sum"))


def url_evidence(spark, sf_dir):
    return urls.url_evidence(urls.url_features(pages_of(spark, sf_dir))).select("page_id", F.array_join("structural_evidence", " ").alias("evidence"))


def url_reasons(spark, sf_dir):
    return urls.url_reasons(urls.url_features(pages_of(spark, sf_dir))).select("page_id", F.array_join("structural_reasons", " ").alias("reasons"))


def scaled_features(spark, sf_dir):
    return urls.scaled_features(urls.url_features(pages_of(spark, sf_dir))).select("page_id", *(f"{f}_scaled" for f in FEATURES))


def feature_labels(spark, sf_dir):
    rows = urls.url_features(pages_of(spark, sf_dir)).select("page_id", F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(v[1]).alias("display_name"), F.col(k).cast("double").alias("value")) for k, v in fixed.URL_FEATURES.items()))))
    return rows.groupBy("feature", "display_name").agg(F.sum("value").alias("total"))


def feature_vectors(spark, sf_dir):
    out = urls.feature_vector(urls.url_features(pages_of(spark, sf_dir)))
    return out.select("page_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def threat_scores(spark, sf_dir):
    return scoring.threat_score(pages_of(spark, sf_dir)).select("page_id", "near_brand", "plain_http", "rule_points", "threat", "threat_verdict", "is_dangerous")


def registered_domains(spark, sf_dir):
    suffixes = urls.url_parts(pages_of(spark, sf_dir)).select(F.element_at("u.labels", -1).alias("suffix")).distinct()
    return urls.registered_domain(pages_of(spark, sf_dir), suffixes).select("page_id", "registered_domain")


def suffix_rules(spark, sf_dir):
    """Rules of one to four labels, wildcards and exceptions, all made from the pages' own hosts."""
    parts = urls.url_parts(pages_of(spark, sf_dir)).where(F.size("u.labels") >= 2)
    hosts = parts.select("page_id", F.col("u.hostname").alias("host"), "u.labels").withColumn("base", F.array_join(F.slice("labels", -2, 2), "."))
    n = F.col("page_id")
    kinds = F.array(F.element_at("labels", -1), F.when(n % 3 == 1, F.concat(F.lit("*."), "base")), F.when(n % 3 == 2, F.col("base")), F.when(n % 6 == 1, F.concat(F.lit("!b."), "host")))
    rules = hosts.select(F.explode(kinds).alias("suffix")).where("suffix IS NOT NULL")
    longer = hosts.select("page_id", F.concat(F.lit("http://a.b."), "host", F.lit("/")).alias("url"))
    return urls.registered_domain(longer, rules).select("page_id", "registered_domain")


def learned_fusion(spark, sf_dir):
    df = scoring.scan_urls(pages_of(spark, sf_dir)).withColumn("page_probability", (F.col("page_id") % 10) / 10.0).withColumn("html_available", F.col("page_id") % 3 > 0)
    return scoring.fuse(df.drop("risk_score"), "learned", coefficients=(4.0, 3.0, -2.5)).select("page_id", "risk_score", "fusion_mode", scoring.verdict(F.col("risk_score"), 15, 50).alias("verdict"))


def verdicts_by_table(spark, sf_dir):
    scored = scoring.scan_urls(pages_of(spark, sf_dir)).drop("verdict")
    limits = scored.agg(F.floor(F.avg("risk_score")).alias("safe_max"), F.max("risk_score").alias("phish_min"))
    return scoring.verdict_by_table(scored, limits.withColumnRenamed("phish_min", "phishing_min")).select("page_id", "risk_score", "verdict")


def scan_pages(spark, sf_dir):
    return scoring.scan(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "html_available", "structural_score", "semantic_score", "risk_score", "fusion_mode", "verdict", "reasons")


def scan_pages_derived(spark, sf_dir):
    return scoring.scan(spread(table(spark, sf_dir, "pages")), banks=BANKS, reasons="derived").select("page_id", "risk_score", "verdict", "features", "page_features", "reasons")


def scan_summary(spark, sf_dir):
    return scoring.scan_summary(scoring.scan_urls(pages_of(spark, sf_dir)).withColumn("risk_score", F.when(F.col("page_id") % 7 > 0, F.col("risk_score"))).withColumn("verdict", F.when(F.col("page_id") % 7 > 0, F.col("verdict"))))


def expected_matrix(spark, sf_dir):
    scans = scoring.scan_urls(pages_of(spark, sf_dir))
    expected = pages_of(spark, sf_dir).select("page_id", F.concat(F.lit("c"), F.col("page_id") % 4).alias("category"), F.lit("SAFE").alias("expected"))
    return scoring.expected_matrix(scans.where("page_id % 5 > 0"), expected, "page_id")  # pages may share an address


def page_counts(spark, sf_dir):
    out = pages.page_features(page_elements(spread(table(spark, sf_dir, "pages"))), banks=BANKS)
    return out.select("page_id", "page_title", "scripts", "forms", "iframes", "password_fields", "text_email_fields", "external_links")


def page_features_full(spark, sf_dir):
    out = pages.context_features(pages.analysed_pages(spread(table(spark, sf_dir, "pages")), banks=BANKS))
    return out.select("page_id", "text_length", *(f"{b}_indicators" for b in BANKS), "trusted_domain", "form_action_same_origin", "domain_brand_consistency", "link_to_form_ratio", "text_to_script_ratio", "credential_density", "brand_context_score")


def page_elements_by_tag(spark, sf_dir):
    rows = exploded(page_elements(spread(table(spark, sf_dir, "pages"))))
    return rows.where("tag IN ('script', 'a', 'article', 'h1', 'li', 'nav', 'title')").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


def login_pages(spark, sf_dir):
    return pages.login_page(page_elements(spread(table(spark, sf_dir, "pages")))).select("page_id", "is_login_page")


def annotated_pages(spark, sf_dir):
    return pages.annotated_text(page_elements(spread(table(spark, sf_dir, "pages")))).select("page_id", "annotated")


def document_phrases(spark, sf_dir):
    low = F.lower(F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", phrases.phrase_counts(low, {b: BANKS[b] for b in ("login", "credential", "payment", "urgency")}).alias("found"))
    return found.select("doc_id", *(F.coalesce(F.col("found")[b], F.lit(0)).alias(b) for b in ("login", "credential", "payment", "urgency")))


def tidied_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(pages.tidy(F.coalesce("text", F.lit("")))).alias("tidy_length"), F.md5(pages.dehyphenated(F.coalesce("text", F.lit("")))).alias("dehyphenated_md5"))


def url_profile(spark, sf_dir):
    return summaries.profile(urls.url_features(pages_of(spark, sf_dir)), ["url_length", "hostname_length", "domain_entropy"])


def words_sql(words) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains([{', '.join(map(q, words))}], x)))"


def told_sql(*items: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items) + "], lambda x: x IS NOT NULL), ' ')"


EVIDENCE_SQL = told_sql(
    ("prefix_suffix > 0", "'Hyphen in domain name — common in phishing domains.'"),
    ("tld_risk_score >= 0.8", "printf('Very high-risk top-level domain (TLD risk score: %.2f).', tld_risk_score)"),
    ("brand_impersonation_score >= 0.7", "printf('Domain closely resembles a known brand (impersonation score: %.2f).', brand_impersonation_score)"),
    ("brand_impersonation_score >= 0.5 AND brand_impersonation_score < 0.7", "printf('Domain shows possible brand similarity (impersonation score: %.2f).', brand_impersonation_score)"),
    ("subdomain_brand_match > 0", "'Known brand name found in subdomain of a different domain.'"),
    ("levenshtein_min BETWEEN 1 AND 2", "printf('Typosquatting detected — domain edit distance %d from a known brand.', levenshtein_min)"),
    ("suspicious_keywords >= 3", "printf('Multiple suspicious keywords in URL (%d found).', suspicious_keywords)"),
    ("suspicious_keywords BETWEEN 1 AND 2", "printf('Suspicious keyword(s) in URL (%d found).', suspicious_keywords)"),
    ("login_path_score >= 0.67", "printf('Login-themed URL path detected (score: %.2f).', login_path_score)"),
    ("sub_domain_count >= 3", "printf('Excessive subdomain nesting (%d levels) — obfuscation technique.', sub_domain_count)"),
    ("url_length > 100", "printf('Unusually long URL (%d chars) — obfuscation technique.', url_length)"),
)
REASONS_SQL = told_sql(
    ("levenshtein_min = 1 AND brand_impersonation_score >= 0.7", "printf('Domain closely resembles a known brand (impersonation score: %.2f, edit distance: %d).', brand_impersonation_score, levenshtein_min)"),
    ("levenshtein_min <> 1 AND brand_impersonation_score >= 0.7", "printf('Domain closely resembles a known brand (impersonation score: %.2f).', brand_impersonation_score)"),
    ("brand_impersonation_score >= 0.5 AND brand_impersonation_score < 0.7", "printf('Domain shows possible brand similarity (impersonation score: %.2f).', brand_impersonation_score)"),
    ("subdomain_brand_match > 0", "'Known brand name embedded in subdomain of a different domain.'"),
    ("suspicious_keywords >= 3", "printf('Multiple suspicious keywords in URL (%d found).', suspicious_keywords)"),
    ("suspicious_keywords BETWEEN 1 AND 2", "printf('Suspicious keyword(s) in URL (%d found).', suspicious_keywords)"),
    ("login_path_score >= 0.67", "printf('Login-themed URL path detected (score: %.2f).', login_path_score)"),
    ("prefix_suffix > 0", "'Hyphen used in domain name — common in phishing domains.'"),
    ("sub_domain_count >= 3", "printf('Excessive subdomain nesting (%d levels) — URL obfuscation.', sub_domain_count)"),
    ("url_length > 100", "printf('Unusually long URL (%d characters) — obfuscation technique.', url_length)"),
)

QUERIES = {
    "url_parts": (url_parts, rf"WITH {PARTS_SQL} SELECT page_id, address, netloc, host AS hostname, path, query, fragment, port, base AS base_domain, regexp_replace(lower(netloc), '^www\.', '') AS root_domain FROM u"),
    "url_features": (url_features, f"WITH {FEATURE_SQL} SELECT page_id, {', '.join(FEATURES)} FROM feat"),
    "url_scores": (url_scores, f"WITH {FEATURE_SQL} SELECT page_id, round(points / 100.0::DOUBLE, 4) AS phishing_probability, points AS risk_score, {VERDICT_SQL} AS verdict FROM pts"),
    "url_verdicts": (url_verdicts, f"WITH {FEATURE_SQL} SELECT {VERDICT_SQL} AS verdict, count(*) AS n, CAST(sum(points) AS BIGINT) AS score_sum FROM pts GROUP BY 1"),
    "url_evidence": (url_evidence, f"WITH {FEATURE_SQL} SELECT page_id, {EVIDENCE_SQL} AS evidence FROM feat"),
    "url_reasons": (url_reasons, f"WITH {FEATURE_SQL} SELECT page_id, {REASONS_SQL} AS reasons FROM feat"),
    "scaled_features": (scaled_features, f"WITH {FEATURE_SQL} SELECT page_id, {', '.join(f'round(least({k} / {float(v[0])}::DOUBLE, 1.0::DOUBLE), 3) AS {k}_scaled' for k, v in fixed.URL_FEATURES.items())} FROM feat"),
    "feature_labels": (feature_labels, f"WITH {FEATURE_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS feature, {q(v[1])} AS display_name, CAST(sum({k}) AS DOUBLE) AS total FROM feat" for k, v in fixed.URL_FEATURES.items())),
    "feature_vectors": (feature_vectors, f"WITH {FEATURE_SQL} SELECT page_id, {len(FEATURES)} AS n, round({' + '.join(f'{k}::DOUBLE' for k in FEATURES)}, 4) AS total FROM feat"),
    "threat_scores": (threat_scores, rf"""WITH {PARTS_SQL}, t AS (SELECT page_id, address, CASE WHEN list_contains({BRAND_LIST}, base) THEN NULL ELSE list_filter({BRAND_LIST}, lambda x: levenshtein(base, x) BETWEEN 1 AND 2)[1] END AS near_brand, starts_with(address, 'http://') AS plain_http FROM u),
      p AS (SELECT page_id, near_brand, plain_http, CASE WHEN near_brand IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN plain_http THEN 20 ELSE 0 END AS points FROM t)
      SELECT page_id, near_brand, plain_http, points AS rule_points, points AS threat, {VERDICT_SQL} AS threat_verdict, points >= 50 AS is_dangerous FROM p"""),
    "registered_domains": (registered_domains, f"WITH {PARTS_SQL} SELECT page_id, CASE WHEN len(labels) >= 2 THEN base ELSE lower(url) END AS registered_domain FROM u"),
    "suffix_rules": (suffix_rules, f"""WITH {PARTS_SQL}, r AS (SELECT page_id, host, labels, base, string_split('a.b.' || host, '.') AS l FROM u WHERE len(labels) >= 2),
      rules AS (SELECT labels[-1] AS rule FROM r UNION SELECT '*.' || base FROM r WHERE page_id % 3 = 1 UNION SELECT base FROM r WHERE page_id % 3 = 2 UNION SELECT '!b.' || host FROM r WHERE page_id % 6 = 1),
      k AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM r),
      t AS (SELECT *, array_to_string(l[len(l) - k + 1:], '.') AS tail, array_to_string(l[len(l) - k + 2:], '.') AS rest FROM k),
      hits AS (SELECT page_id, k FROM t JOIN rules ON rule = tail UNION ALL SELECT page_id, k FROM t JOIN rules ON rule = '*.' || rest
        UNION ALL SELECT page_id, 1000 + k - 1 FROM t JOIN rules ON rule = '!' || tail),
      best AS (SELECT page_id, max(k) % 1000 AS k FROM hits GROUP BY page_id)
      SELECT page_id, CASE WHEN len(l) > k THEN array_to_string(l[len(l) - k:], '.') ELSE lower('http://' || array_to_string(l, '.') || '/') END AS registered_domain FROM r LEFT JOIN best USING (page_id)"""),
    "learned_fusion": (learned_fusion, f"""WITH {FEATURE_SQL}, f AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN round_even(100 / (1 + exp(-(4.0 * (points / 100.0::DOUBLE) + 3.0 * ((page_id % 10) / 10.0::DOUBLE) - 2.5))), 0) ELSE points END AS s, page_id % 3 > 0 AS c FROM pts)
      SELECT page_id, CAST(s AS INTEGER) AS risk_score, CASE WHEN c THEN 'combined' ELSE 'structural_only' END AS fusion_mode, CASE WHEN s >= 50 THEN 'PHISHING' WHEN s >= 15 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM f"""),
    "verdicts_by_table": (verdicts_by_table, f"WITH {FEATURE_SQL}, l AS (SELECT floor(avg(points)) AS a, max(points) AS b FROM pts) SELECT page_id, points AS risk_score, CASE WHEN points >= b THEN 'PHISHING' WHEN points >= a THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM pts, l"),
    "scan_pages": (scan_pages, None),
    "scan_pages_derived": (scan_pages_derived, None),
    "scan_summary": (scan_summary, f"WITH {FEATURE_SQL} SELECT CASE WHEN page_id % 7 = 0 THEN 'FAILED' ELSE {VERDICT_SQL} END AS verdict, count(*) AS n, round(avg(CASE WHEN page_id % 7 = 0 THEN -1 ELSE points END), 4) AS mean_score, min(CASE WHEN page_id % 7 = 0 THEN -1 ELSE points END) AS least_score, max(CASE WHEN page_id % 7 = 0 THEN -1 ELSE points END) AS largest_score FROM pts GROUP BY 1"),
    "expected_matrix": (expected_matrix, f"WITH {FEATURE_SQL} SELECT 'c' || (page_id % 4) AS category, count(*) AS n, count(*) FILTER (page_id % 5 > 0 AND {VERDICT_SQL} = 'SAFE') AS matched, count(*) FILTER (page_id % 5 = 0) AS missing FROM pts GROUP BY 1"),
    "page_counts": (page_counts, r"""SELECT page_id, nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS page_title,
      len(regexp_extract_all(html, '<script[ >]')) AS scripts, len(regexp_extract_all(html, '<form[ >]')) AS forms, len(regexp_extract_all(html, '<iframe[ >]')) AS iframes, 0 AS password_fields, 0 AS text_email_fields, len(regexp_extract_all(html, '<a href="https?://')) AS external_links FROM pages"""),
    "page_features": (page_features_full, None),
    "page_elements_by_tag": (page_elements_by_tag, " UNION ALL ".join(f"SELECT '{t}' AS tag, CAST(sum(len(regexp_extract_all(html, '<{t}[ >]'))) AS BIGINT) AS n, count(*) FILTER (regexp_matches(html, '<{t}[ >]')) AS n_pages FROM pages HAVING n > 0" for t in ("script", "a", "article", "h1", "li", "nav", "title"))),
    "login_pages": (login_pages, None),
    "annotated_pages": (annotated_pages, None),
    "document_phrases": (document_phrases, f"SELECT doc_id, {', '.join(f'{words_sql(BANKS[b])} AS {b}' for b in ('login', 'credential', 'payment', 'urgency'))} FROM documents"),
    "tidied_documents": (tidied_documents, r"""SELECT doc_id, least(5000, length(array_to_string(list_filter(flatten(list_transform(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([a-zA-Z])-([a-zA-Z])', '\1\2', 'g'), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), lambda x: trim(x)), lambda x: string_split(x, '  '))), lambda x: x <> ''), ' '))) AS tidy_length,
      md5(regexp_replace(coalesce(text, ''), '([a-zA-Z])-([a-zA-Z])', '\1\2', 'g')) AS dehyphenated_md5 FROM documents"""),
    "url_profile": (url_profile, f"WITH {FEATURE_SQL}" + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, {', '.join(f'round(quantile_cont({c}::DOUBLE, {p}), 6) AS p{round(p * 100)}' for p in summaries.QUANTILES)}, 0 AS nulls, 0 AS nans, 0 AS infinities FROM feat" for c in ("url_length", "hostname_length", "domain_entropy"))),
}
