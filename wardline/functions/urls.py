"""URL parts and the 32 lexical URL features, as native column expressions.

All of it is narrow projection: built-in levenshtein calls for a list of brands cost less per row than
shuffling rows to share them by domain would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed

PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SPECIAL = "!$%^&*()+=[]{}|;'<>?,"


def normalised(url: Column) -> Column:
    """Trimmed, with http:// before what names neither http nor https."""
    u = F.trim(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("http://"), u))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def any_in(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words), F.lit(0))


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with the struct u: address, netloc, hostname, path, query, fragment, port, labels, base_domain, root_domain, ok.

    ok is false where the port isn't a number up to 65535 or a bracket is missing; null URLs are empty ones.
    """
    address = normalised(F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumn("u", F.struct(address.alias("address"), *(F.regexp_extract(address, PARTS, i).alias(n) for i, n in ((2, "netloc"), (3, "raw_path"), (4, "query"), (5, "fragment")))))
    u = F.col("u")
    after_user = F.regexp_replace(u["netloc"], "^.*@", "")
    bracket = after_user.startswith("[")
    host = F.lower(F.when(bracket, F.regexp_extract(after_user, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(after_user, "^([^:]*)", 1)))
    port = F.when(bracket, F.regexp_extract(after_user, r"^\[[^\]]*\](?::(.*))?$", 1)).otherwise(F.regexp_extract(after_user, "^[^:]*:(.*)$", 1))
    path = F.regexp_replace(u["raw_path"], ";[^/]*$", "")
    df = df.withColumn("u", F.struct(u["address"].alias("address"), u["netloc"].alias("netloc"), host.alias("hostname"), path.alias("path"), u["query"].alias("query"), u["fragment"].alias("fragment"), port.alias("port")))
    labels = F.split(u["hostname"], r"\.")
    port_ok = (u["port"] == "") | (u["port"].rlike("^[0-9]+$") & (F.length(F.ltrim(F.regexp_replace(u["port"], "^0+", ""))) <= 5) & (F.coalesce(u["port"].try_cast("long"), F.lit(0)) <= 65535))
    brackets = u["netloc"].contains("[") == u["netloc"].contains("]")
    base = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(u["hostname"])
    more = [labels.alias("labels"), base.alias("base_domain"), F.regexp_replace(F.lower(u["netloc"]), r"^www\.", "").alias("root_domain"), (port_ok & brackets).alias("ok")]
    return df.withColumn("u", F.struct(*(u[c].alias(c) for c in ("address", "netloc", "hostname", "path", "query", "fragment", "port")), *more))


def entropy(text: Column) -> Column:
    """Shannon bits of the characters."""
    n = F.length(text)
    bits = F.aggregate(
        F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), F.lit(0.0),
        lambda acc, c: acc - (n - F.length(F.replace(text, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(text, c, F.lit("")))) / n),
    )
    return F.when(n > 0, F.round(bits, 4)).otherwise(0.0)


def ending_risk(host: Column, risks: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for ending in sorted(risks, key=len):
        out = F.when(host.endswith(ending), risks[ending]).otherwise(out)
    return out


def url_features(df: DataFrame, url_col: str = "url", brands=fixed.BRANDS, shorteners=fixed.SHORTENERS, risks=None, keep_parts: bool = False) -> DataFrame:
    """df with the 32 URL features and struct_ok; all features are 0 where the URL can't be read."""
    df = url_parts(df, url_col)
    u = F.col("u")
    address, host, path, query, base, labels = (u[c] for c in ("address", "hostname", "path", "query", "base_domain", "labels"))
    subs = F.when(F.size(labels) > 2, F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    risks = fixed.ENDING_RISK if risks is None else risks
    brand = base.isin(*brands) if brands else F.lit(False)
    letters = F.regexp_count(host, F.lit(r"\p{L}"))
    known = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(b.split(".")[0]).alias("name")) for i, b in enumerate(brands)))
    df = df.withColumn("_near", F.transform(known, lambda x: F.struct(
        F.levenshtein(base, x["b"]).alias("d"), x["i"].alias("i"), F.greatest(F.length(base), F.length(x["b"])).alias("n"), (base.contains(x["name"]) & (base != x["name"])).alias("inside"),
    )))
    likeness = F.transform("_near", lambda x: F.greatest(F.when((x["d"] > 0) & (1 - x["d"] / x["n"] > 0.6), 1 - x["d"] / x["n"]).otherwise(0.0), F.when(x["inside"], 0.85).otherwise(0.0)))
    nearest = F.array_min("_near")
    tokens = F.filter(F.split(address, r"[./\-_?&=]"), lambda t: t.rlike(r"^\p{L}+$"))
    low_path = F.lower(path)
    out = {
        "url_length": F.length(address), "hostname_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "url_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "num_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "has_ip": flag(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")), "has_at": flag(address.contains("@")),
        "has_port": flag((u["port"] != "") & ~F.coalesce(u["port"].try_cast("int"), F.lit(0)).isin(0, 80, 443)), "double_slash": flag(path.contains("//")),
        "prefix_suffix": flag(host.contains("-")), "sub_domain_count": F.greatest(F.lit(0), F.size(labels) - 2),
        "excessive_dots": flag(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= 4), "numeric_subdomain": flag(F.exists(subs, lambda s: s.rlike("^[0-9]+$"))),
        "punycode_present": flag(host.contains("xn--")), "https_token": flag(host.contains("https") & ~host.startswith("https")),
        "is_shortening": flag(reduce(lambda a, b: a | b, ((host == s) | host.endswith(f".{s}") for s in shorteners), F.lit(False))),
        "tld_risk_score": ending_risk(host, risks, fixed.OTHER_RISK), "has_redirect_param": flag(any_in(F.lower(query), fixed.REDIRECT_WORDS)),
        "double_extension": flag(low_path.rlike(r"\.[\p{L}\p{N}_]{2,4}\.[\p{L}\p{N}_]{2,4}($|\?)")), "hex_encoded": flag(host.rlike("%[0-9a-f]{2}")),
        "domain_entropy": entropy(host), "digit_ratio": F.round(F.regexp_count(address, F.lit("[0-9]")) / F.greatest(F.length(address), F.lit(1)), 4),
        "special_char_count": F.length(address) - F.length(F.translate(address, SPECIAL, "")),
        "consonant_ratio": F.when(letters > 0, F.round(F.regexp_count(host, F.lit("[b-df-hj-np-tv-z]")) / letters, 4)).otherwise(0.0),
        "longest_word_length": F.coalesce(F.array_max(F.transform(tokens, F.length)), F.lit(0)),
        "brand_impersonation_score": F.when(brand, 0.0).otherwise(F.round(F.array_max(likeness), 4)),
        "subdomain_brand_match": flag(~brand & any_in(F.array_join(subs, "."), [b.split(".")[0] for b in brands])),
        "suspicious_keywords": F.least(hits(F.lower(address), fixed.URL_WORDS), F.lit(6)), "login_path_score": F.round(F.least(hits(low_path, fixed.PATH_WORDS) / 3.0, F.lit(1.0)), 4),
        "levenshtein_min": F.when(brand, 99).otherwise(nearest["d"]), "levenshtein_ratio": F.when(brand, 1.0).otherwise(F.round(nearest["d"] / nearest["n"], 4)),
    }
    kinds = {k: "double" if k.endswith(("ratio", "score", "entropy")) else "int" for k in out}
    df = df.withColumns({k: F.when(u["ok"], v).otherwise(0).cast(kinds[k]) for k, v in out.items()} | {"struct_ok": u["ok"]})
    df = df.drop("_near")
    return df if keep_parts else df.drop("u")


def evidence_list(*items: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    told = F.array(*(F.when(F.coalesce(c, F.lit(False)), t if isinstance(t, Column) else F.lit(t)) for c, t in items))
    return F.filter(told, lambda x: x.isNotNull())


def number(form: str, column) -> Column:
    return F.format_string(form, column)


def url_evidence(df: DataFrame, name: str = "structural_evidence") -> DataFrame:
    """df (with URL features) and the ordered list of what they show."""
    c = F.col
    risk, brand, lev, words, depth = c("tld_risk_score"), c("brand_impersonation_score"), c("levenshtein_min"), c("suspicious_keywords"), c("sub_domain_count")
    return df.withColumn(name, evidence_list(
        (c("has_ip") > 0, "IP address used as hostname instead of a domain name."),
        (c("has_at") > 0, "@ symbol in URL — can redirect browser to a different host."),
        (c("punycode_present") > 0, "Punycode / IDN encoding in domain — visual spoofing technique."),
        (c("is_shortening") > 0, "URL shortener service used — hides the real destination."),
        (c("https_token") > 0, "'https' keyword embedded in domain name — false security signal."),
        (c("double_extension") > 0, "Double file extension in path (e.g., .pdf.html) — content spoofing."),
        (c("hex_encoded") > 0, "Hex-encoded characters in domain — obfuscation detected."),
        (c("has_redirect_param") > 0, "Open redirect parameter detected in URL."),
        (c("prefix_suffix") > 0, "Hyphen in domain name — common in phishing domains."),
        (risk >= 0.8, number("Very high-risk top-level domain (TLD risk score: %.2f).", risk)),
        ((risk >= 0.5) & (risk < 0.8), number("Elevated-risk top-level domain (TLD risk score: %.2f).", risk)),
        (brand >= 0.7, number("Domain closely resembles a known brand (impersonation score: %.2f).", brand)),
        ((brand >= 0.5) & (brand < 0.7), number("Domain shows possible brand similarity (impersonation score: %.2f).", brand)),
        (c("subdomain_brand_match") > 0, "Known brand name found in subdomain of a different domain."),
        ((lev > 0) & (lev <= 2), number("Typosquatting detected — domain edit distance %d from a known brand.", lev)),
        (words >= 3, number("Multiple suspicious keywords in URL (%d found).", words)),
        ((words >= 1) & (words < 3), number("Suspicious keyword(s) in URL (%d found).", words)),
        (c("login_path_score") >= 0.67, number("Login-themed URL path detected (score: %.2f).", c("login_path_score"))),
        (depth >= 3, number("Excessive subdomain nesting (%d levels) — obfuscation technique.", depth)),
        (c("url_length") > 100, number("Unusually long URL (%d chars) — obfuscation technique.", c("url_length"))),
    ))


def url_reasons(df: DataFrame, name: str = "structural_reasons") -> DataFrame:
    """The alternative list: brand likeness first, as one choice of four."""
    c = F.col
    risk, brand, lev, words, depth = c("tld_risk_score"), c("brand_impersonation_score"), c("levenshtein_min"), c("suspicious_keywords"), c("sub_domain_count")
    close = (lev > 0) & (lev <= 1) & (brand >= 0.7)
    return df.withColumn(name, evidence_list(
        (close, F.format_string("Domain closely resembles a known brand (impersonation score: %.2f, edit distance: %d).", brand, lev)),
        (~close & (brand >= 0.7), number("Domain closely resembles a known brand (impersonation score: %.2f).", brand)),
        ((brand >= 0.5) & (brand < 0.7), number("Domain shows possible brand similarity (impersonation score: %.2f).", brand)),
        ((brand < 0.5) & (lev > 0) & (lev <= 2), number("Typosquatting detected — domain is %d edit distance from a known brand.", lev)),
        (c("subdomain_brand_match") > 0, "Known brand name embedded in subdomain of a different domain."),
        (risk >= 0.8, number("Very high-risk top-level domain (TLD risk score: %.2f).", risk)),
        ((risk >= 0.5) & (risk < 0.8), number("Elevated-risk top-level domain (TLD risk score: %.2f).", risk)),
        (words >= 3, number("Multiple suspicious keywords in URL (%d found).", words)),
        ((words >= 1) & (words < 3), number("Suspicious keyword(s) in URL (%d found).", words)),
        (c("login_path_score") >= 0.67, number("Login-themed URL path detected (score: %.2f).", c("login_path_score"))),
        (c("has_ip") > 0, "IP address used as hostname instead of a domain name."),
        (c("has_at") > 0, "@ symbol in URL — can redirect browser to a different host."),
        (c("punycode_present") > 0, "Punycode / IDN encoding detected — visual domain spoofing technique."),
        (c("is_shortening") > 0, "URL shortener service used — hides the real destination."),
        (c("https_token") > 0, "'https' keyword embedded in domain name — false security signal."),
        (c("double_extension") > 0, "Double file extension in URL path — content-type spoofing technique."),
        (c("hex_encoded") > 0, "Hex-encoded characters in domain — obfuscation detected."),
        (c("has_redirect_param") > 0, "Open redirect parameter detected in URL."),
        (c("prefix_suffix") > 0, "Hyphen used in domain name — common in phishing domains."),
        (depth >= 3, number("Excessive subdomain nesting (%d levels) — URL obfuscation.", depth)),
        (c("url_length") > 100, number("Unusually long URL (%d characters) — obfuscation technique.", c("url_length"))),
    ))


def rule_probability() -> Column:
    """Rule estimate from the URL features, 0 to 1."""
    c = F.col
    lev = c("levenshtein_min")
    points = (
        20 * c("has_ip") + 20 * c("has_at") + 15 * c("is_shortening") + 15 * c("punycode_present")
        + F.when(c("tld_risk_score") >= 0.8, 20).otherwise(0) + F.when(c("brand_impersonation_score") >= 0.7, 25).otherwise(0)
        + 5 * c("suspicious_keywords") + F.when((lev > 0) & (lev <= 1), 20).when(lev == 2, 10).otherwise(0)
    )
    return F.least(F.greatest(points, F.lit(0)), F.lit(100)) / 100.0


def score_of(probability: Column) -> Column:
    """0 to 100, ties to even."""
    return F.least(F.greatest(F.rint(probability * 100), F.lit(0.0)), F.lit(100.0)).cast("int")


def rule_url_score(df: DataFrame) -> DataFrame:
    """df with phishing_probability and structural_score by the rules."""
    return df.withColumn("phishing_probability", F.round(rule_probability(), 4)).withColumn("structural_score", score_of(rule_probability()))


def scaled_features(df: DataFrame, features=None) -> DataFrame:
    """Each feature over its scale, at most 1, to three places, under the name <feature>_scaled."""
    features = {k: v[0] for k, v in fixed.URL_FEATURES.items()} if features is None else features
    return df.withColumns({f"{k}_scaled": F.round(F.least(F.col(k) / F.lit(float(n)), F.lit(1.0)), 3) for k, n in features.items()})


def feature_vector(df: DataFrame, columns=tuple(fixed.URL_FEATURES), name: str = "vector") -> DataFrame:
    """The features in fixed order as an array of doubles."""
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns)))


def typo_flag(base: Column, safe=fixed.BRANDS) -> Column:
    """The first safe domain at edit distance 1 or 2; null if there's none, or the domain is itself safe."""
    near = F.filter(F.array(*(F.when(F.levenshtein(base, F.lit(s)).between(1, 2), F.lit(s)) for s in safe)), lambda x: x.isNotNull())
    return F.when(base.isin(*safe), None).otherwise(F.get(near, F.lit(0)))


def registered_domain(df: DataFrame, suffixes: DataFrame, url_col: str = "url", name: str = "registered_domain") -> DataFrame:
    """df with the public suffix of the host plus one label; the whole lower-case URL where no rule fits or nothing is left.

    suffixes: one column `suffix` of rules. `x.y` is a suffix, `*.x.y` makes one of any label before x.y, and
    `!z.x.y` says that z.x.y is none, but x.y is. Exceptions come before all others, then the rule of most
    labels. Candidate endings of each distinct host are joined to the rules, which may be of any number.
    """
    df = url_parts(df, url_col).withColumn("_host", F.col("u.hostname"))
    labels = F.col("labels")
    hosts = df.select("_host").distinct().withColumn("labels", F.split("_host", r"\."))
    tails = hosts.select("_host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    tail, rest = (F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".") for n in (F.col("k"), F.col("k") - 1))
    asked = lambda rule, except_, k: F.struct(rule.alias("suffix"), F.lit(except_).alias("except"), k.alias("k"))
    kinds = F.array(asked(tail, 0, F.col("k")), asked(F.concat(F.lit("*."), rest), 0, F.col("k")), asked(F.concat(F.lit("!"), tail), 1, F.col("k") - 1))
    tails = tails.select("_host", "labels", F.inline(kinds))
    found = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy("_host").agg(F.max(F.struct("except", "k"))["k"].alias("k"), F.first("labels").alias("labels"))
    named = found.where(F.size("labels") > F.col("k")).select("_host", F.array_join(F.slice(labels, -(F.col("k") + 1), F.col("k") + 1), ".").alias(name))
    return df.join(named, "_host", "left").withColumn(name, F.coalesce(name, F.lower(F.col(url_col)))).drop("_host", "u")
