import pytest

from wardline.functions import fixed, urls
from wardline.operators import scoring

GOLDEN = {
    "http://paypa1.com/login": {"url_length": 23, "hostname_length": 10, "path_length": 6, "url_depth": 1, "tld_risk_score": 0.1, "domain_entropy": 2.9219, "digit_ratio": 0.0435, "consonant_ratio": 0.625, "longest_word_length": 5, "brand_impersonation_score": 0.9, "levenshtein_min": 1, "levenshtein_ratio": 0.1, "suspicious_keywords": 1, "login_path_score": 0.3333, "structural_score": 50},
    "http://paypal.account-verify.tk": {"sub_domain_count": 1, "prefix_suffix": 1, "tld_risk_score": 1.0, "domain_entropy": 3.9702, "consonant_ratio": 0.6667, "brand_impersonation_score": 0.0, "subdomain_brand_match": 1, "levenshtein_min": 12, "levenshtein_ratio": 0.7059, "suspicious_keywords": 2, "structural_score": 30},
    "https://t.co/abc123": {"is_shortening": 1, "levenshtein_min": 2, "levenshtein_ratio": 0.4, "brand_impersonation_score": 0.0},
    "https://www.microsoft.com": {"is_shortening": 0, "levenshtein_min": 99, "levenshtein_ratio": 1.0, "brand_impersonation_score": 0.0},
    "https://bit.ly/xyz": {"is_shortening": 1},
    "http://g00gle.com/signin": {"brand_impersonation_score": 0.8, "levenshtein_min": 2, "levenshtein_ratio": 0.2},
    "http://a.example.net/": {"brand_impersonation_score": 0.85},
    "http://h:99999/x": {k: 0 for k in fixed.URL_FEATURES} | {"struct_ok": False},
    "https://user:pw@Sub.Evil_Host.tk:8080/a//b.pdf.html?next=http://x&y=1#f": {"hostname_length": 16, "has_at": 1, "has_port": 1, "double_slash": 1, "double_extension": 1, "has_redirect_param": 1, "num_params": 2, "struct_ok": True},
    "http://[::1]:80/x": {"hostname_length": 3, "has_port": 0, "struct_ok": True},
    "paypal.com/x": {"url_length": 19, "levenshtein_min": 99},
    "http://münchen.de/ü": {"hostname_length": 10, "path_length": 2},
    "http://a.com/%zz": {"struct_ok": True},
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    return {r["url"]: r.asDict() for r in urls.rule_url_score(urls.url_features(df)).collect()}


@pytest.mark.parametrize("url", GOLDEN)
def test_golden_url(found, url):
    assert {k: found[url][k] for k in GOLDEN[url]} == pytest.approx(GOLDEN[url])


def test_null_and_empty_urls_are_read(spark):
    df = spark.createDataFrame([(None,), ("",)], "url string")
    assert [r["url_length"] for r in urls.url_features(df).collect()] == [7, 7]


def test_registered_domain_takes_the_longest_suffix(spark):
    df = spark.createDataFrame([("http://a.b.co.uk/x",), ("http://b.uk",), ("http://10.0.0.1/",), ("http://co.uk/",)], "url string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",)], "suffix string")
    got = {r["url"]: r["registered_domain"] for r in urls.registered_domain(df, suffixes).collect()}
    assert got == {"http://a.b.co.uk/x": "b.co.uk", "http://b.uk": "b.uk", "http://10.0.0.1/": "http://10.0.0.1/", "http://co.uk/": "http://co.uk/"}


def test_suffix_wildcards_and_exceptions(spark):
    hosts = {"a.b.c.ck": "b.c.ck", "b.c.ck": "b.c.ck", "c.ck": "http://c.ck/", "x.www.ck": "www.ck", "www.ck": "www.ck", "a.city.kobe.jp": "city.kobe.jp", "a.b.other.kobe.jp": "b.other.kobe.jp", "q.jp": "q.jp", "none.test": "http://none.test/"}
    df = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string")
    rules = spark.createDataFrame([(r,) for r in ("ck", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp")], "suffix string")
    got = {r["url"]: r["registered_domain"] for r in urls.registered_domain(df, rules).collect()}
    assert got == {f"http://{h}/": want for h, want in hosts.items()}


@pytest.mark.parametrize(("score", "want"), [(29, "SAFE"), (30, "SUSPICIOUS"), (59, "SUSPICIOUS"), (60, "PHISHING")])
def test_verdict_limits(spark, score, want):
    assert spark.range(1).select(scoring.verdict(__import__("pyspark").sql.functions.lit(score)).alias("v")).first()["v"] == want
