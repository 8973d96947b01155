"""Page features, evidence and page texts, native over the elements of each page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.functions.phrases import phrase_count, phrase_counts
from wardline.functions.urls import PARTS, any_in, evidence_list, number, url_parts
from wardline.sources.elements import page_elements

LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MOST_TEXT = 5_000


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def elements_where(condition) -> Column:
    return F.filter(F.col("elements"), condition)


def shown(e: Column) -> Column:
    return ~e["hidden"] & ~e["raw"]


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def dehyphenated(text: Column) -> Column:
    """Without hyphens between letters; each pair of letters is taken once, from the left."""
    return F.regexp_replace(text, "([a-zA-Z])-([a-zA-Z])", "$1$2")


def tidy(text: Column, most: int = MOST_TEXT) -> Column:
    """Lines stripped, cut at double blanks, joined by single ones, and at most so many characters."""
    lines = F.transform(F.split(dehyphenated(text), LINES), strip)
    chunks = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, "  "))), lambda c: c != "")
    return F.substring(F.array_join(chunks, " "), 1, most)


def joined_text(parts: Column, most: int = MOST_TEXT) -> Column:
    """The shown text of these text elements."""
    return tidy(F.array_join(F.transform(parts, lambda e: e["text"]), " "), most)


def visible_text(most: int = MOST_TEXT) -> Column:
    return joined_text(F.filter("elements", PARTS_OF["text"]), most)


def resolved_host(link: Column, page: Column) -> Column:
    """Lower-case netloc of a link as seen from a page; the page's own for relative links, empty for other schemes without one."""
    scheme, host = F.lower(F.regexp_extract(link, PARTS, 1)), F.regexp_extract(link, PARTS, 2)
    page_scheme = F.lower(F.regexp_extract(page, PARTS, 1))
    relative = (host == "") & ((scheme == "") | ((scheme == page_scheme) & scheme.isin("http", "https")))
    return F.lower(F.when(relative, F.regexp_extract(page, PARTS, 2)).otherwise(host))


def without_dots(parts: Column) -> Column:
    """The path of these parts with . and .. worked off."""

    def step(kept: Column, x: Column) -> Column:
        shorter = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(x == "..", shorter).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    path = F.array_join(last, "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolved(link: Column, page: Column) -> Column:
    """The link as an absolute address, as seen from a page."""
    base = F.regexp_extract(page, r"^([^:/?#]+:)?(//[^/?#]*)?", 0)
    path, tail = F.regexp_extract(link, "^[^?#]*", 0), F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    own = F.split(F.regexp_extract(page, PARTS, 3), "/")
    folder = F.when(F.element_at(own, -1) == "", own).otherwise(F.slice(own, F.lit(1), F.size(own) - 1))
    joined = F.concat(folder, F.split(path, "/"))
    joined = F.filter(joined, lambda x, i: (x != "") | (i == 0) | (i == F.size(joined) - 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, "^([^:/?#]+:)?", 0), link))
        .when(link.startswith("/"), F.concat(base, without_dots(F.split(path, "/")), tail))
        .when(link.startswith("?"), F.concat(base, F.regexp_extract(page, PARTS, 3), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
        .otherwise(F.concat(base, without_dots(joined), tail))
    )


#: What each group of page features is counted from; a change of a page moves only the groups whose elements it touches.
PARTS_OF = {
    "text": lambda e: (e["tag"] == "#text") & shown(e),
    "title": lambda e: (e["tag"] == "#text") & (e["parent"] == "title") & shown(e),
    "inputs": lambda e: (e["tag"] == "input") & shown(e),
    "forms": lambda e: (e["tag"] == "form") & shown(e),
    "links": lambda e: e["tag"].isin("a", "button") & shown(e),
    "iframes": lambda e: (e["tag"] == "iframe") & shown(e),
    "scripts": lambda e: e["tag"] == "script",
}


def group_features(group: str, parts: Column, page: Column) -> dict[str, Column]:
    """The features of one group but text, from its elements; page: the page's address."""
    own_host = F.lower(F.regexp_extract(page, PARTS, 2))
    is_true = lambda c: F.coalesce(c, F.lit(False))
    typed = lambda *kinds: F.size(F.filter(parts, lambda e: is_true(attr(e, "type").isin(*kinds))))

    def action(e):
        script = F.regexp_extract(F.lower(F.coalesce(attr(e, "onsubmit"), F.lit(""))), r"this\.action\s*=\s*['\"]([^'\"]+)['\"]", 1)
        return F.when(script != "", script).otherwise(F.coalesce(attr(e, "action"), F.lit("")))

    def target(e):
        click = F.regexp_extract(F.coalesce(attr(e, "onclick"), F.lit("")), r"window\.location\.href\s*=\s*['\"]([^'\"]+)['\"]", 1)
        return F.when(e["tag"] == "a", F.coalesce(attr(e, "href"), F.lit(""))).otherwise(click)

    if group == "title":
        return {"page_title": F.get(F.filter(F.transform(parts, lambda e: strip(e["text"])), lambda x: x != ""), F.lit(0))}
    if group == "inputs":
        masked = F.size(F.filter(parts, lambda e: is_true((attr(e, "type") == "text") & F.lower(attr(e, "style")).contains("text-security"))))
        return {"password_fields": typed("password") + masked, "text_email_fields": typed("text", "email")}
    if group == "forms":
        actions = F.transform(F.filter(F.transform(parts, action), lambda x: x != ""), lambda a: resolved(a, page))
        host = lambda a: F.lower(F.regexp_extract(a, PARTS, 2))
        return {"forms": F.size(parts), "form_actions": actions, "has_external_form_action": F.exists(actions, lambda a: (host(a) != "") & (host(a) != own_host))}
    if group == "links":
        links = F.filter(F.transform(parts, target), lambda x: x != "")
        return {"external_links": F.size(F.filter(links, lambda x: (resolved_host(x, page) != "") & (resolved_host(x, page) != own_host)))}
    return {group: F.size(parts)}


def page_features(elements: DataFrame, url_col: str = "url", banks=None, most_text: int = MOST_TEXT, text_col: str | None = None) -> DataFrame:
    """elements with the 14 page features; all 0, null or empty where there is no page. Phrases of all banks are counted in one pass."""
    banks = fixed.PAGE_WORDS if banks is None else banks
    page = F.coalesce(F.col(url_col), F.lit(""))
    features = {}
    for group, of in PARTS_OF.items():
        if group != "text":
            features |= group_features(group, F.filter("elements", of), page)
    df = elements.withColumns({"_text": visible_text(most_text), **features})
    df = df.withColumns({"text_length": F.length("_text"), "_phrases": phrase_counts(F.lower("_text"), banks)})
    df = df.withColumns({f"{name}_indicators": F.coalesce(F.col("_phrases")[name], F.lit(0)) for name in banks})
    if text_col:
        df = df.withColumn(text_col, F.col("_text"))
    return df.drop("_text", "_phrases")


def context_features(df: DataFrame, url_col: str = "url", trusted=None) -> DataFrame:
    """The seven features that set a page against its domain; df has page features."""
    trusted = fixed.TRUSTED if trusted is None else trusted
    hosts = sorted({h for own in trusted.values() for h in own})
    df = url_parts(df, url_col)
    safe = (F.col("u.hostname").isin(*hosts) | F.col("u.base_domain").isin(*hosts)).cast("double")
    other = F.exists("form_actions", lambda a: (F.regexp_extract(a, PARTS, 2) != "") & (F.element_at(F.split(F.lower(F.regexp_extract(a, PARTS, 2)), r"\."), -1).isNotNull()) & ~F.lower(F.regexp_extract(a, PARTS, 2)).endswith(F.col("u.base_domain")))
    df = df.withColumn("trusted_domain", safe).withColumn("form_action_same_origin", F.when(other, 0.0).otherwise(1.0)).drop("u")
    b = F.col("brand_indicators")
    df = df.withColumn("domain_brand_consistency", F.when((b == 0) | (F.col("trusted_domain") > 0), 1.0).otherwise(0.0))
    return df.withColumns({
        "link_to_form_ratio": F.col("external_links") / (F.col("forms") + 1), "text_to_script_ratio": F.col("text_length") / (F.col("scripts") + 1),
        "credential_density": (F.col("password_fields") + F.col("credential_indicators")) / (F.col("text_length") / 1000 + 1),
        "brand_context_score": F.col("domain_brand_consistency") * F.col("trusted_domain") + (1 - b / (b + 10)) * F.col("form_action_same_origin"),
    })


def page_evidence(df: DataFrame, url_col: str = "url", name: str = "semantic_evidence") -> DataFrame:
    """The ordered list of what a page shows; one entry for each form sent to another host."""
    c = F.col
    forms, words, login, urgency = c("forms"), c("credential_indicators"), c("login_indicators"), c("urgency_indicators")
    own = F.lower(F.regexp_extract(F.coalesce(c(url_col), F.lit("")), PARTS, 2))
    sent = F.filter(F.transform("form_actions", lambda a: F.lower(F.regexp_extract(a, PARTS, 2))), lambda h: (h != "") & (h != own))
    first = evidence_list(
        (c("password_fields") > 0, number("Password input field(s) detected on page (%d).", c("password_fields"))),
        ((forms > 0) & (words > 0), F.format_string("Login/credential form detected (%d form(s), %d credential keyword(s)).", forms, words)),
        ((forms > 0) & (words == 0), number("Form(s) detected on page (%d).", forms)),
    )
    last = evidence_list(
        (login > 6, number("High density of login-related language on page (%d occurrences).", login)),
        ((login > 0) & (login <= 6), number("Login-related content detected (%d occurrences).", login)),
        (urgency > 3, number("Strong urgency / deception language on page (%d occurrences).", urgency)),
        ((urgency > 0) & (urgency <= 3), number("Urgency-related language detected (%d occurrences).", urgency)),
        (c("payment_indicators") > 2, number("Payment / financial content detected (%d occurrences).", c("payment_indicators"))),
        ((c("brand_indicators") > 0) & (c("brand_impersonation_score") >= 0.5), number("Brand name mentioned on page while domain appears to impersonate it (%d mention(s)).", c("brand_indicators"))),
        (c("iframes") > 0, number("Iframe(s) detected (%d) — can embed hidden content.", c("iframes"))),
        (c("external_links") > 15, number("Unusually high number of external links (%d) — possible cloaking.", c("external_links"))),
        (c("scripts") > 30, number("High script count (%d) — complex client-side behaviour.", c("scripts"))),
    )
    return df.withColumn(name, F.concat(first, F.transform(sent, lambda h: F.format_string("Form submits data to an external domain (%s).", h)), last))


def page_reasons(df: DataFrame, name: str = "semantic_reasons") -> DataFrame:
    """The alternative list, with forms sent elsewhere first and once."""
    c = F.col
    forms, words, urgency = c("forms"), c("credential_indicators"), c("urgency_indicators")
    return df.withColumn(name, evidence_list(
        (c("has_external_form_action"), "Form submits credentials to an external domain."),
        (c("password_fields") > 0, number("Password input field(s) detected on page (%d).", c("password_fields"))),
        ((forms > 0) & (words > 0), F.format_string("Login/credential form detected (%d form(s), %d credential keyword(s)).", forms, words)),
        ((forms > 0) & (words == 0), number("Form(s) detected on page (%d).", forms)),
        (urgency > 3, number("Strong urgency / deception language detected (%d occurrences).", urgency)),
        ((urgency > 0) & (urgency <= 3), number("Urgency-related language detected (%d occurrences).", urgency)),
        (c("payment_indicators") > 2, number("Payment / financial content detected (%d occurrences).", c("payment_indicators"))),
        (c("login_indicators") > 6, number("High density of login-related language (%d occurrences).", c("login_indicators"))),
        ((c("brand_indicators") > 0) & (c("brand_impersonation_score") >= 0.5), number("Brand name mentioned on page while domain appears to impersonate it (%d mention(s)).", c("brand_indicators"))),
        (c("iframes") > 0, number("Iframe(s) detected (%d) — can embed hidden malicious content.", c("iframes"))),
        (c("external_links") > 15, number("Unusually high number of external links (%d) — possible cloaking.", c("external_links"))),
    ))


def annotated_text(elements: DataFrame, words: int = 400, name: str = "annotated") -> DataFrame:
    """Shown text with marks for title, inputs, buttons and links, at most so many words."""
    marks = F.create_map(*(F.lit(x) for pair in (("title", "[TITLE] "), ("button", "[BUTTON] "), ("a", "[LINK] ")) for x in pair))
    told = F.transform(elements_where(lambda e: shown(e) & e["tag"].isin("#text", "input")), lambda e: F.when(e["tag"] == "input", F.concat(F.lit("[INPUT "), F.coalesce(attr(e, "type"), F.lit("text")), F.lit("]"))).otherwise(F.concat(F.coalesce(F.try_element_at(marks, e["parent"]), F.lit("")), e["text"])))
    parts = F.filter(F.split(F.array_join(told, " "), r"\s+"), lambda w: w != "")
    return elements.withColumn(name, F.array_join(F.slice(parts, 1, words), " "))


def login_page(elements: DataFrame, url_col: str = "url", name: str = "is_login_page") -> DataFrame:
    """Whether a page asks for a login: a password field; or a telling address with a user field or button text; or a form with a user field."""
    has = lambda cond: F.coalesce(F.exists("elements", cond), F.lit(False))
    holds = lambda e, a, words: F.coalesce(reduce(lambda x, y: x | y, (F.lower(attr(e, a)).contains(w) for w in words)), F.lit(False))
    kind = lambda e, k: F.coalesce(F.lower(attr(e, "type")) == k, F.lit(False))
    is_input = lambda e: e["tag"] == "input"
    user = has(lambda e: is_input(e) & (kind(e, "email") | holds(e, "name", ("email", "user", "login")) | holds(e, "placeholder", ("email", "username"))))
    form = has(lambda e: is_input(e) & (e["form"] >= 0) & (kind(e, "email") | (kind(e, "text") & (holds(e, "name", ("user", "email")) | holds(e, "placeholder", ("email", "username"))))))
    text = F.lower(F.array_join(F.transform(elements_where(lambda e: (e["tag"] == "#text") & shown(e)), lambda e: e["text"]), " "))
    address = any_in(F.lower(F.coalesce(F.col(url_col), F.lit(""))), fixed.LOGIN_ADDRESS_WORDS)
    return elements.withColumn(name, has(lambda e: is_input(e) & kind(e, "password")) | (address & (user | any_in(text, fixed.LOGIN_BUTTON_WORDS))) | form)


def analysed_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """pages with page features; neither html nor elements go on."""
    return page_features(page_elements(pages, html_col), url_col, **how).drop("elements")
