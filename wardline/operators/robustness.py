"""How far a detector's output moves under controlled changes. Only scores and metrics leave these plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.functions.phrases import phrase_counts
from wardline.functions.urls import PARTS
from wardline.operators.evaluation import confusion, from_counts, roc_auc
from wardline.operators.pages import MOST_TEXT, PARTS_OF, group_features, joined_text, page_features
from wardline.sources.shared import cut

# Kinds of features that a change of some percent must keep in bounds.
BINARY = ("https_token", "is_shortening", "double_slash", "prefix_suffix", "punycode_present", "has_redirect_param", "double_extension", "hex_encoded")
COUNTS = ("password_fields", "text_email_fields", "forms", "external_links", "iframes", "scripts", "sub_domain_count", "num_params")


def bounds(feature: str) -> tuple[float | None, float | None]:
    if feature.startswith("has_") or feature in BINARY:
        return 0.0, 1.0
    if feature in COUNTS:
        return 0.0, None
    if "ratio" in feature or "score" in feature:
        return 0.0, 1.0
    if "length" in feature or "count" in feature or feature in ("url_depth", "levenshtein_min"):
        return 0.0, None
    return None, None


def perturbed_value(feature: str, value: Column, share: Column) -> Column:
    low, high = bounds(feature)
    out = value * (1 + share)
    out = out if low is None else F.greatest(out, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def perturb_features(df: DataFrame, columns: list[str], shares=(-0.05, 0.05), key: str = "sample_id") -> DataFrame:
    """Each row once per feature and share, with that one feature moved: changed_feature, changed_by and all columns."""
    cases = F.array(*(F.struct(F.lit(c).alias("changed_feature"), F.lit(float(s)).alias("changed_by")) for c in columns for s in shares))
    rows = df.withColumn("_c", F.explode(cases)).withColumn("changed_feature", F.col("_c.changed_feature")).withColumn("changed_by", F.col("_c.changed_by")).drop("_c")
    moved = {c: F.when(F.col("changed_feature") == c, perturbed_value(c, F.col(c).cast("double"), F.col("changed_by"))).otherwise(F.col(c).cast("double")) for c in columns}
    return rows.withColumns(moved)


def feature_fragility(df: DataFrame, columns: list[str], score: Callable[[DataFrame], Column], threshold: float, label: str = "label", shares=(-0.05, 0.05)) -> DataFrame:
    """Per feature and share: metrics after the change and how much F1, accuracy and area under the ROC curve fell against no change."""
    by = ["changed_feature", "changed_by"]
    plain = df.withColumns({c: F.col(c).cast("double") for c in columns})
    plain = plain.select(label, score(plain).alias("score"))
    moved = perturb_features(df, columns, shares)
    moved = moved.select(*by, label, score(moved).alias("score"))
    base = from_counts(confusion(plain, F.col("score") >= threshold, label)).select(F.col("f1").alias("f1_before"), F.col("accuracy").alias("accuracy_before"))
    base = base.crossJoin(roc_auc(plain, label).withColumnRenamed("roc_auc", "roc_auc_before"))  # one row with one row
    after = from_counts(confusion(moved, F.col("score") >= threshold, label, by)).join(roc_auc(moved, label, by=by), by)
    out = after.crossJoin(F.broadcast(base))
    return out.withColumns({f"{c}_drop": F.round(F.col(f"{c}_before") - F.col(c), 6 if c == "roc_auc" else 4) for c in ("f1", "accuracy", "roc_auc")})


def fragility_ranking(fragility: DataFrame) -> DataFrame:
    """Worst and mean F1 drop of each feature."""
    return fragility.groupBy("changed_feature").agg(F.max("f1_drop").alias("worst_drop"), F.round(F.avg("f1_drop"), 6).alias("mean_drop"))


def only_target_moved(perturbed: DataFrame, original: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Per changed feature: rows in which another feature differs (expected 0), and the mean relative shift of the feature itself."""
    old = original.select(F.col(key), *(F.col(c).cast("double").alias(f"_{c}") for c in columns))
    both = perturbed.join(old, key)
    others = sum((((F.col("changed_feature") != c) & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int") for c in columns), F.lit(0))
    shift = F.coalesce(*(F.when((F.col("changed_feature") == c) & (F.col(f"_{c}") != 0), (F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}")) for c in columns))
    return both.groupBy("changed_feature", "changed_by").agg(F.count_if(others > 0).alias("others_moved"), F.round(F.avg(shift), 6).alias("mean_shift"))


def url_rebuilt(url: Column, path: Column | None = None, query: Column | None = None, fragment: Column | None = None) -> Column:
    head = F.regexp_extract(url, r"^([^:/?#]+:)?(//[^/?#]*)?", 0)
    path = F.regexp_extract(url, PARTS, 3) if path is None else path
    query = F.regexp_extract(url, PARTS, 4) if query is None else query
    fragment = F.regexp_extract(url, PARTS, 5) if fragment is None else fragment
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def add_parameter(url: Column, pair: str) -> Column:
    query = F.regexp_extract(url, PARTS, 4)
    return url_rebuilt(url, query=F.when(query != "", F.concat(query, F.lit(f"&{pair}"))).otherwise(pair))


def percent_encoded(url: Column) -> Column:
    """The first letter or digit of the path, else of the query, as %XX; %2F where both are empty."""
    path, query = F.regexp_extract(url, PARTS, 3), F.regexp_extract(url, PARTS, 4)

    def first(part: Column) -> Column:
        c = F.regexp_extract(part, "[A-Za-z0-9]", 0)
        return F.concat(F.regexp_extract(part, "^[^A-Za-z0-9]*", 0), F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"), F.regexp_extract(part, "^[^A-Za-z0-9]*[A-Za-z0-9](.*)$", 1))

    has = lambda part: part.rlike("[A-Za-z0-9]")
    return F.when(has(path), url_rebuilt(url, path=first(path))).when(has(query), url_rebuilt(url, query=first(query))).when(path.isin("", "/") & (query == ""), url_rebuilt(url, path=F.lit("/%2F")))


# Words in addresses and what stands in for them, in order.
PLAINER = {"login": "entry", "signin": "entry", "sign-in": "entry", "account": "user", "secure": "safe", "security": "safe", "verify": "check", "verification": "check", "confirm": "ok", "update": "edit", "banking": "finance", "password": "key", "credential": "auth", "authenticate": "auth"}
# Words of pages and their hyphenated forms.
HYPHENATED = {"password": "pass-word", "verify": "ver-ify", "login": "log-in", "account": "acc-ount", "urgent": "ur-gent", "payment": "pay-ment"}
# Texts that changes of pages add.
PADDING = "Accessibility information, privacy details, and support resources."
HIDDEN_TEXT = "This is a standard information page detailing accessibility and privacy policies for all users."
HIDDEN_NOTICE = "Terms of service, accessibility, privacy policies and legal notices for users."
HIDDEN_START = "terms conditions privacy policy information service copyright reserved contact about"


def plainer_words(url: Column) -> Column:
    path, query = F.regexp_extract(url, PARTS, 3), F.regexp_extract(url, PARTS, 4)
    for old, new in PLAINER.items():
        path, query = F.replace(path, F.lit(old), F.lit(new)), F.replace(query, F.lit(old), F.lit(new))
    return url_rebuilt(url, path=path, query=query)


#: Changes of addresses: name -> (address -> address, null where it doesn't apply).
URL_CHANGES: dict[str, Callable[[Column], Column]] = {
    "url_display_parameter": lambda u: add_parameter(u, "display=compact"),
    "url_tracking_parameter": lambda u: add_parameter(u, "tracking_id_0=abc123"),
    "url_fragment": lambda u: F.when(F.regexp_extract(u, PARTS, 5) == "", url_rebuilt(u, fragment=F.lit("section_0"))),
    "url_plainer_words": plainer_words,
    "url_percent_encoding": percent_encoded,
}


def new_element(tag: str, attrs: dict[str, str], text: str | None = None, hidden: bool = False, parent: str = "body", raw: bool = False) -> Callable[[], Column]:
    """Makes the element when a plan is built."""

    def make() -> Column:
        pairs = F.create_map(*(F.lit(x) for kv in attrs.items() for x in kv)).cast("map<string,string>")
        return F.struct(F.lit(0).alias("seq"), F.lit(tag).alias("tag"), pairs.alias("attrs"), F.lit(text).cast("string").alias("text"), F.lit(parent).alias("parent"), F.lit(hidden).alias("hidden"), F.lit(raw).alias("raw"), F.lit(-1).alias("form"))

    return make


def with_element(make: Callable[[], Column], first: bool = False):
    return lambda own: F.concat(F.array(make()), own) if first else F.concat(own, F.array(make()))


def each(change: Callable[[Column], dict[str, Column]]):
    """Replaces fields of every element."""
    fields = ("seq", "tag", "attrs", "text", "parent", "hidden", "raw", "form")
    return lambda own: F.transform(own, lambda e: F.struct(*((change(e).get(f, e[f])).alias(f) for f in fields)))


def hyphenate(words: dict[str, str]):
    def change(e):
        text = e["text"]
        for old, new in words.items():
            text = F.regexp_replace(text, f"(?i){old}", new)
        return {"text": F.when((e["tag"] == "#text") & ~e["raw"], text).otherwise(e["text"])}

    return each(change)


def replaced_words(words: dict[str, str]):
    def change(e):
        text = e["text"]
        for old, new in words.items():
            text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
        return {"text": text}

    return each(change)


def changed_attrs(e: Column, tag: str, drop: str, more: Callable[[Column], list[Column]], when: Column) -> Column:
    kept = F.map_filter(e["attrs"], lambda k, v: k != drop)
    return F.when((e["tag"] == tag) & when, F.map_concat(F.map_filter(kept, lambda k, v: ~k.isin("style", "onsubmit")), F.create_map(*more(e)))).otherwise(e["attrs"])


def has_attr(e: Column, name: str, value: str | None = None) -> Column:
    v = F.try_element_at(e["attrs"], F.lit(name))
    return v.isNotNull() if value is None else F.coalesce(v == value, F.lit(False))


#: Changes of pages, as edits of their elements: name -> (elements -> elements).
PAGE_CHANGES: dict[str, Callable[[Column], Column]] = {
    "page_padding": with_element(new_element("#text", {}, PADDING, parent="p")),
    "page_hyphenation": hyphenate({k: v for k, v in HYPHENATED.items() if k != "payment"}),
    "page_decoration": with_element(new_element("div", {"aria-hidden": "true"}, hidden=True), first=True),
    "page_hidden_text": with_element(new_element("#text", {}, HIDDEN_TEXT, hidden=True, parent="p")),
    "page_script": with_element(new_element("script", {"type": "text/javascript"}, raw=True, parent="head")),
    "page_hidden_link": with_element(new_element("a", {"href": "https://www.google.com/policies/privacy/", "style": "display:none;"}, hidden=True)),
    "page_hyphenation_6": hyphenate(HYPHENATED),
    "page_wrapper": with_element(new_element("div", {"class": "main-wrapper"}), first=True),
    "page_meta": with_element(new_element("meta", {"name": "theme-color", "content": "#ffffff"}, parent="head"), first=True),
    "page_form_by_script": each(lambda e: {"attrs": changed_attrs(e, "form", "action", lambda x: [F.lit("onsubmit"), F.concat(F.lit("this.action='"), F.try_element_at(x["attrs"], F.lit("action")), F.lit("'; return true;"))], has_attr(e, "action"))}),
    "page_masked_password": each(lambda e: {"attrs": changed_attrs(e, "input", "type", lambda x: [F.lit("type"), F.lit("text"), F.lit("style"), F.lit("-webkit-text-security: disc; text-security: disc;")], has_attr(e, "type", "password"))}),
    "page_bulk_hidden_text": with_element(new_element("#text", {}, " ".join([HIDDEN_NOTICE] * 100), hidden=True, parent="div")),
    "page_links_to_buttons": each(lambda e: {"tag": F.when((e["tag"] == "a") & has_attr(e, "href"), "button").otherwise(e["tag"]), "attrs": F.when((e["tag"] == "a") & has_attr(e, "href"), F.create_map(F.lit("onclick"), F.concat(F.lit("window.location.href='"), F.try_element_at(e["attrs"], F.lit("href")), F.lit("'")))).otherwise(e["attrs"])}),
    "page_synonyms": replaced_words({"password": "passcode", "login": "authenticate", "sign in": "access account", "username": "user ID"}),
    "page_text_as_image": each(lambda e: {"text": F.when((e["tag"] == "#text") & F.lower(e["text"]).contains("password"), "").otherwise(e["text"])}),
    "page_hidden_iframe": with_element(new_element("iframe", {"src": "https://en.wikipedia.org", "style": "width:0;height:0;border:0"})),
    "page_long_hidden_start": with_element(new_element("#text", {}, " ".join([HIDDEN_START] * 500), hidden=True, parent="div"), first=True),
}


def perturb_urls(df: DataFrame, names=tuple(URL_CHANGES), url_col: str = "url") -> DataFrame:
    """Each row once per change that applies, with the changed address and the change's name."""
    cases = F.array(*(F.struct(F.lit(n).alias("perturbation"), URL_CHANGES[n](F.col(url_col)).alias("_url")) for n in names))
    return df.withColumn("_c", F.explode(cases)).where("_c._url IS NOT NULL").withColumn("perturbation", F.col("_c.perturbation")).withColumn(url_col, F.col("_c._url")).drop("_c")


CLEAN = "clean"


def perturb_pages(elements: DataFrame, names=tuple(PAGE_CHANGES), clean: bool = False) -> DataFrame:
    """Each page, however large, once per change, and with `clean` once as it is under that name. The elements are edited in the row; nothing is rendered or kept.

    steps, url_changed and length_change tell how far the page moved, valid whether it kept a body and a
    tenth of its length. Lengths are those of all texts.
    """
    length = lambda es: F.aggregate(es, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.length(e["text"]), F.lit(0)))
    body = lambda es: F.exists(es, lambda e: e["tag"] == "body")
    named = elements.withColumn("_size", length(F.col("elements"))).withColumn("_body", body(F.col("elements"))).withColumn("perturbation", F.explode(F.array(*map(F.lit, (*names, CLEAN) if clean else names))))
    out = named.withColumn("elements", changed_elements(names))
    after = length(F.col("elements"))
    return out.withColumns({
        "steps": F.lit(1), "url_changed": F.lit(False), "length_change": after - F.col("_size"),
        "valid": (~F.col("_body") | body(F.col("elements"))) & (after >= 0.1 * F.col("_size")),
    }).drop("_size", "_body")


#: What each change of a page can move: groups of features (pages.PARTS_OF), or the page's length. Nothing else is looked at again.
TOUCHED: dict[str, tuple[str, ...]] = {
    "page_padding": ("text", "length"), "page_hyphenation": ("text", "title", "length"), "page_decoration": (), "page_hidden_text": ("length",),
    "page_script": ("scripts",), "page_hidden_link": (), "page_hyphenation_6": ("text", "title", "length"), "page_wrapper": (), "page_meta": (),
    "page_form_by_script": ("forms",), "page_masked_password": ("inputs",), "page_bulk_hidden_text": ("length",), "page_links_to_buttons": ("links",),
    "page_synonyms": ("text", "title", "length"), "page_text_as_image": ("text", "title", "length"), "page_hidden_iframe": ("iframes",),
    "page_long_hidden_start": ("length",),
}


def text_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.length(e["text"]), F.lit(0)))


def changed_page_features(elements: DataFrame, names=tuple(PAGE_CHANGES), clean: bool = False, url_col: str = "url", banks=None, most_text: int = MOST_TEXT) -> DataFrame:
    """page_features of perturb_pages, row for row, but each page is analysed once.

    A change is applied to the elements of the groups it touches (TOUCHED) and those groups are counted
    anew; all other features are the clean page's. Phrases are counted again only in a text that came out
    different. One row per page and change leaves with features, never with elements.
    """
    banks = fixed.PAGE_WORDS if banks is None else banks
    page = F.coalesce(F.col(url_col), F.lit(""))
    parts = PARTS_OF | {"length": lambda e: e["text"].isNotNull()}
    kept = [c for c in elements.columns if c != "elements"]
    df = elements.select(*kept, *(F.filter("elements", of).alias(f"_{g}") for g, of in parts.items()))
    after = lambda n, g: F.filter(PAGE_CHANGES[n](F.col(f"_{g}")), parts[g])
    found = {"size": text_length(F.col("_length")), "text": joined_text(F.col("_text"), most_text)}
    for g in set(PARTS_OF) - {"text"}:
        found |= group_features(g, F.col(f"_{g}"), page)
    moved: dict[str, dict[str, Column]] = {n: {} for n in names}
    for n in names:
        for g in TOUCHED[n]:
            moved[n] |= {"size": text_length(after(n, g))} if g == "length" else {"text": joined_text(after(n, g), most_text)} if g == "text" else group_features(g, after(n, g), page)
    cells = {f"_clean_{c}": v for c, v in found.items()} | {f"_{n}_{c}": v for n in names for c, v in moved[n].items()}
    df = df.select(*kept, *(v.alias(c) for c, v in cells.items()))
    texts = [n for n in names if "text" in moved[n]]
    differs = {n: F.when(F.col(f"_{n}_text") != F.col("_clean_text"), F.lower(F.col(f"_{n}_text"))) for n in texts}
    df = df.withColumns({"_clean_count": phrase_counts(F.lower(F.col("_clean_text")), banks)} | {f"_{n}_count": phrase_counts(low, banks) for n, low in differs.items()})

    def case(n: str) -> Column:
        of = lambda c: F.col(f"_{n}_{c}" if n != CLEAN and c in moved[n] else f"_clean_{c}")
        counts = F.coalesce(F.col(f"_{n}_count"), F.col("_clean_count")) if n in texts else F.col("_clean_count")
        features = {c: of(c) for c in found if c not in ("text", "size")} | {"text_length": F.length(of("text"))} | {f"{b}_indicators": F.coalesce(counts[b], F.lit(0)) for b in banks}
        told = {"perturbation": F.lit(n), "steps": F.lit(1), "url_changed": F.lit(False), "length_change": of("size") - F.col("_clean_size"), "valid": of("size") >= 0.1 * F.col("_clean_size")}  # no change takes the body away
        return F.struct(*(v.alias(c) for c, v in (told | features).items()))

    cases = F.array(*(case(n) for n in (*names, *([CLEAN] if clean else []))))
    return df.select(*kept, F.explode(cases).alias("_c")).select(*kept, "_c.*")


def paired_outcomes(clean: DataFrame, changed: DataFrame, key: str, phishing_min: int = fixed.PHISHING_MIN) -> DataFrame:
    """Per row and perturbation: scores, verdicts, evasion (detected before, not after), change. Both have key, risk_score, verdict."""
    before = clean.select(key, F.col("risk_score").alias("clean_risk_score"), F.col("verdict").alias("clean_verdict"))
    after = changed.select(key, "perturbation", F.col("risk_score").alias("perturbed_risk_score"), F.col("verdict").alias("perturbed_verdict"))
    caught, still = F.col("clean_risk_score") >= phishing_min, F.col("perturbed_risk_score") >= phishing_min
    return after.join(before, key).withColumns({"clean_detected": caught, "evasion": caught & ~still, "verdict_changed": F.col("clean_verdict") != F.col("perturbed_verdict"), "risk_score_change": F.col("perturbed_risk_score") - F.col("clean_risk_score")})


def outcome_summary(outcomes: DataFrame, by=("perturbation",)) -> DataFrame:
    """Per perturbation: samples, detected before, evasions and their rate, verdict changes, mean change of score, recall-derived F1 over positives only."""
    out = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_if("clean_detected").alias("clean_detected"), F.count_if("evasion").alias("evasions"), F.count_if("verdict_changed").alias("verdict_changes"), F.round(F.avg("risk_score_change"), 4).alias("mean_change"), F.round(F.avg((F.col("perturbed_risk_score") >= fixed.PHISHING_MIN).cast("double")), 6).alias("recall_after"))
    return out.withColumn("evasion_rate", F.round(F.coalesce(F.try_divide(F.col("evasions").cast("double"), F.col("clean_detected")), F.lit(0.0)), 4)).withColumn("recall_derived_f1", F.round(2 * F.col("recall_after") / (1 + F.col("recall_after")), 4))


def model_comparison(outcomes: dict[str, DataFrame], by=("perturbation",)) -> DataFrame:
    """The outcome summary of each named model, before and after changes, one row per perturbation and model."""
    parts = [outcome_summary(o, by).select(F.lit(name).alias("model"), "*") for name, o in outcomes.items()]
    return reduce(DataFrame.unionByName, parts)


def feature_blindness(clean: DataFrame, changed: DataFrame, key: str, features=tuple(fixed.URL_FEATURES)) -> DataFrame:
    """Per perturbation: how many feature values differ between changed and clean rows."""
    old = clean.select(key, *(F.col(c).alias(f"_{c}") for c in features))
    n = sum(((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("long") for c in features), F.lit(0))
    return changed.join(old, key).groupBy("perturbation").agg(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("values_changed"))


def search_outcomes(df: DataFrame, target: float = 0.49) -> DataFrame:
    """df (original_probability, final_probability, steps, queries) with success, absolute and relative reduction, and objective."""
    before, after = F.col("original_probability"), F.col("final_probability")
    return df.withColumns({"success": after < target, "reduction": F.round(before - after, 6), "relative_reduction": F.round(F.coalesce(F.try_divide(before - after, before), F.lit(0.0)), 6), "objective": F.round(after + 0.005 * F.col("steps"), 6)})


def compatible(outcomes: DataFrame, models: DataFrame) -> DataFrame:
    """Outcomes whose perturbation acts on what a model looks at. models: model, perturbation."""
    return outcomes.join(models.select("model", "perturbation").distinct(), "perturbation")


def worst_case_sweep(urls: DataFrame, score: Callable[[DataFrame], DataFrame], names=tuple(URL_CHANGES), key: str = "sample_id", url_col: str = "url", width: int = 3, depth: int = 3, budget: int = 50, target: float = 0.49) -> DataFrame:
    """Per row the lowest score that chains of address changes reach, all rows in lock-step.

    score adds `probability`. At each depth the kept states of unfinished rows are changed in every way,
    states seen before are dropped, and the `width` lowest objectives (probability plus 0.005 a step) stay;
    a row is finished below target or at its budget of scored states. Returns key, original_probability,
    final_probability, steps, queries, chain. Plans are cut at each depth by checkpoint().
    """
    start = score(urls.select(key, url_col)).select(key, url_col, "probability").withColumns({"steps": F.lit(0), "chain": F.array().cast("array<string>"), "queries": F.lit(1)})
    start = front = best = seen = cut(start)
    place = W.partitionBy(key).orderBy(F.col("probability") + 0.005 * F.col("steps"), url_col)
    for _ in range(depth):
        alive = front.where((F.col("probability") >= target) & (F.col("queries") < budget))
        moved = perturb_urls(alive.drop("probability"), names, url_col).withColumn("chain", F.concat("chain", F.array("perturbation"))).withColumn("steps", F.col("steps") + 1)
        fresh = moved.dropDuplicates([key, url_col]).join(seen.select(key, url_col), [key, url_col], "left_anti")
        fresh = fresh.withColumn("_order", F.row_number().over(W.partitionBy(key).orderBy(url_col))).where(F.col("queries") + F.col("_order") <= budget)
        scored = cut(score(fresh.drop("perturbation")).select(key, url_col, "probability", "steps", "chain", "queries"))
        counts = scored.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        front = cut(scored.join(counts, key).withColumn("queries", F.col("queries") + F.col("_n")).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= width).drop("_place", "_n"))
        seen = cut(seen.select(key, url_col).unionByName(scored.select(key, url_col)))
        best = best.unionByName(front)
    last = best.groupBy(key).agg(F.min_by(F.struct("probability", "steps", "chain"), F.struct(F.col("probability") + 0.005 * F.col("steps"), "steps", url_col)).alias("b"), F.max("queries").alias("queries"))
    first = start.select(key, F.col("probability").alias("original_probability"))
    return last.join(first, key).select(key, "original_probability", F.col("b.probability").alias("final_probability"), F.col("b.steps").alias("steps"), "queries", F.col("b.chain").alias("chain"))


def page_state(url: Column, elements: Column) -> Column:
    """A key of a page as it stands: two 64-bit hashes of its address and of its elements in their order."""
    plain = F.transform(elements, lambda e: F.struct(e["tag"], F.map_entries(e["attrs"]), e["text"], e["parent"], e["hidden"], e["raw"], e["form"]))
    return F.struct(F.xxhash64(url, plain).alias("a"), F.xxhash64(F.lit(7), plain, url).alias("b"))


def changed_elements(names=tuple(PAGE_CHANGES)) -> Column:
    """The row's elements after the change named in its `perturbation`; as they are for any other name."""
    return reduce(lambda kept, n: F.when(F.col("perturbation") == n, PAGE_CHANGES[n](F.col("elements"))).otherwise(kept), names, F.col("elements"))


def next_states(front: DataFrame, score: Callable[[DataFrame], DataFrame], url_names, page_names, key: str, url_col: str, banks) -> DataFrame:
    """key, parent, perturbation, url, state, probability of every change of every page state (key, state, url, elements).

    Pages are analysed once for all their page and address changes; of what a new address can move only forms and
    links are counted again. States that leave less than a tenth of a page don't count.
    """
    base = front.select(key, F.col("state").alias("parent"), url_col, F.lit(True).alias("html_available"), "elements")
    own = [x for n in page_names for x in (F.lit(n), page_state(F.col(url_col), PAGE_CHANGES[n](F.col("elements"))))]
    own += [x for n in url_names for x in (F.lit(n), page_state(URL_CHANGES[n](F.col(url_col)), F.col("elements")))]
    by_address = {f"_own_{g}": F.filter("elements", PARTS_OF[g]) for g in ("forms", "links")}
    rows = changed_page_features(base.withColumns({"_states": F.create_map(*own), **by_address}), page_names, clean=True, url_col=url_col, banks=banks).where("valid")
    case = lambda n, u: F.struct(n.alias("n"), u.cast("string").alias("u"))
    moved = F.filter(F.array(case(F.lit(CLEAN), F.lit(None)), *(case(F.lit(n), URL_CHANGES[n](F.col(url_col))) for n in url_names)), lambda x: x["u"].isNotNull())
    rows = rows.withColumn("_c", F.explode(F.when(F.col("perturbation") == CLEAN, moved).otherwise(F.array(case(F.col("perturbation"), F.col(url_col))))))
    rows = rows.withColumns({"perturbation": F.col("_c.n"), url_col: F.col("_c.u")})
    page = F.coalesce(F.col(url_col), F.lit(""))
    again = group_features("forms", F.col("_own_forms"), page) | group_features("links", F.col("_own_links"), page)
    rows = rows.withColumns({c: F.when(F.col("perturbation").isin(*url_names), v).otherwise(F.col(c)) for c, v in again.items()})
    rows = rows.withColumn("state", F.col("_states")[F.col("perturbation")]).drop("_states", "_c", *by_address, "steps", "url_changed", "length_change", "valid")
    return score(rows).select(key, "parent", "perturbation", url_col, "state", "probability")


def page_worst_cases(elements: DataFrame, score: Callable[[DataFrame], DataFrame], url_names=tuple(URL_CHANGES), page_names=tuple(PAGE_CHANGES), key: str = "sample_id", url_col: str = "url", banks=None, width: int = 3, depth: int = 3, budget: int = 50, target: float = 0.49) -> DataFrame:
    """Per page the lowest score that chains of address and page changes reach, all pages in lock-step.

    elements: key, url and the pages' elements. score adds `probability` to rows with address and page
    features. At each depth every kept state of an unfinished page is changed in every way; of equal states
    (page_state) one is kept, that of the first parent and change by name, and those met before are dropped;
    the first of the rest, in order of state, are scored up to the budget, and the `width` lowest objectives
    (probability plus 0.005 a step) stay. A page is finished when a state is below target or its budget is
    spent. Only keys, scores and chains are shuffled; the kept states' elements are made again from their
    parents' beside them, which a page has `width` of. Returns key, original_probability,
    final_probability, steps, queries, chain. Null keys are left out. Plans are cut by checkpoint().
    """
    start = elements.where(F.col(key).isNotNull()).select(key, url_col, "elements").withColumn("state", page_state(F.col(url_col), F.col("elements")))
    first = page_features(start.withColumn("html_available", F.lit(True)), url_col, banks)
    first = cut(score(first.drop("elements")).select(key, "state", "probability"))
    front = cut(start.join(first, [key, "state"]).dropDuplicates([key]).withColumns({"steps": F.lit(0), "chain": F.array().cast("array<string>"), "queries": F.lit(1)}))
    told = [key, "state", "probability", "steps", "chain", "queries"]
    best, seen = front.select(*told), front.select(key, "state")
    objective = F.col("probability") + 0.005 * F.col("steps")
    for _ in range(depth):
        done = best.where(F.col("probability") < target).select(key).distinct()
        alive = front.where(F.col("queries") < budget).join(done, key, "left_anti")
        found = cut(next_states(alive, score, url_names, page_names, key, url_col, banks))
        one = F.min(F.struct("parent", "perturbation", url_col, "probability"))
        fresh = found.groupBy(key, "state").agg(one.alias("o")).select(key, "state", "o.*").join(seen, [key, "state"], "left_anti")
        held = alive.select(key, F.col("state").alias("parent"), "steps", "chain", "queries")
        fresh = fresh.join(held, [key, "parent"]).withColumn("_order", F.row_number().over(W.partitionBy(key).orderBy("state"))).where(F.col("queries") + F.col("_order") <= budget)
        fresh = fresh.withColumns({"queries": F.col("queries") + F.max("_order").over(W.partitionBy(key)), "steps": F.col("steps") + 1, "chain": F.concat("chain", F.array("perturbation"))})
        fresh = cut(fresh.drop("_order"))
        kept = fresh.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(objective, "state"))).where(F.col("_place") <= width).drop("_place")
        parents = front.select(key, F.col("state").alias("parent"), "elements")
        front = cut(kept.join(parents, [key, "parent"]).withColumn("elements", changed_elements(page_names)).select(*told, url_col, "elements"))
        seen = cut(seen.unionByName(fresh.select(key, "state")))
        best = cut(best.unionByName(kept.select(*told)))
    last = best.groupBy(key).agg(F.min_by(F.struct("probability", "steps", "chain"), F.struct(objective, F.col("steps"), F.col("state"))).alias("b"), F.max("queries").alias("queries"))
    return last.join(first.select(key, F.col("probability").alias("original_probability")).dropDuplicates([key]), key).select(key, "original_probability", F.col("b.probability").alias("final_probability"), F.col("b.steps").alias("steps"), "queries", F.col("b.chain").alias("chain"))
