"""Chains of address and page changes against a plain search that holds every state of ten pages; thresholds by suffix sums against counting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import evaluation, pages, robustness
from wardline.plans.robustness_queries import page_score_of
from wardline.sources.elements import page_elements

MADE = [
    (1, "https://a.example.com/login?x=1", "<title>Log in</title><body><p>Verify your account, urgent payment.</p><form action='http://o.example.net/go'><input type=password><input type=text name=u></form></body>"),
    (2, "http://paypa1.com/signin", "<body><p>password login now urgent</p><a href='http://x.example.org/q'>sign in</a><iframe></iframe></body>"),
    (3, "http://b.example.org/", "plain words"), (4, "http://c.example.org/account/verify", "<p>act now, last chance, expires today</p><form><input type=email></form>"),
    (5, "http://d.example.org/", None), (6, "http://e.example.tk/secure#f", "<input type=password>"), (7, "http://e.example.tk/secure", "<p>invoice card pay</p><script>1</script>"),
    (8, "http://f.example.xyz/password", "<p style='display:none'>password</p><p>username</p>"), (9, "http://g.example.com/q?next=http://h", "<form onsubmit=\"this.action='http://z.test/a'\"><input type=password></form>"), (10, "http://1.2.3.4/", "<p>login</p>"),
]


def plain_search(spark, start, width, depth, budget, target):
    """Every state as a Python value: analysed whole, equal ones found by their text."""
    key = lambda r: (r["url"], json.dumps([[e["tag"], sorted((e["attrs"] or {}).items()), e["text"], e["parent"], e["hidden"], e["raw"], e["form"]] for e in r["elements"]]))
    scored = lambda df: page_score_of(pages.page_features(df.withColumn("html_available", F.lit(True)))).select("page_id", "probability", "perturbation", "parent", "url", "elements", "state").collect()
    rows = start.withColumns({"parent": F.lit(None).cast("string"), "perturbation": F.lit(""), "state": robustness.page_state(F.col("url"), F.col("elements"))})
    out, front = {}, {}
    for r in scored(rows):
        out[r["page_id"]] = {"first": r["probability"], "best": (r["probability"], 0, (), r["state"]), "queries": 1, "seen": {key(r)}, "done": r["probability"] < target}
        front[r["page_id"]] = [(r, 0, ())]
    for _ in range(depth):
        states = [(p, json.dumps([r["state"]["a"], r["state"]["b"]]), r["url"], r["elements"]) for p, held in front.items() if not out[p]["done"] and out[p]["queries"] < budget for r, _, _ in held]
        if not states:
            break
        df = spark.createDataFrame(states, f"page_id long, parent string, url string, elements {start.schema['elements'].dataType.simpleString()}")
        moved = robustness.perturb_pages(df).where("valid").drop("steps", "url_changed", "length_change", "valid").unionByName(robustness.perturb_urls(df))
        found = scored(moved.withColumn("state", robustness.page_state(F.col("url"), F.col("elements"))))
        parents = {(p, json.dumps([r["state"]["a"], r["state"]["b"]])): (n, chain) for p, held in front.items() for r, n, chain in held}
        for p in {r["page_id"] for r in found}:
            mine, own = out[p], {}
            for r in sorted((r for r in found if r["page_id"] == p), key=lambda r: (*json.loads(r["parent"]), r["perturbation"], r["url"])):
                if key(r) not in mine["seen"]:
                    own.setdefault(key(r), r)
            fresh = sorted(own.values(), key=lambda r: (r["state"]["a"], r["state"]["b"]))[: budget - mine["queries"]]
            mine["queries"] += len(fresh)
            mine["seen"] |= {key(r) for r in fresh}
            ranked = sorted(((r["probability"] + 0.005 * (parents[p, r["parent"]][0] + 1), r["state"]["a"], r["state"]["b"], r) for r in fresh), key=lambda x: x[:3])[:width]
            front[p] = [(r, parents[p, r["parent"]][0] + 1, (*parents[p, r["parent"]][1], r["perturbation"])) for *_, r in ranked]
            for r, n, chain in front[p]:
                rank = lambda b: (b[0] + 0.005 * b[1], b[1], b[3]["a"], b[3]["b"])
                mine["best"] = min(mine["best"], (r["probability"], n, chain, r["state"]), key=rank)
                mine["done"] |= r["probability"] < target
    return {p: (m["first"], m["best"][0], m["best"][1], m["queries"], m["best"][2]) for p, m in out.items()}


def test_worst_pages_equal_a_plain_search(spark):
    start = page_elements(spark.createDataFrame(MADE, "page_id long, url string, html string")).select("page_id", "url", "elements").persist()
    for width, depth, budget, target in ((2, 2, 40, 0.2),):
        got = robustness.page_worst_cases(start, page_score_of, key="page_id", width=width, depth=depth, budget=budget, target=target).collect()
        assert {r["page_id"]: (r["original_probability"], r["final_probability"], r["steps"], r["queries"], tuple(r["chain"])) for r in got} == plain_search(spark, start, width, depth, budget, target)
        assert any(any(c.startswith("page_") for c in r["chain"]) for r in got) and any(r["final_probability"] < r["original_probability"] for r in got)
    start.unpersist()


def test_pages_are_analysed_once_for_all_changes(spark):
    """One analysis gives the states of page and address changes alike; forms and links follow the new address."""
    start = page_elements(spark.createDataFrame(MADE, "page_id long, url string, html string")).select("page_id", "url", "elements").withColumn("state", robustness.page_state(F.col("url"), F.col("elements")))
    score = lambda df: df.withColumn("probability", F.length("text_length").cast("double") + F.size("form_actions") + F.length(F.array_join("form_actions", " ")))
    found = robustness.next_states(start, score, tuple(robustness.URL_CHANGES), tuple(robustness.PAGE_CHANGES), "page_id", "url", None)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    moved = robustness.perturb_urls(start).withColumn("html_available", F.lit(True))
    want = score(pages.page_features(moved.withColumn("state", robustness.page_state(F.col("url"), F.col("elements")))))
    key = lambda df: sorted(map(str, df.select("page_id", "perturbation", "url", "state", "probability").collect()))
    assert key(found.where(F.col("perturbation").isin(*robustness.URL_CHANGES))) == key(want)


@pytest.mark.parametrize("kind", ["double", "int"])
def test_thresholds_by_suffix_sums(spark, kind):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 1, None, 2]), rng.choice([None, rng.randint(0, 100), 50]) if kind == "int" else rng.choice([None, rng.random(), 0.5, 0.1, float("nan")])) for _ in range(3_000)]
    df = spark.createDataFrame(rows, f"label int, score {kind}")
    at_least = lambda s, t: s != s or s >= t
    known = [(y, s) for y, s in rows if s is not None and y in (0, 1)]
    if kind == "double":
        got = {r["threshold"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in evaluation.threshold_sweep(df).collect()}
        assert got == {round(k * 0.01, 6): tuple(sum(y == side and at_least(s, round(k * 0.01, 6)) == yes for y, s in known) for side, yes in ((0, False), (0, True), (1, False), (1, True))) for k in range(10, 91)}
    else:
        got = {(r["safe_max"], r["phish_min"]): (r["tp"], r["fp"], r["suspicious"]) for r in evaluation.threshold_grid(df, [10, 30, 50], [30, 50, 70], "suspicious").collect()}
        assert got == {(a, b): (sum(y == 1 and s >= a for y, s in known), sum(y == 0 and s >= a for y, s in known), sum(a <= s < b for _, s in known)) for a in (10, 30, 50) for b in (30, 50, 70) if a < b}
    assert evaluation.threshold_sweep(df.limit(0)).count() == 0 and evaluation.threshold_sweep(df.where("score IS NULL")).count() == 0


def test_no_row_is_multiplied_by_thresholds(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2).cast("int").alias("label"), F.rand(3).alias("score"))
    for out in (evaluation.threshold_sweep(df), evaluation.threshold_grid(df, [0.1, 0.2], [0.5, 0.7]), evaluation.threshold_sensitivity(df, [(0.1, 0.5), (0.2, 0.6)])):
        plan = out._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Expand" not in plan and out.count() > 0
