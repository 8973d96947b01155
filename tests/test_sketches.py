import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import sketches
from wardline.plans import data_queries

ROWS = "part int, sub string, x double, who string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for part in range(4):
        for _ in range(30_000):
            x = rng.choice([None, math.nan, math.inf, rng.gauss(1e6, 1), rng.gauss(0, 100), rng.gauss(0, 100)])
            out.append((part, rng.choice("ab"), x, rng.choice([None, str(rng.randrange(part * 15_000, part * 15_000 + 40_000))])))
    return [*out, *((9, "a", None, None) for _ in range(3))]


def test_merged_sketches_are_near_what_all_rows_give(spark, rows):
    parts = sketches.sketched(spark.createDataFrame(rows, ROWS), ["part", "sub"], ["x"], ["who", "x"]).cache()
    assert parts.count() == 9 * 2
    two = sketches.merged(parts, ["part"])
    both = [sketches.merged(parts), sketches.merged(two)]
    real = np.sort([r[2] for r in rows if r[2] is not None and math.isfinite(r[2])])
    users = {r[3] for r in rows} - {None}
    for whole in both:
        x = sketches.moments(whole).where("column_name = 'x'").first()
        assert (x["rows"], x["n"], x["nulls"]) == (len(rows), len(real), sum(r[2] is None for r in rows))
        assert [x["least"], x["largest"]] == [real[0], real[-1]]
        assert [x["mean"], x["std"]] == pytest.approx([real.mean(), real.std(ddof=1)], rel=1e-9)
        at = {r["column_name"]: r for r in sketches.estimates(whole).collect()}
        for q in sketches.QUANTILES:
            rank = np.searchsorted(real, at["x"][f"p{round(q * 100)}"], "right") / len(real)
            assert abs(rank - q) < 0.01
        assert at["who"]["p50"] is None
        for kind in ("distinct", "members"):
            assert at["who"][kind] == pytest.approx(len(users), rel=0.025)
    nulls = sketches.estimates(sketches.merged(parts, ["part"]).where("part = 9"), ["part"]).collect()
    assert [(r["n"], r["p50"], r["distinct"], r["members"]) for r in nulls] == [(0, None, 0, 0)] * 2 and len(nulls) == 2
    empty = sketches.sketched(spark.createDataFrame([], ROWS), ["part"], ["x"], ["who"])
    assert sketches.merged(empty).count() == 0


def test_overlaps_of_set_sketches(spark, rows):
    parts = sketches.sketched(spark.createDataFrame(rows, ROWS), ["part", "sub"], [], ["who"])
    got = sketches.sketched_overlaps(parts, "part", [0, 1, 2, 3, 9, 77]).first()
    users = {p: {r[3] for r in rows if r[0] == p} - {None} for p in (0, 1, 2, 3, 9, 77)}
    for a, b in combinations(users, 2):
        assert abs(got[f"{a}_{b}"] - len(users[a] & users[b])) <= 0.025 * len(users[a] | users[b])
    assert got["0_3"] < got["0_1"] and got["0_9"] == got["0_77"] == 0


def test_small_tables_are_counted_exactly(spark, sf_dir):
    """The registered estimates on a table whose values all fit their sketches."""
    events = data_queries.events(spark, sf_dir).withColumn("day", F.dayofweek("ts")).toPandas()
    got = {(r["day"], r["column_name"]): r for r in data_queries.sketched_estimates(spark, sf_dir).collect()}
    days = {d: g for d, g in events.groupby("day")}
    assert set(got) == {(d, c) for d in [None, *days] for c in ("value", "user_id", "event_type")}
    for d, rows in [(None, events), *days.items()]:
        assert got[d, "user_id"]["members"] == rows.user_id.nunique() and got[d, "event_type"]["distinct"] == rows.event_type.nunique()
        values = np.sort(rows.value.dropna())
        rank = np.searchsorted(values, [got[d, "value"]["p50"]], "left")[0] / len(values), np.searchsorted(values, [got[d, "value"]["p50"]], "right")[0] / len(values)
        assert rank[0] - 0.01 <= 0.5 <= rank[1] + 0.01
    users = {d: set(g.user_id) for d, g in days.items()}
    shared = data_queries.sketched_overlaps(spark, sf_dir).where("column_name = 'user_id'").first()
    assert all(shared[f"{a}_{b}"] == len(users.get(a, set()) & users.get(b, set())) for a, b in combinations(data_queries.DAYS, 2))


def test_overlaps_of_more_values_than_a_sketch_holds(spark, rows):
    """With the rows beside them, overlaps are exact past the sketches' bound; nulls and small columns too."""
    df = spark.createDataFrame(rows, ROWS)
    parts = sketches.sketched(df, ["part", "sub"], [], ["who", "sub"])
    names = [0, 1, 2, 3, 9, 77]
    got = {r["column_name"]: r for r in sketches.sketched_overlaps(parts, "part", names, df).collect()}
    for c, k in (("who", 3), ("sub", 1)):
        held = {p: {r[k] for r in rows if r[0] == p} - {None} for p in names}
        assert all(got[c][f"{a}_{b}"] == len(held[a] & held[b]) for a, b in combinations(names, 2))
    assert set(got) == {"who", "sub"}
