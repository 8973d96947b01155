"""Operators that once held a whole key in one task, against plain versions on tables with a hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import augment, evaluation, splits, summaries
from wardline.operators.cleaning import running_sums
from wardline.streaming import streams


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, "hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randint(0, 40_000), round(rng.random(), 2)) for i in range(900)]
    return data, spark.createDataFrame(data, "id long, k string, s int, v double").repartition(9)


def test_running_sums(rows):
    data, df = rows
    for by in ([], ["k"]):
        got = {r["id"]: (r["v_upto"], r["v_all"]) for r in running_sums(df, F.col("id"), ["v"], by).collect()}
        upto, whole = {}, {}
        for _, k, _, v in data:
            whole[k if by else 0] = whole.get(k if by else 0, 0) + v
        for i, k, _, v in data:
            key = k if by else 0
            upto[key] = upto.get(key, 0) + v
            assert got[i] == pytest.approx((upto[key], whole[key]))


def test_exact_quantiles(rows):
    data, df = rows
    nulls = df.withColumn("v", F.when(F.col("id") % 50 > 0, F.col("v"))).withColumn("k", F.when(F.col("k") != "a", F.col("k")))
    got = {r["k"]: r for r in summaries.profile(nulls, ["v"], ["k"]).collect()}
    for k in ("hot", "b", "c", None):
        own = [v for i, x, _, v in data if (x if x != "a" else None) == k and i % 50]
        assert [got[k][f"p{round(q * 100)}"] for q in summaries.QUANTILES] == pytest.approx(np.quantile(own, summaries.QUANTILES).round(6).tolist())
    assert summaries.profile(df.limit(0), ["v"]).first()["n"] == 0


@pytest.mark.parametrize("ttl", [300, 7, 90_000])
def test_reuse(rows, ttl):
    data, df = rows
    timed = df.withColumn("at", F.timestamp_seconds("s"))
    got = {r["id"]: r["fresh"] for r in summaries.ttl_reuse(timed, ["k"], "at", "id", ttl).collect()}
    last = {}
    for i, k, s, _ in sorted(data, key=lambda x: (x[2], x[0])):
        fresh = k not in last or s - last[k] >= ttl
        if fresh:
            last[k] = s
        assert got[i] == fresh


def test_reuse_with_a_tie_that_other_keys_have(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 5), ("a", 2, 3), ("b", 2, 400), (None, 1, 0), (None, 2, 1)], "k string, id int, s int").withColumn("at", F.timestamp_seconds("s"))
    got = sorted((str(r["k"]), r["id"], r["fresh"]) for r in summaries.ttl_reuse(df, ["k"], "at", "id", 300).collect())
    assert got == [("None", 1, True), ("None", 2, False), ("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 2, True)]


def test_fixed_counts_and_draws(rows):
    data, df = rows
    got = {r["id"]: r["split"] for r in splits.fixed_count_split(df, {"hot": {"train": 100, "test": 50}, "a": {"train": 5}}, "id", "k").collect()}
    for k, sizes in (("hot", (100, 50)), ("a", (5, 0)), ("b", (0, 0))):
        own = [i for i, x, *_ in data if x == k]
        assert [got[i] for i in own] == ["train"] * sizes[0] + ["test"] * sizes[1] + [None] * (len(own) - sum(sizes))
    drawn = augment.bootstrap_noise(df, ["v"], 40, "id", "k").toPandas()
    assert drawn.groupby("k").size().to_dict() == {"hot": 40, "a": 40, "b": 40, "c": 40} and drawn.v.min() >= 0
    label = {i: k for i, k, *_ in data}
    assert all(label[r.id] == r.k for r in drawn.itertuples()) and drawn[drawn.k == "hot"].id.nunique() > 25
    plain = augment.bootstrap_noise(df, ["v"], 40, "id", "k", sigma=0.0).toPandas()
    value = {i: v for i, _, _, v in data}
    assert all(value[r.id] == r.v for r in plain.itertuples())


def test_areas(rows):
    data, df = rows
    labelled = df.withColumn("label", (F.col("s") % 3 == 0).cast("int"))
    pos, neg = ([v for _, _, s, v in data if (s % 3 == 0) == want] for want in (True, False))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert evaluation.roc_auc(labelled, "label", "v").first()["roc_auc"] == pytest.approx(area, abs=1e-6)
    points = sorted({v for *_, v in data}, reverse=True)
    r, p = [0.0], [1.0]
    for t in points:
        tp, fp = sum(v >= t for v in pos), sum(v >= t for v in neg)
        r.append(tp / len(pos))
        p.append(tp / (tp + fp))
    got = evaluation.pr_areas(labelled, "label", "v").first()
    assert got["pr_auc"] == pytest.approx(np.trapezoid(p, r), abs=1e-6)
    assert got["average_precision"] == pytest.approx(sum((b - a) * x for a, b, x in zip(r, r[1:], p[1:], strict=False)), abs=1e-6)


def test_a_restarted_stream_loses_and_doubles_nothing(spark, tmp_path):
    page = "<p>" + "word " * 60 + "</p>"
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    seen = 0
    for start in (0, 40):
        part = [(i, f"http://a.test/{i}" if i % 7 else "x", page) for i in range(start, start + 40)]
        spark.createDataFrame(part, "page_id int, url string, html string").repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema("page_id int, url string, html string").option("maxFilesPerTrigger", 1).parquet(source)
        streams.ingest_stream(stream, out, state).awaitTermination()
        ids = sorted(r["page_id"] for r in spark.read.parquet(out).collect())
        assert ids == [i for i in range(start + 40) if i % 7] and len(ids) > seen
        seen = len(ids)
    streams.ingest_stream(spark.readStream.schema("page_id int, url string, html string").parquet(source), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == seen


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from wardline.sources.shared import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(sparkContext=context))
