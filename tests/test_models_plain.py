"""Fitted models against plain fits of the same objective, and held-out accuracy of those with no closed rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from wardline.functions import fixed, urls
from wardline.operators import models, robustness
from wardline.plans import data_queries, robustness_queries


def newton(x, y, ridge, rounds=60):
    """Weights and intercept of the mean logistic loss plus ridge / 2 x the squared weights."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty)
        w -= np.linalg.solve(hessian, x.T @ (p - y) / len(x) + penalty * w)
    return w


def area(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_logistic_and_fusion_equal_plain_fits(spark, sf_dir):
    train, validation, _ = data_queries.split_rows(spark, sf_dir)
    rows = train.select(*data_queries.COLUMNS, "label").toPandas().astype(float)
    x, y = rows[data_queries.COLUMNS].to_numpy(), rows.label.to_numpy()
    want = newton((x - x.mean(0)) / x.std(0, ddof=1), y, 1 / len(x))
    got = {r["feature"]: r["coefficient"] for r in data_queries.logistic_model(spark, sf_dir).collect()}
    assert [got[c] for c in (*data_queries.COLUMNS, "intercept")] == pytest.approx(want.tolist(), abs=2e-3)
    held = validation.select("score", "score2", "label").toPandas().astype(float)
    want = newton(held[["score", "score2"]].to_numpy(), held.label.to_numpy(), 1 / len(held))
    assert models.fit_fusion(validation, "score", "score2") == pytest.approx(want.tolist(), abs=2e-3)


def test_cross_validation_is_five_plain_fits(spark, sf_dir):
    got = data_queries.cross_validation(spark, sf_dir).toPandas().set_index("doc_id")
    rows = data_queries.labelled(spark, sf_dir).select("doc_id", "toxic", *data_queries.COLUMNS).toPandas().set_index("doc_id").astype(float)
    x, y, fold = rows[data_queries.COLUMNS].to_numpy(), rows.toxic.to_numpy(), got.fold[rows.index].to_numpy()
    assert sorted(set(fold)) == list(range(5))
    for k in range(5):
        a, b = fold != k, fold == k
        mean, deviation = x[a].mean(0), x[a].std(0, ddof=1)
        w = newton((x[a] - mean) / deviation, y[a], 1 / a.sum())
        want = 1 / (1 + np.exp(-((x[b] - mean) / deviation @ w[:-1] + w[-1])))
        assert got.probability[rows.index[b]].to_numpy() == pytest.approx(want, abs=2e-3)


def test_components_and_importances_tell_classes_apart(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 0.2).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, label int")
    parts = [df.where(F.col("id") % 3 == k) for k in range(3)]
    component = models.fit_component(parts[0], parts[1], ["a", "b", "c"], **data_queries.SMALL)
    out = component.transform(parts[2]).toPandas()
    assert area(out.label.to_numpy(), out.probability.to_numpy()) > 0.93 and out.probability.between(0, 1).all()
    weights = {r["feature"]: r["importance"] for r in component.importances(spark, ["a", "b", "c"]).collect()}
    assert weights["a"] > weights["b"] > weights["c"] and sum(weights.values()) == pytest.approx(1)


def test_embeddings_and_pages_are_told_apart(spark, sf_dir):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 8)) * 3
    rows = [(i, (centres[i % 3] + rng.normal(size=8)).tolist(), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    out = models.predict_embeddings(models.fit_on_embeddings(df.where("vec_id < 200")), df.where("vec_id >= 200")).toPandas()
    assert (out.label == out.predicted).mean() > 0.95
    pages = robustness_queries.hybrid_model(spark, sf_dir).toPandas()
    want = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").rlike("[?#]").cast("int").alias("y")).toPandas().set_index("page_id").y
    assert area(want[pages.page_id].to_numpy(), pages.model_probability.to_numpy()) > 0.7
    assert (pages.risk_score == (0.6 * pages.structural_score + 0.4 * np.floor(pages.model_probability * 100 + 0.5)).round()).mean() > 0.9


def odd_table(spark, n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0.1 * rng.normal(size=n)).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 2, True if i % 5 == 3 else None) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, label int, fold int, held boolean").coalesce(2).cache()


def test_components_are_saved_loaded_and_stages_of_pipelines(spark, tmp_path):
    df = odd_table(spark)
    trees = models.VotedTrees(inputCols=["a", "b", "c"], rounds=3, boostedDepth=2, trees=3, forestDepth=3, weights=[0.7, 0.3], outputCol="p")
    trees.write().save(f"{tmp_path}/estimator")
    again = models.VotedTrees.load(f"{tmp_path}/estimator")
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in trees.extractParamMap().items()}
    fitted = Pipeline(stages=[again]).fit(df)
    plain = models.fit_component(df.where("held IS NULL"), df.where("held"), ["a", "b", "c"], boosted={"maxIter": 3, "maxDepth": 2}, forest={"numTrees": 3, "maxDepth": 3}, vote=(0.7, 0.3))
    fitted.write().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    scores = [[r[-1] for r in m.transform(df).orderBy("id").collect()] for m in (fitted, loaded, plain)]
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0])) > 5
    assert loaded.transform(df).columns == [*df.columns, "p"]
    both = [sorted(map(tuple, m.importances(spark, ["a", "b", "c"]).collect())) for m in (loaded.stages[0], plain)]
    assert both[0] == both[1]
    with pytest.raises(Exception, match="(?i)exist"):
        fitted.write().save(f"{tmp_path}/model")
    fitted.write().overwrite().save(f"{tmp_path}/model")


def test_grid_search_is_a_plain_loop(spark):
    df = odd_table(spark)
    trees = models.VotedTrees(inputCols=["a", "b", "c"], rounds=2, trees=2, forestDepth=2)
    grid = ParamGridBuilder().addGrid(trees.boostedDepth, [1, 4]).build()
    found = models.grid_search(df, trees, grid)
    means = []
    for depth in (1, 4):
        areas = []
        for k in (0, 1):
            rest = df.where(F.col("fold") != k)
            fitted = models.fit_component(rest.where("held IS NULL"), rest.where("held"), ["a", "b", "c"], boosted={"maxIter": 2, "maxDepth": depth}, forest={"numTrees": 2, "maxDepth": 2})
            out = fitted.transform(df.where(F.col("fold") == k)).toPandas()
            areas.append(area(out.label.to_numpy(), out.probability.to_numpy()))
        means.append(np.mean(areas))
    assert found.avgMetrics == pytest.approx(means, abs=1e-9)
    best = models.fit_component(df.where("held IS NULL"), df.where("held"), ["a", "b", "c"], boosted={"maxIter": 2, "maxDepth": (1, 4)[int(np.argmax(means))]}, forest={"numTrees": 2, "maxDepth": 2})
    got, want = ([r["probability"] for r in m.transform(df).orderBy("id").collect()] for m in (found.bestModel, best))
    assert got == want


def test_retrained_models_are_plain_fits_with_and_without_changed_rows(spark):
    """Both models and all counts, from features that Spark computes and fits and sums that numpy does."""
    columns = list(fixed.URL_FEATURES)
    train, test = (x.cache() for x in robustness_queries.addresses(spark, "/root/testdata/sf0.01"))
    names = list(robustness.URL_CHANGES)
    features = lambda df: urls.url_features(df).select(*(c for c in df.columns if c != "url"), *columns).toPandas()
    own, copies = features(train), features(robustness.perturb_urls(train.where("label = 1"), names))
    clean, moved = features(test.where("label = 1").select("page_id", "url")), features(robustness.perturb_urls(test.where("label = 1").select("page_id", "url"), names))
    got = {(r["model"], r["perturbation"]): r for r in robustness_queries.retrained_comparison(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 2 * moved.perturbation.nunique() and len(copies) > 50
    for model, rows in (("original", own), ("retrained", pd.concat([own, copies.drop(columns="perturbation")]))):
        x, y = rows[columns].to_numpy(float), rows.label.to_numpy(float)
        mean, deviation = x.mean(0), x.std(0, ddof=1)
        scale = np.where(deviation > 0, deviation, np.inf)
        w = newton((x - mean) / scale, y, 1 / len(x))
        score = lambda f: 100 / (1 + np.exp(-((f[columns].to_numpy(float) - mean) / scale @ w[:-1] + w[-1])))  # noqa: E731, B023
        before = dict(zip(clean.page_id, score(clean), strict=True))
        for name, part in moved.groupby("perturbation"):
            after, old, row = score(part), np.array([before[i] for i in part.page_id]), got[model, name]
            unsure = sum(np.min(np.abs(np.stack([old, after]) - (fixed.PHISHING_MIN - 0.5)), axis=0) < 0.2)
            assert row["samples"] == len(part)
            assert row["mean_change"] == pytest.approx(np.mean(after - old), abs=0.6)
            caught, still = old >= fixed.PHISHING_MIN - 0.5, after >= fixed.PHISHING_MIN - 0.5
            assert abs(row["clean_detected"] - caught.sum()) <= unsure and abs(row["evasions"] - (caught & ~still).sum()) <= unsure
