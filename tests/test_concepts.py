import numpy as np

from wardline.operators import models


def test_many_concepts_equal_a_plain_product(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(700, 8)), rng.normal(size=(3000, 8))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, None), (7001, []), (7002, [0.0] * 8), (7003, [float("nan")] * 8), (7004, [1.0] * 7), (7005, [None] * 8), (None, x[0].tolist()), (7006, [1e-200 * float(a) for a in x[0]])]
    concepts = [(f"c{i}", v.tolist()) for i, v in enumerate(y)] + [("c0", y[0].tolist()), (None, y[1].tolist()), ("none", None), ("zero", [0.0] * 8)]
    got = {r["k"]: r["concepts"] for r in models.concept_findings(spark.createDataFrame(vectors, "k long, v array<double>"), spark.createDataFrame(concepts, "name string, concept array<double>"), "k", "v", 0.8, block=256).collect()}
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T > 0.8
    want = {i: sorted(f"c{j}" for j in np.flatnonzero(row)) for i, row in enumerate(near) if row.any()}
    assert got == want | {None: want[0], 7006: want[0]}
    assert models.concept_findings(spark.createDataFrame(vectors, "k long, v array<double>"), spark.createDataFrame([], "name string, concept array<double>"), "k", "v").count() == 0
