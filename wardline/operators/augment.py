"""Training-set augmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.cleaning import union_all, with_places
from wardline.operators.robustness import URL_CHANGES, model_comparison, paired_outcomes, perturb_urls


def replicate(df: DataFrame, n: int, name: str = "copy") -> DataFrame:
    """Every row n times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def bootstrap_noise(df: DataFrame, columns: list[str], n_per_class: int, key: str, label: str = "label", sigma: float = 0.08, seed: int = 42) -> DataFrame:
    """n rows per class drawn with replacement, with Gaussian noise on columns, never below 0.

    Draw d of a class takes the row whose place in key order is a hash of d: draws are spread over tasks
    and the same in every run. Noise is sigma x the value's own size plus one. Places come from ranges of
    the key, so no task holds a class.
    """
    placed = with_places(df, key, label, "_place").withColumn("_place", F.col("_place") - 1)
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    draws = classes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_per_class)))).withColumn("_place", F.pmod(F.xxhash64(label, "draw", F.lit(seed)), F.col("_n")).cast("long"))
    drawn = draws.select(label, "draw", "_place").join(placed, [label, "_place"]).drop("_place")
    unit = lambda c, k: F.pmod(F.xxhash64(F.col(label), F.col("draw"), F.lit(c), F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    noise = {c: F.sqrt(-2 * F.ln(F.greatest(unit(c, 1), F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * unit(c, 2)) for c in columns}
    return drawn.withColumns({c: F.greatest(F.col(c) + sigma * (F.abs(F.col(c)) + 1) * n, F.lit(0.0)) for c, n in noise.items()})


def with_hard_negatives(train: DataFrame, negatives: DataFrame) -> DataFrame:
    return union_all(train.withColumn("is_hard_negative", F.lit(False)), negatives.withColumn("is_hard_negative", F.lit(True)).withColumn("label", F.lit(0)))


def round_robin(df: DataFrame, key: str, names: list[str], column: str = "assigned") -> DataFrame:
    """Names dealt in turn by sorted key."""
    at = (F.col("_place") - 1) % len(names)
    return with_places(df, key, name="_place").withColumn(column, F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))).drop("_place")


def changed_copies(df: DataFrame, key: str, names: list[str], label: str = "label", url_col: str = "url") -> DataFrame:
    """Training rows: each positive row once per change of its address that applies, changed, with a key of its own and its source's key."""
    return perturb_urls(perturbed_source(df.where(F.col(label) == 1), key), names, url_col).withColumn(key, F.concat_ws("__", F.col(key).cast("string"), "perturbation"))


def one_changed_copy(df: DataFrame, key: str, names: list[str], label: str = "label", url_col: str = "url") -> DataFrame:
    """Training rows: each positive row once, changes of its address dealt in turn by sorted key; rows to which theirs doesn't apply are left out."""
    rows = round_robin(perturbed_source(df.where(F.col(label) == 1), key), key, names, "perturbation")
    address = F.coalesce(*(F.when(F.col("perturbation") == n, URL_CHANGES[n](F.col(url_col))) for n in names))
    return rows.withColumn(url_col, address).where(F.col(url_col).isNotNull()).withColumn(key, F.concat_ws("__", F.col(key).cast("string"), "perturbation"))


def perturbed_source(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("source_id", F.col(key))


def perturbed_copies(df: DataFrame, key: str, names: list[str], label: str = "label") -> DataFrame:
    """Each positive row once per perturbation, with a key of its own and its source's key."""
    rows = df.where(F.col(label) == 1).withColumn("perturbation", F.explode(F.array(*map(F.lit, names))))
    return rows.withColumn("source_id", F.col(key)).withColumn(key, F.concat_ws("__", F.col(key).cast("string"), "perturbation"))


def one_perturbed_copy(df: DataFrame, key: str, names: list[str], label: str = "label") -> DataFrame:
    """Each positive row once, perturbations dealt in turn."""
    rows = round_robin(df.where(F.col(label) == 1), key, names, "perturbation")
    return rows.withColumn("source_id", F.col(key)).withColumn(key, F.concat_ws("__", F.col(key).cast("string"), "perturbation"))


def retrained_outcomes(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], names: list[str], key: str = "sample_id", label: str = "label", url_col: str = "url") -> DataFrame:
    """How a model fitted on train ("original") and one fitted on train and on changed copies of its positive rows ("retrained") stand changes of addresses.

    One row per model and change, over the positive rows of test, none of which either model has seen. fit takes rows
    with address and label and gives the function that scores rows: it adds risk_score and verdict.
    """
    rows = train.select(url_col, label)
    copies = changed_copies(train, key, names, label, url_col).select(url_col, label)
    positive = test.where(F.col(label) == 1).select(key, url_col)
    moved = perturb_urls(positive, names, url_col)
    scores = {"original": fit(rows), "retrained": fit(rows.unionByName(copies))}
    return model_comparison({name: paired_outcomes(score(positive), score(moved), key) for name, score in scores.items()})
