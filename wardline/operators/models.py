"""Detectors as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol, HasSeed
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Settings of the trees.
BOOSTED = {"maxIter": 300, "stepSize": 0.08, "maxDepth": 5, "minInstancesPerNode": 3, "subsamplingRate": 0.85, "featureSubsetStrategy": "sqrt"}
FOREST = {"numTrees": 200, "maxDepth": 14, "featureSubsetStrategy": "sqrt"}
VOTE = (0.6, 0.4)


def require(df: DataFrame, columns: list[str], label: str = "label") -> None:
    """Raises where columns are missing or the label has one class only."""
    if missing := [c for c in [*columns, label] if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if df.select(label).distinct().limit(2).count() < 2:
        raise ValueError(f"{label} has fewer than two classes")


def balanced(df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """df with weights that make both classes weigh the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(weights, label)  # one row per class


def scaler(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Assembles columns and scales them to mean 0 and deviation 1."""
    assembler = VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="keep")
    fitted = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(assembler.transform(train))
    return PipelineModel([assembler, fitted])


def probability(prefix: str) -> Column:
    return vector_to_array(F.col(f"{prefix}_probability"))[1]


def named(prefix: str) -> dict[str, str]:
    return {"probabilityCol": f"{prefix}_probability", "rawPredictionCol": f"{prefix}_raw", "predictionCol": f"{prefix}_prediction"}


def renamed(estimator, prefix: str):
    """The estimator with outputs under its own prefix."""
    return estimator.setProbabilityCol(f"{prefix}_probability").setRawPredictionCol(f"{prefix}_raw").setPredictionCol(f"{prefix}_prediction")


class Vote(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `vote`, the weighted sum of the boosted trees' and the forest's probability, and `vote_vector`, which holds it alone."""

    weights = Param(Params._dummy(), "weights", "weights of the boosted trees and of the forest", TypeConverters.toListFloat)

    def __init__(self, weights=VOTE):
        super().__init__()
        self._setDefault(weights=list(VOTE))
        self._set(weights=list(weights))

    def _transform(self, df: DataFrame) -> DataFrame:
        boosted, forest = self.getOrDefault(self.weights)
        voted = df.withColumn("vote", boosted * probability("boosted") + forest * probability("forest"))
        return voted.withColumn("vote_vector", array_to_vector(F.array("vote"))).drop(*(f"{x}_{y}" for x in ("boosted", "forest") for y in ("raw", "prediction")))


class ComponentWriter(MLWriter):
    def __init__(self, component: Component):
        super().__init__()
        self.component = component

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.component, path, self.sparkSession)
        self.component.inner.write().save(f"{path}/stages")


class ComponentReader(MLReader):
    def load(self, path: str) -> Component:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        component = Component(PipelineModel.load(f"{path}/stages"))
        component._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(component, metadata)
        return component


class Component(Model, HasOutputCol, MLWritable, MLReadable):
    """Boosted trees and a forest that vote, calibrated by a logistic curve on validation rows.

    One pipeline of scaler, trees, vote and calibration, which can be saved, loaded and be a stage of other pipelines.
    """

    def __init__(self, inner: PipelineModel | None = None):
        super().__init__()
        self.inner = inner
        self._setDefault(outputCol="probability")

    def _transform(self, df: DataFrame) -> DataFrame:
        """df with the calibrated probability."""
        return self.inner.transform(df).select(*df.columns, probability("calibrated").alias(self.getOutputCol()))

    def importances(self, spark, columns: list[str]) -> DataFrame:
        boosted, forest, vote = self.inner.stages[2:5]
        weights = vote.getOrDefault(vote.weights)
        rows = [(c, float(boosted.featureImportances[i]), float(forest.featureImportances[i])) for i, c in enumerate(columns)]
        return spark.createDataFrame(rows, "feature string, boosted double, forest double").withColumn("importance", weights[0] * F.col("boosted") + weights[1] * F.col("forest"))

    def write(self) -> ComponentWriter:
        return ComponentWriter(self)

    @classmethod
    def read(cls) -> ComponentReader:
        return ComponentReader()


def fit_component(train: DataFrame, validation: DataFrame, columns: list[str], label: str = "label", boosted=None, forest=None, vote=VOTE, seed: int = 42) -> Component:
    prepared = scaler(train, columns)
    rows = balanced(prepared.transform(train), label).select(label, "features", "class_weight").cache()
    try:
        trees = [
            renamed(GBTClassifier(labelCol=label, seed=seed, **(BOOSTED | (boosted or {}))), "boosted").fit(rows),
            renamed(RandomForestClassifier(labelCol=label, weightCol="class_weight", seed=seed, **(FOREST | (forest or {}))), "forest").fit(rows),
        ]
    finally:
        rows.unpersist()
    voted = [*prepared.stages, *trees, Vote(vote)]
    calibration = LogisticRegression(labelCol=label, featuresCol="vote_vector", **named("calibrated"))
    return Component(PipelineModel([*voted, calibration.fit(PipelineModel(voted).transform(validation))]))


class VotedTrees(Estimator, HasInputCols, HasLabelCol, HasSeed, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """fit_component() as an estimator, for pipelines and grids: rows whose heldCol is true calibrate, all others train.

    A null in heldCol means false. Settings that aren't given are those of fit_component().
    """

    heldCol = Param(Params._dummy(), "heldCol", "true for the rows that calibrate", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    boostedDepth = Param(Params._dummy(), "boostedDepth", "depth of the boosted trees", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees of the forest", TypeConverters.toInt)
    forestDepth = Param(Params._dummy(), "forestDepth", "depth of the forest's trees", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "weights of the boosted trees and of the forest", TypeConverters.toListFloat)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(
            labelCol="label", outputCol="probability", heldCol="held", seed=42, weights=list(VOTE),
            rounds=BOOSTED["maxIter"], boostedDepth=BOOSTED["maxDepth"], trees=FOREST["numTrees"], forestDepth=FOREST["maxDepth"],
        )
        self._set(**settings)

    def _fit(self, df: DataFrame) -> Component:
        held = F.coalesce(F.col(self.getOrDefault(self.heldCol)), F.lit(False))
        got = {k: self.getOrDefault(k) for k in ("rounds", "boostedDepth", "trees", "forestDepth", "weights")}
        fitted = fit_component(
            df.where(~held), df.where(held), self.getInputCols(), self.getLabelCol(),
            {"maxIter": got["rounds"], "maxDepth": got["boostedDepth"]}, {"numTrees": got["trees"], "maxDepth": got["forestDepth"]}, got["weights"], self.getSeed(),
        )
        return fitted._set(outputCol=self.getOutputCol())


def grid_search(df: DataFrame, estimator: Estimator, grid: list[dict], fold: str = "fold", metric: str = "areaUnderROC", at_once: int = 1) -> CrossValidatorModel:
    """The estimator with the settings whose mean metric over folds is best, fitted on all of df. fold: column of whole numbers from 0.

    avgMetrics has the means in the order of the grid; of equal ones the first is best.
    """
    folds = df.agg(F.max(fold)).first()[0] + 1
    judge = BinaryClassificationEvaluator(labelCol=estimator.getLabelCol(), rawPredictionCol=estimator.getOutputCol(), metricName=metric)
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol=fold, parallelism=at_once).fit(df)


def fit_logistic(train: DataFrame, columns: list[str], label: str = "label", c: float = 1.0, prefix: str = "logistic") -> PipelineModel:
    """Standardised logistic regression; c is the inverse strength of the ridge."""
    prepared = scaler(train, columns)
    rows = prepared.transform(train)
    return PipelineModel([*prepared.stages, LogisticRegression(labelCol=label, featuresCol="features", regParam=1 / (c * max(rows.count(), 1)), **named(prefix)).fit(rows)])


def coefficients(model: PipelineModel, spark, columns: list[str]) -> DataFrame:
    last = model.stages[-1]
    return spark.createDataFrame([*((k, float(v)) for k, v in zip(columns, last.coefficients, strict=True)), ("intercept", float(last.intercept))], "feature string, coefficient double")


def fit_fusion(validation: DataFrame, url: str = "phishing_probability", page: str = "page_probability", label: str = "label", c: float = 1.0) -> tuple[float, float, float]:
    """The coefficients a, b and c of the fused score."""
    rows = VectorAssembler(inputCols=[url, page], outputCol="both").transform(validation.select(url, page, label))
    fitted = LogisticRegression(labelCol=label, featuresCol="both", regParam=1 / (c * max(rows.count(), 1)), standardization=False).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.coefficients[1]), float(fitted.intercept)


def cross_validated(df: DataFrame, columns: list[str], key: str, label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """df with a probability from a model that hasn't seen the row's fold; folds by a hash of the key."""
    dealt = df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        model = fit_logistic(dealt.where(F.col("fold") != k), columns, label, prefix="cv")
        part = model.transform(dealt.where(F.col("fold") == k)).select(*df.columns, "fold", probability("cv").alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_on_embeddings(train: DataFrame, vector: str = "embedding", label: str = "label") -> PipelineModel:
    """Logistic regression on arrays of floats, for any number of classes."""
    rows = train.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias(label))
    return PipelineModel([LogisticRegression(labelCol=label, featuresCol="features", maxIter=30, **named("embedding")).fit(rows)])


def predict_embeddings(model: PipelineModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector(F.col(vector)))).select(*df.columns, F.col("embedding_prediction").cast("int").alias("predicted"))


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds finite numbers only, and any."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return df.where((F.size(vector) > 0) & ~F.exists(vector, bad))


def packed(label: str, kind: str, rows: int):
    """For mapInArrow: (label, vector) as blocks of one dimension: the labels, and unit vectors as bytes; zero vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                same = batch.filter(pa.array(lengths == dim))
                for at in range(0, same.num_rows, rows):
                    part = same.slice(at, rows)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    # Scaled first, so that squares of very small or large numbers stay numbers.
                    size = np.abs(x).max(axis=1, keepdims=True)
                    kept = size[:, 0] > 0
                    x = x[kept] / size[kept]
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    labels = part.column(0).filter(pa.array(kept))
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels), pa.array([x.tobytes()])], ["dim", label, "data"])

    return run, f"dim int, {label} array<{kind}>, data binary"


def concept_findings(df: DataFrame, concepts: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.4, block: int = 1024) -> DataFrame:
    """key and the sorted names of concepts (name, concept) whose vector has a cosine above threshold.

    Any number of concepts: blocks of vectors meet blocks of concepts by an ordinary join on the concepts' block, and
    each pair of blocks is one product of matrices in a task, so a task holds one of either. Vectors that are null,
    empty, zero or hold nulls or no finite numbers have no concepts, nor do those of another dimension than a concept's.
    """
    named_ = whole_vectors(concepts.where("name IS NOT NULL").select("name", "concept"), "concept").distinct()
    blocks = max(1, -(-named_.count() // block))
    kind = dict(df.dtypes)[key]
    pack, schema = packed("names", "string", 2 * block)
    dealt = named_.repartition(blocks, F.xxhash64("name", "concept")).select("name", "concept").mapInArrow(pack, schema)
    groups = dealt.withColumn("block", F.pmod(F.xxhash64("data"), F.lit(blocks))).withColumnRenamed("data", "concepts")
    pack, schema = packed("keys", kind, 512)
    vectors = whole_vectors(df.select(key, vector), vector).mapInArrow(pack, schema)
    met = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(groups, ["dim", "block"])
    out = pa.schema([("found", to_arrow_type(df.schema[key].dataType)), ("name", pa.string())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column(0)[k].as_py()
                keys, names = batch.column(1)[k].values, batch.column(3)[k].values
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer()).reshape(-1, dim) for c in (2, 4))
                i, j = np.nonzero(x @ y.T > threshold)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)).cast(out.field(0).type), names.take(pa.array(j))], schema=out)

    pairs = met.select("dim", "keys", "data", "names", "concepts").mapInArrow(meet, f"found {kind}, name string")
    return pairs.groupBy(F.col("found").alias(key)).agg(F.sort_array(F.collect_set("name")).alias("concepts"))
