"""Scorers of candidate pairs: boosted trees, and a linear ranker learned from pairs of candidates."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.operators.pairs import SEED, lot
from affinia.sources.records import numbers

#: Settings by name: trees, depth, learning rate, share of rows for a tree.
PRESETS = {"default": (500, 6, 0.05, 0.8), "wide": (300, 5, 0.05, 1.0), "deep": (1200, 7, 0.04, 0.8), "quick": (20, 4, 0.2, 0.8)}


def assembled(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The features as one vector column; what is no number counts as 0."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(numbers(df, features))


def train(df: DataFrame, features: tuple[str, ...], preset: str = "default", validation: str | None = None) -> GBTClassificationModel:
    """Boosted trees on ``label``. validation: a boolean column; training stops when those rows no longer gain."""
    trees, depth, rate, share = PRESETS[preset]
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=SEED)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(assembled(df, features).withColumn("label", F.col("label").cast("double")))


def score(model, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """df with ``probability`` of label 1."""
    scored = model.transform(assembled(df, features))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("p", "probability")


def importance(model: GBTClassificationModel, features: tuple[str, ...], n: int = 20) -> list[tuple[str, float]]:
    """The n features that count most, in falling order."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def train_ranker(df: DataFrame, features: tuple[str, ...], negatives: int = 10, entity: str = "entity_id"):
    """A linear scorer that puts positives above negatives of the same entity.

    Each positive meets a few negatives of its entity, drawn by lot, so the pairs grow with the rows.
    Scores for single rows come from the weights: the constant cancels in differences.
    """
    rows = numbers(df, features)
    drawn = rows.filter("label = 0").withColumn("lot", lot(entity, "target_entity_id")).groupBy(entity).agg(F.slice(F.array_sort(F.collect_list(F.struct("lot", F.array(*features).alias("x")))), 1, negatives).alias("negatives"))
    met = rows.filter("label = 1").select(entity, F.array(*features).alias("a")).join(drawn, entity).withColumn("b", F.explode("negatives.x"))
    difference = F.zip_with("a", "b", lambda x, y: x - y)
    # Each difference is used in one direction, chosen by its content: both classes occur.
    turned = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    signed = met.select(F.when(turned, difference).otherwise(F.transform(difference, lambda x: -x)).alias("d"), turned.cast("double").alias("label"))
    flat = signed.select("label", *[F.col("d")[i].alias(f) for i, f in enumerate(features)])
    return LogisticRegression(labelCol="label", featuresCol="features", fitIntercept=False, regParam=0.01).fit(assembled(flat, features))


def rank_score(model, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """df with ``score``: the weighted sum of its features."""
    weights = model.coefficients.toArray().tolist()
    return numbers(df, features).withColumn("score", sum((F.col(f) * w for f, w in zip(features, weights, strict=True)), F.lit(0.0)))


def save(model, path: str) -> None:
    """Stores a fitted model, over one that is there."""
    model.write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
