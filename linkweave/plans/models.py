"""Scoring models on labelled pairs: logistic, boosted trees, cross-fitting, isotonic calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators.decide import cross_fitted


def in_sample(rate: float, *keys: str, seed: int = 2026) -> Column:
    """Whether a row falls into a deterministic sample of its keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)


def sampled(pairs: DataFrame, negative_rate: float, seed: int = 2026) -> DataFrame:
    """All positives and a hash sample of the negatives, weighted back by 1 / rate."""
    kept = pairs.where((F.col("label") == 1) | in_sample(negative_rate, "s1", "t", seed=seed))
    return kept.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(1 / negative_rate))


def logistic(features: list[str], max_iter: int = 100, c: float = 1.0) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True)
    return Pipeline(stages=[assembler, scaler, LogisticRegression(featuresCol="__features", weightCol="weight", maxIter=max_iter, regParam=1e-6 / c)])


def trees(features: list[str], rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 2026) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    return Pipeline(stages=[assembler, GBTClassifier(featuresCol="__features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)])


def probability(model, pairs: DataFrame, name: str) -> DataFrame:
    out = model.transform(pairs).withColumn(name, vector_to_array("probability")[1])
    return out.drop("__raw", "__features", "rawPrediction", "probability", "prediction")


def cross_fit(pipeline: Pipeline, pairs: DataFrame, negative_rate: float = 1.0) -> tuple:
    """Models fitted on folds {0, 1} and {2, 3}; rows of other folds are never seen."""
    rows = sampled(pairs, negative_rate)
    return tuple(pipeline.fit(rows.where(F.col("fold").isin(*folds))) for folds in ((0, 1), (2, 3)))


def cross_scores(models: tuple, pairs: DataFrame) -> DataFrame:
    """p: of the model that has not seen the row's fold, or the mean of both."""
    a, b = models
    both = probability(b, probability(a, pairs, "__a"), "__b")
    return both.withColumn("p", cross_fitted(F.col("__a"), F.col("__b"), F.col("fold"))).drop("__a", "__b")


def calibrate(scores: DataFrame, folds: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """p through an isotonic fit on the out-of-fold scores of the open folds, within [0, 1]."""
    model = IsotonicRegression(featuresCol="p", labelCol="label").fit(scores.where(F.col("fold").isin(*folds)).select(F.col("p"), F.col("label").cast("double").alias("label")))
    out = model.transform(scores.withColumnRenamed("p", "__p").withColumn("p", F.col("__p")))
    return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))).drop("prediction", "__p")
