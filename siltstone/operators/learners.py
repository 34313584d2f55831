"""Learners over feature vectors: thin wrappers of pyspark.ml with grouped, out-of-fold scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.splits import grouped_folds


def classifier(kind: str, seed: int = 0, weight: str | None = None):
    extra = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01, **extra)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=40, seed=seed, **extra)
    return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, seed=seed, **extra)


def fitted(train: DataFrame, vec: str, label: str, kind: str = "logistic", seed: int = 0, weight: str | None = None):
    """A standardizing pipeline, fitted on the training rows only."""
    rows = train.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    return Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_x", withMean=True), classifier(kind, seed, weight)]).fit(rows)


def scored(model, rows: DataFrame, vec: str, out: str = "score") -> DataFrame:
    named = rows.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return model.transform(named).withColumn(out, vector_to_array("probability")[1]).drop("_v", "_x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, vec: str, label: str, group: str, folds: int = 3, kind: str = "logistic", seed: int = 0) -> DataFrame:
    """``score`` of every row by a model that hasn't seen its group."""
    rows = grouped_folds(df, group, folds, seed)
    parts = [scored(fitted(rows.where(F.col("fold") != k), vec, label, kind, seed), rows.where(F.col("fold") == k), vec) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_one_source_out(df: DataFrame, vec: str, label: str, source: str, sources: list, kind: str = "logistic", seed: int = 0) -> DataFrame:
    """``score`` of each named source's rows by a model of all others."""
    parts = [scored(fitted(df.where(F.col(source) != s), vec, label, kind, seed), df.where(F.col(source) == s), vec) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def platt(rows: DataFrame, label: str, score: str, least: int = 20) -> tuple[float, float]:
    """Slope and shift of the calibrated log odds; (1, 0), the identity, for few rows, one class or a slope that isn't positive."""
    odds = F.log(F.greatest(F.col(score), F.lit(1e-6)) / F.greatest(1 - F.col(score), F.lit(1e-6)))
    seen = rows.agg(F.count("*"), F.min(label), F.max(label)).first()
    if seen[0] < least or seen[1] == seen[2]:
        return 1.0, 0.0
    fit = LogisticRegression(featuresCol="_x", labelCol="_y").fit(rows.select(array_to_vector(F.array(odds)).alias("_x"), F.col(label).cast("double").alias("_y")))
    slope = float(fit.coefficients[0])
    return (slope, float(fit.intercept)) if slope > 0 else (1.0, 0.0)


def calibrated(score: Column, slope: float, shift: float) -> Column:
    odds = F.log(F.greatest(score, F.lit(1e-6)) / F.greatest(1 - score, F.lit(1e-6)))
    return 1 / (1 + F.exp(-(F.lit(slope) * odds + F.lit(shift))))


def decision(probability: Column, gap: Column) -> tuple[Column, Column]:
    """Confidence by the gap between models, and the decision."""
    confidence = F.when(gap < 0.1, "high").when(gap < 0.25, "medium").otherwise("low")
    return confidence, F.when(gap >= 0.25, "abstain").when(probability >= 0.5, "fail").otherwise("pass")
