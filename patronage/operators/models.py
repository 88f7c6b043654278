"""Churn classifiers on Spark MLlib.

Every fit takes a table with one numeric column per feature and a 0/1 label and returns a
``PipelineModel`` whose first stage assembles the features, so scoring keeps the customer key.
Training data is read many times; pass a settled or cached table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators import boosting, network
from patronage.operators.labels import with_class_weight

MODEL_NAMES = {
    "lr": "Logistic Regression",
    "rf": "Random Forest",
    "gbt": "Gradient Boosting (level-wise)",
    "gbt_sampled": "Gradient Boosting (sampled)",
    "mlp": "Neural Network",
    "network": "Neural Network (ReLU, dropout)",
    "boosted": "Second-Order Boosting (level-wise)",
    "boosted_leaf": "Second-Order Boosting (leaf-wise)",
}


def _fit(estimator, train: DataFrame, features: Sequence[str]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(train)


def _weighted(train: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, dict]:
    return (with_class_weight(train, label), {"weightCol": "weight"}) if balanced else (train, {})


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "churn",
                 balanced: bool = False, max_iter: int = 1000, c: float = 1.0) -> PipelineModel:
    """L2 logistic regression with inverse strength ``c`` on the summed loss."""
    rows = max(train.count(), 1)
    data, weight = _weighted(train, label, balanced)
    return _fit(LogisticRegression(
        labelCol=label, featuresCol="features", maxIter=max_iter, regParam=1.0 / (c * rows),
        elasticNetParam=0.0, standardization=False, **weight), data, features)


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "churn",
               balanced: bool = False, trees: int = 100, max_depth: int = 10,
               seed: int = 42) -> PipelineModel:
    data, weight = _weighted(train, label, balanced)
    return _fit(RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=max_depth, seed=seed,
        featureSubsetStrategy="sqrt", cacheNodeIds=False, **weight), data, features)


def fit_boosting(train: DataFrame, features: Sequence[str], label: str = "churn",
                 rounds: int = 100, max_depth: int = 6, rate: float = 0.1, seed: int = 42,
                 sampled: bool = False) -> PipelineModel:
    """Boosted trees; ``sampled`` draws rows per round and uses coarse bins, which is faster."""
    extra = {"subsamplingRate": 0.8, "maxBins": 64} if sampled else {}
    return _fit(GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=max_depth,
        stepSize=rate, seed=seed, **extra), train, features)


def fit_perceptron(train: DataFrame, features: Sequence[str], label: str = "churn",
                   hidden: Sequence[int] = (64, 32, 16), max_iter: int = 50,
                   seed: int = 42) -> PipelineModel:
    """Feed-forward network; expects scaled features."""
    return _fit(MultilayerPerceptronClassifier(
        labelCol=label, featuresCol="features", layers=[len(features), *hidden, 2],
        maxIter=max_iter, seed=seed), train, features)


def fit_second_order(train: DataFrame, features: Sequence[str], label: str = "churn",
                     rounds: int = 100, max_depth: int = 6, rate: float = 0.1,
                     **options) -> boosting.Booster:
    """Boosted trees from first and second derivatives, grown level by level."""
    return boosting.fit(train, features, label, rounds=rounds, max_depth=max_depth, rate=rate,
                        **options)


def fit_leaf_wise(train: DataFrame, features: Sequence[str], label: str = "churn",
                  rounds: int = 100, leaves: int = 31, rate: float = 0.1,
                  **options) -> boosting.Booster:
    """The same, grown leaf by leaf, without L2 and with at least 20 rows in a leaf."""
    return boosting.fit(train, features, label, rounds=rounds, leaves=leaves, rate=rate,
                        **{"l2": 0.0, "least_weight": 1e-3, "least_rows": 20, **options})


FITS = {
    "lr": fit_logistic,
    "rf": fit_forest,
    "gbt": fit_boosting,
    "gbt_sampled": lambda train, features, **kw: fit_boosting(train, features, sampled=True, **kw),
    "mlp": fit_perceptron,
    "network": network.fit,
    "boosted": fit_second_order,
    "boosted_leaf": fit_leaf_wise,
}


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(kept columns, churn_prediction, churn_probability) for every row."""
    return model.transform(df).select(
        *keep, F.col("prediction").cast("int").alias("churn_prediction"),
        vector_to_array("probability")[1].alias("churn_probability"))


def coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(v) for v in model.stages[-1].coefficients)))


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def feature_importance(model: PipelineModel, df: DataFrame, features: Sequence[str],
                       n: int | None = None) -> DataFrame:
    """(feature, importance), most important first. One row per feature of the model."""
    out = df.sparkSession.createDataFrame(
        list(importances(model, features).items()), "feature string, importance double")
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(n) if n else out
