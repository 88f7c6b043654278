"""Train, evaluate, explain and score one churn model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage import roles
from patronage.operators import explain, labels, metrics, models
from patronage.session import settle


@dataclass
class ChurnRun:
    """A fitted model with the tables it was fitted and tested on."""

    name: str
    model: PipelineModel
    features: list[str]
    key: str
    label: str
    data: DataFrame

    @property
    def test(self) -> DataFrame:
        return self.data.filter("is_test")

    def predictions(self, df: DataFrame | None = None) -> DataFrame:
        return models.score(self.model, self.data if df is None else df, [self.key])

    def confusion(self) -> DataFrame:
        return metrics.confusion_matrix(
            models.score(self.model, self.test, [self.label]), self.label)

    def reasons(self, df: DataFrame | None = None, k: int = 10) -> DataFrame:
        rows = self.data if df is None else df
        if hasattr(self.model.stages[-1], "coefficients"):
            return explain.local_reasons_linear(
                rows, self.key, models.coefficients(self.model, self.features), k)
        return explain.local_reasons_tree(
            rows, self.key, models.importances(self.model, self.features), k)

    def importance(self, repeats: int = 5, seed: int = 42) -> DataFrame:
        return explain.permutation_importance(
            self.model, self.test, self.key, self.features, self.label, repeats, seed)


def prepare(features: DataFrame, key: str = "customer_id", target: str | None = None,
            test_size: float = 0.2, seed: int = 42, drop_label_sources: bool = False,
            exact_split: bool = False,
            by_median: bool = False) -> tuple[DataFrame, list[str]]:
    """(table with features, 0/1 ``churn`` and ``is_test``; feature names).

    Without a target column the label is derived from the engagement of the customers. Those
    sources stay among the features unless ``drop_label_sources`` is set; a model can then
    almost reproduce the label, so expect scores near 1. ``by_median`` turns a numeric target
    with more than two values into above / not above its median instead of above / not above 0.
    """
    target = target or roles.first_match(features.columns, roles.MODEL_TARGET)
    skip = [key, "churn_score", "churn"]
    if target is None:
        labelled = labels.synthetic_churn(features)
        skip += list(labels.LABEL_SOURCES) if drop_label_sources else []
    else:
        labelled = (labels.median_binarize if by_median else labels.to_binary)(features, target)
        skip.append(target)
    names = roles.numeric_columns(features, skip)
    if not names:
        raise ValueError("no numeric features")
    table = labelled.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                   for c in names], "churn")
    split = (labels.split_stratified(table, key, "churn", test_size, seed) if exact_split
             else labels.split_by_hash(table, key, test_size, seed))
    return settle(split), names


def train(prepared: DataFrame, names: Sequence[str], kind: str = "rf", key: str = "customer_id",
          **options) -> ChurnRun:
    """Fit one of ``models.FITS`` on the training rows; options go to the fit."""
    rows = prepared.filter("not is_test")
    model = models.FITS[kind](rows, list(names), label="churn", **options)
    return ChurnRun(models.MODEL_NAMES[kind], model, list(names), key, "churn", prepared)
