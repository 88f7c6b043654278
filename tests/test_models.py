"""Models are checked by properties, metrics and explanations by value."""

import pytest
from pyspark.sql import functions as F

from patronage.operators import explain, metrics, models
from patronage.plans import churn_run


@pytest.fixture(scope="module")
def table(spark):
    """Churn depends on x1 (and a little on x2); x3 is noise, x4 constant."""
    base = spark.range(600).select(
        F.col("id").alias("customer_id"), F.rand(1).alias("x1"), F.rand(2).alias("x2"),
        F.rand(3).alias("x3"), F.lit(1.0).alias("x4"))
    full = base.withColumn("churn", (F.col("x1") + 0.2 * F.col("x2") > 0.8).cast("int"))
    return churn_run.prepare(full)


@pytest.mark.parametrize("kind,options", [
    ("lr", {"balanced": True}), ("rf", {"trees": 15, "balanced": True}),
    ("gbt", {"rounds": 5}), ("gbt_sampled", {"rounds": 5}), ("mlp", {"max_iter": 80})])
def test_models_beat_the_majority(table, kind, options):
    prepared, names = table
    run = churn_run.train(prepared, names, kind, **options)
    pred = run.predictions()
    assert pred.columns == ["customer_id", "churn_prediction", "churn_probability"]
    assert pred.count() == 600
    assert pred.filter("churn_probability < 0 or churn_probability > 1").count() == 0
    scores = metrics.metrics_binary(run.confusion()).first()
    majority = prepared.filter("is_test").agg(F.greatest(
        F.avg("churn"), 1 - F.avg("churn"))).first()[0]
    assert scores.accuracy > majority and scores.f1 > 0.8


def test_forest_explanations(table):
    prepared, names = table
    run = churn_run.train(prepared, names, "rf", trees=15)
    again = churn_run.train(prepared, names, "rf", trees=15)
    assert run.predictions().orderBy("customer_id").collect() == \
        again.predictions().orderBy("customer_id").collect()
    ranked = models.feature_importance(run.model, prepared, names).collect()
    assert ranked[0].feature == "x1"
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)
    drops = {r.feature: r.importance for r in run.importance().collect()}
    assert set(drops) == set(names)
    assert drops["x1"] > 0.1 and drops["x1"] == max(drops.values())
    assert drops["x4"] == 0.0
    reasons = run.reasons(k=2)
    assert reasons.count() == 1200
    assert reasons.columns == [
        "customer_id", "reason_rank", "feature", "value", "importance_weight", "reason_score"]


def test_permutation_keeps_every_value(table, monkeypatch):
    """With small buckets the exchanged column is still a permutation of the original one."""
    prepared, names = table
    run = churn_run.train(prepared, names, "lr")
    a = explain.permutation_importance(run.model, run.test, "customer_id", names, bucket_rows=20)
    b = explain.permutation_importance(run.model, run.test, "customer_id", names, bucket_rows=20)
    assert a.orderBy("feature").collect() == b.orderBy("feature").collect()
    assert {r.feature for r in a.collect()} == set(names)


def test_linear_reasons(spark):
    df = spark.createDataFrame([(1, 2.0, -3.0, 0.5)], "k int, a double, b double, c double")
    rows = explain.local_reasons_linear(df, "k", {"a": 1.0, "b": 1.0, "c": -2.0}, k=2).collect()
    assert [(r.reason_rank, r.feature, r.impact, r.effect) for r in rows] == [
        (1, "b", -3.0, "↓ decreases churn risk"), (2, "a", 2.0, "↑ increases churn risk")]
    tree = explain.local_reasons_tree(df, "k", {"a": 0.2, "b": 0.1, "c": 0.7}, k=3).collect()
    assert [r.feature for r in tree] == ["a", "c", "b"]


def test_synthetic_target_and_leakage_switch(spark):
    df = spark.range(200).select(
        F.col("id").alias("customer_id"), F.rand(5).alias("engagement_score"),
        F.rand(6).alias("purchase_frequency"), F.rand(7).alias("days_since_last_purchase"),
        F.rand(8).alias("age"))
    prepared, names = churn_run.prepare(df, drop_label_sources=True, exact_split=True)
    assert names == ["age"]
    assert prepared.agg(F.sum("churn")).first()[0] == 60
    assert len(churn_run.prepare(df)[1]) == 4


def test_numeric_target_by_median(spark):
    df = spark.range(100).select(F.col("id").alias("customer_id"), F.col("id").alias("target"),
                                 F.rand(1).alias("age"))
    above_zero = churn_run.prepare(df)[0].agg(F.sum("churn")).first()[0]
    above_median = churn_run.prepare(df, by_median=True)[0].agg(F.sum("churn")).first()[0]
    assert (above_zero, above_median) == (99, 50)


def test_metrics_without_positive_predictions(spark):
    matrix = spark.createDataFrame([(0, 0, 3), (1, 0, 2)], "label int, prediction int, n bigint")
    r = metrics.metrics_binary(matrix).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.6, 0.0, 0.0, 0.0)


def test_weighted_metrics(spark):
    matrix = spark.createDataFrame([(0, 0, 4), (0, 1, 1), (1, 0, 2), (1, 1, 3)],
                                   "label int, prediction int, n bigint")
    r = metrics.metrics_weighted(matrix).first()
    assert (r.accuracy, r.recall) == (0.7, 0.7)
    assert r.precision == pytest.approx(0.5 * (4 / 6) + 0.5 * (3 / 4))
    assert r.f1 == pytest.approx(0.5 * (8 / 11) + 0.5 * (6 / 9))
    both = metrics.metrics_table({"a": matrix, "b": matrix})
    assert [x.model for x in both.collect()] == ["a", "b"]
