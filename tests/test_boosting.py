"""Second-order boosting against hand calculation and against the first-order trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from patronage.operators import boosting, metrics, models
from patronage.plans import churn_run


def table(spark, n=4000, seed=1):
    pick, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = pick.gauss(0, 1), pick.uniform(0, 10), pick.randint(0, 3)
        odds = 1.5 * a + (2 if b > 6 and a > 0 else -0.5) + (c == 2)
        rows.append((i, a, b, float(c), int(pick.random() < 1 / (1 + math.exp(-odds))), i % 4 == 0))
    return spark.createDataFrame(
        rows, "customer_id int, a double, b double, c double, churn int, is_test boolean")


def log_loss(model, df):
    p = F.greatest(F.least("churn_probability", F.lit(1 - 1e-9)), F.lit(1e-9))
    scored = models.score(model, df, ["churn"])
    return scored.agg(F.avg(-F.when(F.col("churn") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def test_gains_equal_a_hand_calculation(spark):
    rows = [(0, [0], -0.5, 0.25), (0, [0], 0.5, 0.25), (0, [1], 0.5, 0.25), (0, [1], 0.5, 0.25),
            (0, [2], -0.5, 0.25), (0, [2], -0.5, 0.25)]
    cells = boosting.histograms(spark.createDataFrame(
        rows, "node int, bins array<int>, g double, h double"))
    got = {r.bin: r for r in boosting.split_gains(cells, l2=1.0, least_weight=0.0).collect()}
    def s(g, h): return g * g / (h + 1)
    assert sorted(got) == [0, 1]
    assert got[0].gain == pytest.approx((s(0, 0.5) + s(0, 1.0) - s(0, 1.5)) / 2)
    assert got[1].gain == pytest.approx((s(1, 1.0) + s(-1, 0.5) - s(0, 1.5)) / 2)
    assert [r.bin for r in boosting.split_gains(cells, least_weight=0.75).collect()] == []
    assert [r.bin for r in boosting.split_gains(cells, least_weight=0.0, least_rows=3).collect()] == []


def test_one_tree_is_the_newton_step(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0), (1.0, 1), (1.0, 1), (None, 0)], "x double, churn int")
    model = boosting.fit(df, ["x"], rounds=1, rate=1.0, max_depth=1, l2=0.5, least_weight=0.0)
    p = 3 / 5
    left = -(p - 1 + 2 * p) / (3 * p * (1 - p) + 0.5)
    right = -(2 * (p - 1)) / (2 * p * (1 - p) + 0.5)
    base = math.log(p / (1 - p))
    got = [r.m for r in df.select(model.margin().alias("m")).collect()]
    assert got == pytest.approx([base + v for v in (left, left, right, right, left)])


@pytest.mark.parametrize("options", [{"max_depth": 3}, {"leaves": 6}])
def test_loss_is_no_worse_than_first_order_boosting(spark, options):
    data = table(spark).cache()
    train, test = data.filter("not is_test"), data.filter("is_test")
    mine = boosting.fit(train, ["a", "b", "c"], rounds=8, rate=0.5, **options)
    first = models.fit_boosting(train, ["a", "b", "c"], rounds=8, rate=0.5, max_depth=3)
    assert log_loss(mine, test) <= log_loss(first, test) + 0.01
    assert log_loss(mine, train) < log_loss(mine, test) + 0.2
    assert sum(mine.featureImportances) == pytest.approx(1.0)
    if "leaves" in options:
        assert all((len(t) + 1) // 2 <= 6 for t in mine.trees)
    again = boosting.fit(train, ["a", "b", "c"], rounds=1, rate=0.5, **options)
    assert [n.cut for n in again.trees[0] if n.left >= 0] == [n.cut for n in mine.trees[0] if n.left >= 0]


def test_a_run_scores_explains_and_measures(spark):
    data = table(spark, 400)
    run = churn_run.train(data, ["a", "b", "c"], "boosted", rounds=3, max_depth=2)
    assert run.predictions().columns == ["customer_id", "churn_prediction", "churn_probability"]
    assert run.reasons(k=2).count() == 800
    assert run.importance(repeats=1).count() == 3
    assert metrics.metrics_weighted(run.confusion()).first().accuracy > 0.6


def test_tables_without_a_choice(spark):
    empty = spark.createDataFrame([], "x double, churn int")
    one = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None)], "x double, churn int")
    flat = spark.createDataFrame([(1.0, 1), (1.0, 0)], "x double, churn int")
    for df in (empty, one, flat):
        model = boosting.fit(df, ["x"], rounds=2)
        assert model.trees == [] and model.transform(df).count() == df.count()
