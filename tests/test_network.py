"""The feed-forward network: its gradient, its expression, and what it learns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import metrics, models, network


def table(spark, n=900, rare=1.0):
    pick, rows = random.Random(4), []
    for i in range(n):
        a, b = pick.gauss(0, 1), pick.gauss(0, 1)
        y = int(a * b > 0.1)  # no line separates this
        if y and pick.random() > rare:
            continue
        rows.append((i, a, b, y))
    return spark.createDataFrame(rows, "customer_id int, a double, b double, churn int").repartition(3)


def test_gradient_equals_differences():
    pick = np.random.default_rng(1)
    sizes = [3, 5, 4, 1]
    flat = pick.normal(size=sum(a * b + b for a, b in zip(sizes, sizes[1:])))
    rows = np.concatenate([pick.integers(0, 2, (20, 1)), pick.uniform(0.5, 2, (20, 1)),
                           pick.normal(size=(20, 3))], 1)

    def loss(w):
        odds = network._forward(network._shaped(w, sizes), rows[:, 2:], 1.0, None)[2]
        return (rows[:, 1] * (np.logaddexp(0, odds) - rows[:, 0] * odds)).sum()

    got = network._gradient(network._shaped(flat, sizes), rows, 1.0, None)
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)
    assert got[-1] == pytest.approx(rows[:, 1].sum())


def test_it_learns_what_no_line_can_and_repeats(spark):
    data = table(spark)
    options = {"hidden": (16, 8), "epochs": 30, "dropout": 0.1, "rate": 0.02}
    model = network.fit(data, ["a", "b"], **options)
    scored = models.score(model, data, ["churn"])
    matrix = metrics.confusion_matrix(scored, "churn")
    assert metrics.metrics_weighted(matrix).first().f1 > 0.85
    rows = data.select("a", "b", model.log_odds(F.array("a", "b")).alias("o")).collect()
    layers = [(np.array(w).T, np.array(b)) for w, b in model.layers]
    odds = network._forward(layers, np.array([(r.a, r.b) for r in rows]), 1.0, None)[2]
    assert [r.o for r in rows] == pytest.approx(odds.tolist(), abs=1e-9)
    again = network.fit(data, ["a", "b"], **options | {"epochs": 2})
    once_more = network.fit(data, ["a", "b"], **options | {"epochs": 2})
    for (w, b), (v, c) in zip(again.layers, once_more.layers):
        assert np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9)


def test_class_weights_find_more_of_a_rare_class(spark):
    data = table(spark, 1200, rare=0.08)
    share = {}
    for balanced in (False, True):
        model = network.fit(data, ["a", "b"], hidden=(8,), epochs=8, dropout=0.0, balanced=balanced)
        share[balanced] = models.score(model, data, ["churn"]).agg(F.avg("churn_prediction")).first()[0]
    assert share[True] > share[False]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, churn int")
    assert models.score(network.fit(empty, ["a"], epochs=1), empty, ["a"]).count() == 0
    holes = spark.createDataFrame([(None, 1), (1.0, 0), (2.0, None)], "a double, churn int")
    scored = models.score(network.fit(holes, ["a"], epochs=1), holes, ["a"]).collect()
    assert len(scored) == 3 and all(0 <= r.churn_probability <= 1 for r in scored)
