"""The forecast with a bending trend against planted curves and a plain solver."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from patronage.operators import changepoints as cp
from patronage.operators import forecast as fc


def months(n):
    return [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


def bent(i, cut=48):
    return 500 + 4 * i + (9 * (i - cut) if i > cut else 0) + 60 * math.sin(2 * math.pi * i / 12 + 1)


def test_a_bend_and_a_wave_are_followed(spark):
    days = months(96)
    s = spark.createDataFrame([("a", d, bent(i)) for i, d in enumerate(days[:84])]
                              + [("b", d, 70.0) for d in days[:40]] + [("c", days[0], 9.0)],
                              "k string, ds date, y double").repartition(5)
    got = cp.forecast(s, "month", 12, by=["k"]).collect()
    assert len(got) == 36 and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)
    errors = [abs(r.yhat - bent(days.index(r.ds))) for r in got if r.k == "a"]
    assert max(errors) < 15  # of a curve that climbs by 156 and swings by 120 in those months
    old = [abs(r.yhat - bent(days.index(r.ds))) for r in fc.forecast(s, "month", 12, by=["k"]).collect()
           if r.k == "a"]
    assert max(errors) < 0.2 * max(old)
    assert all(r.yhat == pytest.approx(70, abs=1) for r in got if r.k == "b")
    assert all(r.yhat == pytest.approx(9, abs=1) for r in got if r.k == "c")


def test_weights_equal_a_plain_ridge_solution(spark):
    pick = random.Random(2)
    rows = [(d, 100 + 3 * i + pick.gauss(0, 20)) for i, d in enumerate(months(30))]
    s = spark.createDataFrame(rows, "ds date, y double")
    shape = cp.Shape(changes=6, yearly=2)
    fit = cp.solved(cp.normal_sums(s, shape), shape).first()
    span = (rows[-1][0] - rows[0][0]).days
    scale = max(abs(y) for _, y in rows)
    x = []
    for d, _ in rows:
        t, day = (d - rows[0][0]).days / span, (d - dt.date(1970, 1, 1)).days
        x.append([1, t, *(max(t - p, 0) for p in shape.places()),
                  *(f(2 * math.pi * k * day / 365.25) for k in (1, 2) for f in (math.sin, math.cos))])
    x, y = np.array(x), np.array([v for _, v in rows]) / scale
    inverse = np.linalg.inv(x.T @ x + np.diag(shape.ridge()))
    weights = inverse @ x.T @ y
    taken = np.trace(inverse @ x.T @ x)
    assert fit.weights == pytest.approx(weights, abs=1e-8)
    assert np.array(fit.covariance) == pytest.approx(inverse, rel=1e-6, abs=1e-6)
    assert fit.sigma == pytest.approx(np.sqrt(((y - x @ weights) ** 2).sum() / (30 - taken)), rel=1e-6)


def noisy(seed, n):
    """Series that bend now and then, with noise: what the simulated futures assume."""
    pick, rows = random.Random(seed), []
    for k in range(n):
        level, slope, noise = pick.uniform(300, 900), pick.uniform(-3, 6), pick.choice([8, 20, 40])
        for i, d in enumerate(months(96)):
            slope += pick.gauss(0, 2) if pick.random() < 0.05 else 0
            level += slope
            rows.append((k, d, level + 30 * math.sin(i / 12 * 2 * math.pi) + pick.gauss(0, noise)))
    return rows


def test_bounds_widen_and_hold_about_four_in_five(spark):
    rows = noisy(5, 60)
    known = spark.createDataFrame([r for r in rows if r[1].year < 2022], "k int, ds date, y double")
    later = {(k, d): y for k, d, y in rows if d.year == 2022}
    got = cp.forecast(known, "month", 12, by=["k"]).collect()
    inside = [r.yhat_lower <= later[r.k, r.ds] <= r.yhat_upper for r in got]
    assert 0.68 <= sum(inside) / len(inside) <= 0.92
    width = {m: sum(r.yhat_upper - r.yhat_lower for r in got if r.ds.month == m) for m in (1, 6, 12)}
    assert width[1] < width[6] < width[12] and width[12] > 1.2 * width[1]
    again = cp.forecast(known, "month", 12, by=["k"]).collect()
    assert {(r.k, r.ds): r.yhat_lower for r in got} == pytest.approx(
        {(r.k, r.ds): r.yhat_lower for r in again}, rel=1e-9)
    wide = cp.forecast(known, "month", 12, by=["k"], level=0.95).collect()
    assert sum(r.yhat_upper - r.yhat_lower for r in wide) > 1.2 * sum(
        r.yhat_upper - r.yhat_lower for r in got)


def test_weeks_and_days(spark):
    start = dt.date(2022, 1, 3)
    days = [start + dt.timedelta(days=i) for i in range(800)]
    s = spark.createDataFrame([(d, 100.0 + (40 if d.weekday() == 5 else 0)) for d in days],
                              "ds date, y double")
    rows = cp.forecast(s, "day", 14, changes=5).collect()
    assert min(r.yhat for r in rows if r.ds.weekday() == 5) > 30 + max(
        r.yhat for r in rows if r.ds.weekday() != 5)
    weeks = spark.createDataFrame([(start + dt.timedelta(days=7 * i), 50.0 + i) for i in range(60)],
                                  "ds date, y double")
    both = cp.forecast(weeks, "week", 4, history=True).collect()
    assert len(both) == 64 and sum(r.is_future for r in both) == 4
    assert [r.ds for r in both if r.is_future][0] == start + dt.timedelta(days=420)
    assert all(r.yhat == pytest.approx(r.trend + r.yearly + r.weekly) for r in both)


def test_odd_series(spark):
    empty = spark.createDataFrame([], "k string, ds date, y double")
    assert cp.forecast(empty, "month", 3, by=["k"]).count() == 0
    assert cp.forecast(empty.drop("k"), "month", 3).count() == 0
    odd = spark.createDataFrame(
        [("zero", d, 0.0) for d in months(5)] + [("gaps", None, 1.0), ("gaps", months(1)[0], None),
         ("gaps", months(3)[2], 5.0), (None, months(1)[0], 2.0), (None, months(2)[1], 2.0)],
        "k string, ds date, y double")
    got = {(r.k, r.ds): r for r in cp.forecast(odd, "month", 2, by=["k"]).collect()}
    assert {k for k, _ in got} == {"zero", "gaps", None} and len(got) == 6
    assert all(abs(r.yhat) < 1e-9 for (k, _), r in got.items() if k == "zero")
    with pytest.raises(ValueError):
        cp.forecast(odd, "hour", 2)


def test_a_series_is_shuffled_once(spark):
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, ds date, y double")
    plan = cp.forecast(s, "month", 3, by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sums_by_key_gather_short_rows_in_one_shuffle(spark):
    """The rows of a series are not widened to their products before they are added up."""
    shape = cp.Shape(changes=2, yearly=1)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=31 * i) for i in range(9)]
    rows = [(k, d, float((k + 3) * i % 7)) for k in range(300) for i, d in enumerate(days)]
    series = spark.createDataFrame(rows, "k bigint, ds date, y double").repartition(4)
    sums = cp.normal_sums(series, shape, ["k"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "summarizer" not in plan.lower()
    got = {r.k: r for r in sums.collect()}
    assert len(got) == 300 and all(r.n == 9 and r.days == days for r in got.values())
    alone = cp.normal_sums(series.filter("k = 5").drop("k"), shape).first()
    assert alone.products == got[5].products and len(alone.products) == 28
    span = (days[-1] - days[0]).days
    t = [(d - days[0]).days / span for d in days]
    assert got[5].products[0] == 9 and abs(got[5].products[1] - sum(t)) < 1e-12
