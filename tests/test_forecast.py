"""Forecast arithmetic and accuracy."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from patronage.operators import forecast as fc


def monthly(n, value):
    out = []
    for i in range(n):
        d = dt.date(2020 + i // 12, i % 12 + 1, 1)
        out.append((d, value(i, d)))
    return out


def test_linear_series_is_continued_exactly(spark):
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    s = spark.createDataFrame(monthly(24, lambda i, d: 2.0 * day(d) + 3), "ds date, y double")
    rows = fc.forecast(s, "month", 6).orderBy("ds").collect()
    assert [r.ds for r in rows][:2] == [dt.date(2022, 1, 1), dt.date(2022, 2, 1)]
    for r in rows:
        assert r.yhat == pytest.approx(2.0 * day(r.ds) + 3, abs=1e-6)
        assert r.yhat_upper - r.yhat_lower == pytest.approx(0, abs=1e-6)


def test_trend_and_season_are_recovered_per_key(spark):
    season = lambda d: 100 * math.sin(d.month / 12 * 2 * math.pi)
    rows = [("a", d, round(1000 + 10 * i + season(d), 2)) for i, d in enumerate(
        x[0] for x in monthly(60, lambda i, d: 0))]
    rows += [("b", d, 50.0) for d, _ in monthly(36, lambda i, d: 0)] + [("c", dt.date(2024, 5, 1), 9.0)]
    s = spark.createDataFrame(rows, "k string, ds date, y double").repartition(6)
    got = fc.forecast(s, "month", 12, by=["k"]).collect()
    assert len(got) == 36
    for r in got:
        if r.k == "a":
            i = (r.ds.year - 2020) * 12 + r.ds.month - 1
            assert r.yhat == pytest.approx(1000 + 10 * i + season(r.ds), abs=3)
        if r.k == "b":
            assert r.yhat == pytest.approx(50.0, abs=1e-9)
        if r.k == "c":
            assert r.yhat == pytest.approx(9.0, abs=1e-9)


def test_daily_series_have_a_weekly_effect(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(730)]
    s = spark.createDataFrame([(d, 100.0 + (40 if d.weekday() == 5 else 0)) for d in days],
                              "ds date, y double")
    rows = fc.forecast(s, "day", 14).collect()
    saturday = [r.yhat for r in rows if r.ds.weekday() == 5]
    other = [r.yhat for r in rows if r.ds.weekday() != 5]
    assert min(saturday) - max(other) > 30


def test_series_drop_null_dates_and_keep_gaps(spark):
    tx = spark.createDataFrame([
        (1.0, dt.datetime(2024, 1, 7)), (2.0, dt.datetime(2024, 1, 8)), (4.0, dt.datetime(2024, 1, 29)),
        (8.0, None)], "amount double, date timestamp_ntz")
    rows = fc.sales_series(tx, "week").orderBy("ds").collect()
    assert [(r.ds, r.y) for r in rows] == [
        (dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 8), 2.0), (dt.date(2024, 1, 29), 4.0)]
    ahead = [r.ds for r in fc.future_calendar(fc.sales_series(tx, "week"), "week", 2).collect()]
    assert ahead == [dt.date(2024, 2, 5), dt.date(2024, 2, 12)]
    months = [r.ds for r in fc.future_calendar(fc.sales_series(tx, "month"), "month", 2).collect()]
    assert months == [dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    assert fc.future_calendar(fc.sales_series(tx.filter("amount > 99"), "day"), "day", 3).count() == 0


def test_summary_and_advice(spark):
    s = spark.createDataFrame(monthly(24, lambda i, d: 100.0 + i), "ds date, y double")
    both = fc.forecast(s, "month", 6, history=True)
    r = fc.forecast_summary(s, both).first()
    assert r.trend_direction == "increasing" and r.outlook == "strong" and r.growth_pct > 5
    assert r.avg_historical == pytest.approx(111.5)
    assert (r.best_period, r.worst_period) == (dt.date(2022, 6, 1), dt.date(2022, 1, 1))
    assert fc.outlook_advice(fc.forecast_summary(s, both)).count() == 3
    zero = spark.createDataFrame(monthly(12, lambda i, d: 0.0), "ds date, y double")
    z = fc.forecast_summary(zero, fc.forecast(zero, "month", 2, history=True)).first()
    assert (z.growth_pct, z.outlook) == (0.0, "decline")
    assert fc.components(both).count() == 30
    table = fc.forecast_table(both)
    assert table.columns == ["date", "forecast", "lower_bound", "upper_bound"] and table.count() == 6


def test_one_shuffle_by_key_after_the_sums(spark):
    """All windows of a keyed fit share one exchange."""
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, ds date, y double")
    plan = fc.fitted(s, "day", ["k"]).select(F.col("_sigma"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
