"""Scalar rules at their edges."""

import datetime as dt

from pyspark.sql import functions as F

from patronage.functions import numeric
from patronage.functions.calendar import parsed_timestamp, period_label, period_start


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_risk_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,), (None,)], "p double")
    assert column(df, numeric.risk_bucket(F.col("p"))) == [
        "Low", "Medium", "High", "High", "Unknown"]
    assert column(df, numeric.risk_segment(F.col("p"))) == [
        None, "Low Risk", "Medium Risk", "High Risk", None]


def test_targets(spark):
    text = spark.createDataFrame([(" Yes ",), ("exited",), ("no",), (None,)], "t string")
    assert column(text, numeric.binary_target(F.col("t"), "string")) == [1, 1, 0, 0]
    number = spark.createDataFrame([(2.0,), (-1.0,), (0.0,), (None,)], "t double")
    assert column(number, numeric.binary_target(F.col("t"), "double")) == [1, 0, 0, 0]
    flag = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert column(flag, numeric.binary_target(F.col("t"), "boolean")) == [1, 0]


def test_elapsed_days_are_not_calendar_days(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 23:59:59' a, timestamp_ntz'2024-01-02 00:00:01' b")
    assert column(df, numeric.whole_days(F.col("a"), F.col("b"))) == [0]
    assert column(df, numeric.whole_days(F.col("b"), F.col("a"))) == [-1]
    assert column(df, numeric.recency_score(F.lit(0))) == [0.0]
    assert column(df, numeric.recency_score(F.lit(30))) == [0.5]


def test_half_even(spark):
    df = spark.createDataFrame([(2.125,), (2.375,), (-0.5,), (None,)], "x double")
    assert column(df, numeric.half_even(F.col("x"))) == [2.12, 2.38, -0.5, None]


def test_finite_or_zero(spark):
    df = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (3.5,)], "x double")
    assert column(df, numeric.finite_or_zero(F.col("x"))) == [0.0, 0.0, 0.0, 0.0, 3.5]


def test_money_sum_is_exact_and_skips_nan(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(float("nan"),), (None,)], "x double")
    row = df.agg(numeric.money_sum("x").alias("s"), numeric.money_count("x").alias("n")).first()
    assert (row.s, row.n) == (100.0, 1000)


def test_bad_dates_and_weeks(spark):
    df = spark.createDataFrame([("abc",), ("2024-01-07",), ("2024-01-08",)], "d string")
    ts = parsed_timestamp(F.col("d"))
    assert column(df, ts)[0] is None
    assert column(df, period_start(ts, "week"))[1:] == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    assert column(df, period_label(period_start(ts, "quarter"), "quarter"))[1] == "2024Q1"
    assert column(df, period_label(period_start(ts, "day"), "day"))[2] == "2024-01-08"
    assert column(df, period_label(period_start(ts, "week"), "week"))[2] == "2024-01-08/2024-01-14"
