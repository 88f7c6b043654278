"""Exact quantiles, modes, histograms and running totals against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from patronage.functions import stats
from patronage.functions.ordering import with_running


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x int")
    assert stats.exact_quantile_row(df, ["x"], 0.5).first().x == 2.5


def test_column_without_values_has_no_quantile(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    row = stats.exact_quantile_row(df, ["x", "y"], 0.5).first()
    assert (row.x, row.y) == (1.5, None)


@pytest.mark.parametrize("small", [10, 100_000])
def test_quantiles_match_numpy(spark, monkeypatch, small):
    """Also with the bracketing pass switched on for small groups, and with a hot value."""
    monkeypatch.setattr(stats, "SMALL_GROUP", small)
    monkeypatch.setattr(stats, "BRACKET", 0.05)
    monkeypatch.setattr(stats, "CUTS", 20)
    rng = random.Random(7)
    values = {"a": [rng.gauss(0, 5) for _ in range(3000)],
              "b": [0.0] * 1000 + [float(rng.randrange(9)) for _ in range(2000)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs],
                               "k string, v double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.7, 0.999, 1.0]
    got = {(r.k, r.probability): r.quantile
           for r in stats.exact_quantiles(df, ["k"], probs, value="v").collect()}
    for k, vs in values.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(vs, p), abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = stats.exact_quantile_row(df, ["x"], p).first().x
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(v, None) for v in ["b", "a", "b", "a", "c", None]],
                               "x string, y string")
    row = stats.most_frequent_row(df, ["x", "y"]).first()
    assert (row.x, row.y) == ("a", None)


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "x double")
    rows = stats.equal_width_histogram(df, "x", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 0, 0, 0, 1]
    assert (rows[0].lower, rows[4].upper) == (0.0, 10.0)
    flat = stats.equal_width_histogram(df.filter("x = 0"), "x", 3).orderBy("bin").collect()
    assert [r.n for r in flat] == [1, 0, 0]


def test_running_totals_with_a_hot_tie(spark):
    """A third of the rows share the sort value; the key keeps the order total."""
    rows = [(i, 5 if i % 3 == 0 else i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    got = with_running(df, [F.desc("v"), F.col("k")], {"run": F.col("v")}, "pos") \
        .orderBy("pos").collect()
    want, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    assert [(r.k, r.v) for r in got] == want
    for i, r in enumerate(got):
        total += r.v
        assert (r.pos, r.run) == (i, total)
