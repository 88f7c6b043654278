"""Forecasts with a bending trend, smooth seasons and bounds that widen, for one series or thousands.

Each series is a ridge regression on a straight line, hinges at regular places in the first
``reach`` of its history (the trend may bend there), and sines and cosines of the year and the week.
The regression needs sums of products only. They are added up inside the one row that a series is
gathered in, and solved there by sweeping the matrix, which gives the weights, the squared
error and the degrees of freedom at once. There is one estimator for histories of any length: what a
short history cannot tell apart is shared out by the ridge.

The bounds come from simulated futures: the trend goes on bending as often and as strongly as it did
in the history, and noise is added, of the fitted size and of what the weights leave open. Draws are hashes of (seed, draw, step), so
reruns agree; they are made once and used for every series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.calendar import add_steps, step_interval
from patronage.functions.stats import one_row
from patronage.operators.forecast import PERIODS

YEAR_DAYS = 365.25


@dataclass(frozen=True)
class Shape:
    """What a series is fitted with: places where the trend may bend, waves a year and a week, and
    the weights of the ridge on bends, on waves, and on the line itself (on series scaled to
    at most 1, with time from 0 to 1)."""

    changes: int = 25
    reach: float = 0.8
    yearly: int = 10
    weekly: int = 0
    bend: float = 0.02
    wave: float = 0.05
    line: float = 1e-6

    @property
    def size(self) -> int:
        return 2 + self.changes + 2 * (self.yearly + self.weekly)

    def places(self) -> list[float]:
        return [self.reach * c / (self.changes + 1) for c in range(1, self.changes + 1)]

    def ridge(self) -> list[float]:
        return ([self.line] * 2 + [self.bend] * self.changes
                + [self.wave] * (2 * (self.yearly + self.weekly)))


# Monthly rows cannot show more than six waves a year, nor any in the week.
SHAPES = {"day": Shape(weekly=3), "week": Shape(), "month": Shape(yearly=5)}


def _terms(shape: Shape, ds: Column, t: Column) -> Column:
    """The row of the regression: 1, t, hinges, waves of the year, waves of the week."""
    day = F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")
    waves = [f(day * F.lit(2.0 * k / cycle) * F.pi())
             for cycle, n in ((YEAR_DAYS, shape.yearly), (7.0, shape.weekly))
             for k in range(1, n + 1) for f in (F.sin, F.cos)]
    hinges = [F.greatest(t - F.lit(s), F.lit(0.0)) for s in shape.places()]
    return F.array(F.lit(1.0), t, *hinges, *waves)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _place(i: Column, j: Column, width: int) -> Column:
    """Where the product of terms i <= j stands among the products of ``width`` terms."""
    return i * F.lit(width) - F.floor(i * (i - 1) / 2).cast("int") + (j - i)


def normal_sums(series: DataFrame, shape: Shape, by: Sequence[str] = ()) -> DataFrame:
    """(keys, n, first, last, span, scale, products, days): the sums a fit needs, one row per series.

    ``products`` holds the upper triangle, row by row, of the products of the terms with each other
    and, last, with the scaled value. Rows without a date or value are left out. The dates and
    values of a series are gathered in one row, by one shuffle, and the products added up inside it,
    in the order of the dates: as rows they would be many times the series and be sorted once more.
    """
    by, width = list(by), shape.size + 1
    rows = series.select(*by, "ds", F.col("y").cast("double").alias("_y")).filter(
        F.col("ds").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y"))
    # Without keys the rows are one group; without rows there is none.
    sums = rows.groupBy(*(by or [F.lit(0).alias("_one")])).agg(
        F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"),
        F.max(F.abs("_y")).alias("scale"),
        F.sort_array(F.collect_list(F.struct("ds", "_y"))).alias("_rows"))
    sums = sums.withColumns({
        "span": F.greatest(F.datediff("last", "first"), F.lit(1)).cast("double"),
        "scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))})

    def products(row: Column) -> Column:
        t = F.datediff(row["ds"], F.col("first")) / F.col("span")
        return _let(
            F.concat(_terms(shape, row["ds"], t), F.array(row["_y"] / F.col("scale"))),
            lambda z: F.flatten(F.transform(z, lambda u, i: F.transform(
                F.slice(z, i + 1, width), lambda v: u * v))))

    nothing = F.array_repeat(F.lit(0.0), width * (width + 1) // 2)
    added = F.aggregate("_rows", nothing, lambda sum_, row: F.zip_with(
        sum_, products(row), lambda a, b: a + b))
    return sums.select(*by, "n", "first", "last", "span", "scale", added.alias("products"),
                       F.col("_rows.ds").alias("days"))


def solved(sums: DataFrame, shape: Shape) -> DataFrame:
    """``sums`` with the weights of the terms, ``sigma``, the scaled standard error of a row, and
    ``covariance``, that of the weights in units of sigma squared."""
    k, ridge = shape.size, F.array(*[F.lit(r) for r in shape.ridge()])

    index = F.sequence(F.lit(0), F.lit(k))

    def matrix(products: Column) -> Column:
        def entry(i: Column, j: Column) -> Column:
            value = F.get(products, _place(F.least(i, j), F.greatest(i, j), k + 1))
            return F.when((i == j) & (i < k), value + F.get(ridge, i)).otherwise(value)
        return F.transform(index, lambda i: F.transform(index, lambda j: entry(i, j)))

    def sweep(m: Column, p: Column) -> Column:
        pivot = F.get(m, p)
        d = F.get(pivot, p)
        return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(
            (i == p) & (j == p), F.lit(-1.0) / d).when((i == p) | (j == p), x / d).otherwise(
            x - F.get(row, p) * F.get(pivot, j) / d)))

    def read(swept: Column) -> Column:
        # The swept corner is the squared error plus what the ridge adds to it; the swept diagonal
        # is minus the inverse, and gives the degrees of freedom that the ridge leaves.
        weights = F.slice(F.get(swept, k), 1, k)
        penalty = F.aggregate(F.zip_with(weights, ridge, lambda w, r: w * w * r), F.lit(0.0),
                              lambda s, v: s + v)
        taken = F.aggregate(F.zip_with(F.sequence(F.lit(0), F.lit(k - 1)), ridge, lambda i, r:
                                       F.lit(1.0) + r * F.get(F.get(swept, i), i)),
                            F.lit(0.0), lambda s, v: s + v)
        error = F.greatest(F.get(F.get(swept, k), k) - penalty, F.lit(0.0))
        return F.struct(
            weights.alias("weights"),
            F.sqrt(error / F.greatest(F.col("n") - taken, F.lit(1.0))).alias("sigma"),
            F.transform(F.slice(swept, 1, k), lambda row: F.transform(
                F.slice(row, 1, k), lambda v: -v)).alias("covariance"))

    fit = _let(F.col("products"), lambda products: _let(
        F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix(products), sweep), read))
    return sums.withColumn("_fit", fit).drop("products").select(
        "*", "_fit.weights", "_fit.sigma", "_fit.covariance").drop("_fit")


def _draws(series: DataFrame, draws: int, steps: int, seed: int) -> Column:
    """For every draw and step a uniform number, a bend of mean size 1 and a normal number."""
    def part(code: Column, at: int) -> Column:
        return (F.conv(F.substring(code, at, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 32)

    def drawn(s: Column, h: Column) -> Column:
        code = F.md5(F.concat_ws(":", F.lit(seed), s, h).cast("binary"))
        side = part(code, 9) - 0.5
        return F.struct(
            part(code, 1).alias("u"),
            (-F.signum(side) * F.log(F.greatest(1 - 2 * F.abs(side), F.lit(1e-12)))).alias("bend"),
            (F.sqrt(-2 * F.log(part(code, 17))) * F.cos(2 * F.pi() * part(code, 25))).alias("noise"))

    table = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda s: F.transform(
        F.sequence(F.lit(1), F.lit(steps)), lambda h: drawn(s, h)))
    return one_row(series.sparkSession.range(1).select(table.alias("d")))["d"]


def _deviations(draws: Column, ahead: Column, rate: float) -> Column:
    """For every draw, how far its future is off the forecast at each step.

    ``ahead`` has the scaled moments of the last row and all steps, the spread of the noise at each
    step and the mean strength of a bend. A bend begins at a step with the chance that ``rate`` gives
    for the time since the step before, and its effect grows from there.
    """
    def path(own: Column) -> Column:
        def step(state: Column, h: Column) -> Column:
            time = F.get(ahead["moments"], h) - F.get(ahead["moments"], h - 1)
            draw = F.get(own, h - 1)
            slope = state["slope"] + F.when(draw["u"] < time * rate, draw["bend"] * ahead["strength"]) \
                .otherwise(F.lit(0.0))
            off = state["off"] + slope * time
            return F.struct(slope.alias("slope"), off.alias("off"), F.array_append(
                state["path"], off + F.get(ahead["spread"], h - 1) * draw["noise"]).alias("path"))

        start = F.struct(F.lit(0.0).alias("slope"), F.lit(0.0).alias("off"),
                         F.array().cast("array<double>").alias("path"))
        steps = F.sequence(F.lit(1), F.size(ahead["moments"]) - 1)
        return F.aggregate(steps, start, step, lambda s: s["path"])

    return F.transform(draws, path)


def _quantile(ordered: Column, p: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return below + (above - below) * (at - low)


def forecast(series: DataFrame, period: str, steps: int, by: Sequence[str] = (), *,
             history: bool = False, shape: Shape | None = None, level: float = 0.8,
             draws: int = 200, seed: int = 42, **options) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper, trend, yearly, weekly, is_future).

    The next ``steps`` periods of each series (keys, ds, y), on its own calendar, with bounds that
    hold the share ``level`` of the simulated futures. With ``history`` the fitted past rows are
    included, with bounds of constant width. ``options`` change single values of the ``Shape``.
    """
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")
    by, shape = list(by), replace(shape or SHAPES[period], **options)
    fit = solved(normal_sums(series, shape, by), shape)
    c, y = shape.changes, 2 * shape.yearly

    def part(first: int, size: int) -> Column:
        return F.col("scale") * _dot(F.slice("_x", first, size), F.slice("weights", first, size)) \
            if size else F.lit(0.0)

    def shown(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({
            "trend": part(1, 2 + c), "yearly": part(3 + c, y),
            "weekly": part(3 + c + y, 2 * shape.weekly)})
        return rows.withColumn("yhat", F.col("trend") + F.col("yearly") + F.col("weekly"))

    out_columns = [*by, "ds", "yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly",
                   "is_future"]
    bends = F.slice("weights", 3, c)
    strength = F.aggregate(bends, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.lit(float(max(c, 1)))
    ahead = fit.withColumn("_days", F.sequence(
        add_steps(F.col("last"), period, 1), add_steps(F.col("last"), period, steps),
        step_interval(period)))
    moments = F.transform(F.concat(F.array("last"), "_days"),
                          lambda d: F.datediff(d, "first") / F.col("span"))
    ahead = ahead.withColumns({
        "_draws": _draws(series, draws, steps, seed),
        "_terms": F.transform("_days", lambda d: _terms(
            shape, d, F.datediff(d, "first") / F.col("span")))})
    # What the weights leave open grows away from the history.
    spread = F.transform("_terms", lambda x: F.col("sigma") * F.sqrt(1 + F.greatest(_dot(
        x, F.transform("covariance", lambda row: _dot(row, x))), F.lit(0.0))))
    known = F.struct(moments.alias("moments"), spread.alias("spread"), strength.alias("strength"))
    ahead = ahead.withColumn("_ordered", _let(known, lambda v: _let(
        _deviations(F.col("_draws"), v, c / shape.reach), lambda off: F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)),
            lambda h: F.array_sort(F.transform(off, lambda path: F.get(path, h)))))))
    tail = (1 - level) / 2
    ahead = ahead.select("*", F.inline(F.arrays_zip(
        F.col("_days").alias("ds"), F.col("_terms").alias("_x"), F.col("_ordered").alias("_at"))))
    at = F.col("_at")
    ahead = shown(ahead).withColumns({
        "yhat_lower": F.col("yhat") + F.col("scale") * _quantile(at, tail),
        "yhat_upper": F.col("yhat") + F.col("scale") * _quantile(at, 1 - tail),
        "is_future": F.lit(True)}).select(*out_columns)
    if not history:
        return ahead
    half = F.lit(NormalDist().inv_cdf(1 - tail)) * F.col("sigma") * F.col("scale")
    past = fit.select("*", F.explode("days").alias("ds"))
    past = shown(past.withColumn("_x", _terms(
        shape, F.col("ds"), F.datediff("ds", "first") / F.col("span")))).withColumns({
        "yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half,
        "is_future": F.lit(False)}).select(*out_columns)
    return past.unionByName(ahead)
