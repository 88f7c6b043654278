"""Sales series and a trend-plus-seasonality forecast, for one series or thousands.

The trend is a least-squares line fitted together with one effect per month of the year: its
slope is taken within equal months, so a seasonal swing is not mistaken for growth. Histories
shorter than two years cannot tell the two apart and get the plain line. The yearly effect is the
mean detrended value per month, and daily series add a weekly effect per day of the week.
Everything is a window over one row per (series, period), so all series are fitted in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.calendar import add_steps, period_start, step_interval
from patronage.functions.numeric import guarded_ratio, half_even, minor_units, money_sum
from patronage.functions.stats import one_row

# Half-width of an 80 % normal interval in standard deviations.
Z80 = 1.2815515655446004
PERIODS = ("day", "week", "month")


def sales_series(transactions: DataFrame, period: str = "week", amount: str | None = None,
                 date: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(keys, ds, y): revenue per period start. Dateless rows are dropped, gaps stay gaps."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    date = roles.pick(transactions, date, roles.SALES_DATE, "date")
    return (transactions.filter(F.col(date).isNotNull())
            .groupBy(*by, period_start(F.col(date), period).alias("ds"))
            .agg(money_sum(amount).alias("y")))


def future_calendar(series: DataFrame, period: str, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(keys, ds): the next ``steps`` period starts after each series' last one."""
    by = list(by)
    last = series.groupBy(*by).agg(F.max("ds").alias("_last")) if by else series.agg(
        F.max("ds").alias("_last"))
    return last.filter(F.col("_last").isNotNull()).select(*by, _future(F.col("_last"), period, steps).alias("ds"))


def _future(last: Column, period: str, steps: int) -> Column:
    return F.explode(F.sequence(add_steps(last, period, 1), add_steps(last, period, steps),
                                step_interval(period)))


# From this many days of history on, every month start has been seen twice.
JOINT_FIT_DAYS = 690


def _line(series: DataFrame, by: list[str]) -> DataFrame:
    """History with the slope and level (cents, at the first day) of its series on every row."""
    keys = by or [F.lit(0)]
    everything = Window.partitionBy(*keys)
    same_month = Window.partitionBy(*keys, "_month")
    out = series.select(*by, "ds", "y", minor_units("y").alias("_c"), F.month("ds").alias("_month"))
    if by:
        # One shuffle and one sort serve every window below.
        out = out.repartition(*by).sortWithinPartitions(*by, "_month")
    out = out.withColumn("_first", F.min("ds").over(everything))
    out = out.withColumn("_x", F.datediff("ds", "_first").cast("bigint"))
    out = out.withColumns({
        "_mx": F.avg("_x").over(everything),
        "_mc": F.sum("_c").over(everything).cast("double") / F.count("_c").over(everything),
        "_span": F.max("_x").over(everything),
        "_mx_m": F.sum("_x").over(same_month).cast("double") / F.count("_x").over(same_month),
        "_mc_m": F.sum("_c").over(same_month).cast("double") / F.count("_c").over(same_month)})

    def slope(x: Column, c: Column) -> Column:
        return F.try_divide(F.sum(x * c).over(everything), F.sum(x * x).over(everything))

    c = F.col("_c").cast("double")
    joint = slope(F.col("_x") - F.col("_mx_m"), c - F.col("_mc_m"))
    plain = slope(F.col("_x") - F.col("_mx"), c - F.col("_mc"))
    out = out.withColumn("_slope", F.coalesce(
        F.when(F.col("_span") >= JOINT_FIT_DAYS, joint), plain, F.lit(0.0)))
    return out.withColumn("_level", F.col("_mc") - F.col("_slope") * F.col("_mx"))


def _trend(x: Column) -> Column:
    return (F.col("_level") + F.col("_slope") * x.cast("double")) / F.lit(100.0)


def fitted(series: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """History rows with trend, yearly, weekly, yhat and the series' parameters.

    All windows share the series key, so the rows are shuffled once. A series has one row per
    period, which bounds a window's size by the length of the history, not by the sales.
    """
    by = list(by)
    out = _line(series, by)
    keys = by or [F.lit(0)]
    out = out.withColumns({
        "trend": _trend(F.col("_x")),
        "yearly": (F.col("_mc_m") - (F.col("_level") + F.col("_slope") * F.col("_mx_m")))
        / F.lit(100.0)})
    if period == "day":
        out = out.withColumn("_dow", F.weekday("ds"))
        same_day = Window.partitionBy(*keys, "_dow")
        out = out.withColumn("weekly", F.avg(
            F.col("y") - F.col("trend") - F.col("yearly")).over(same_day))
    else:
        out = out.withColumns({"_dow": F.lit(0), "weekly": F.lit(0.0)})
    out = out.withColumn("yhat", F.col("trend") + F.col("yearly") + F.col("weekly"))
    left = F.col("y") - F.col("yhat")
    everything = Window.partitionBy(*keys)
    return out.withColumn("_sigma", F.sqrt(F.avg(left * left).over(everything)))


def _bounds(df: DataFrame) -> DataFrame:
    half = F.lit(Z80) * F.col("_sigma")
    return df.withColumns({"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half})


def _parameters(history: DataFrame, by: list[str]) -> DataFrame:
    """One row per series: line, spread, last period, and the small effect tables (12 months, 7 weekdays)."""
    def effects(index: str, value: str, slots: range) -> Column:
        # The value is the same on all rows of a slot; a slot never seen stays null.
        return F.array(*[F.max(F.when(F.col(index) == i, F.col(value))) for i in slots])

    aggs = [F.max("ds").alias("_last"), F.min("ds").alias("_first"), F.first("_slope").alias("_slope"),
            F.first("_level").alias("_level"), F.first("_sigma").alias("_sigma"),
            effects("_month", "yearly", range(1, 13)).alias("_yearly"),
            effects("_dow", "weekly", range(7)).alias("_weekly")]
    return history.groupBy(*by).agg(*aggs) if by else history.agg(*aggs)


def forecast(series: DataFrame, period: str, steps: int, by: Sequence[str] = (),
             history: bool = False) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper, trend, yearly, weekly, is_future).

    The future continues the series' own calendar. With ``history`` the fitted past rows are
    included.
    """
    by = list(by)
    past = fitted(series, period, by)
    fit = _parameters(past, by).filter(F.col("_last").isNotNull())
    ahead = fit.select("*", _future(F.col("_last"), period, steps).alias("ds"))
    ahead = ahead.withColumns({
        "trend": _trend(F.datediff("ds", "_first")),
        "yearly": F.coalesce(F.get("_yearly", F.month("ds") - 1), F.lit(0.0)),
        "weekly": F.coalesce(F.get("_weekly", F.weekday("ds")), F.lit(0.0))
        if period == "day" else F.lit(0.0)})
    ahead = ahead.withColumn("yhat", F.col("trend") + F.col("yearly") + F.col("weekly"))
    shape = [*by, "ds", "yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly", "is_future"]
    out = _bounds(ahead).withColumn("is_future", F.lit(True)).select(*shape)
    if history:
        out = _bounds(past).withColumn("is_future", F.lit(False)).select(*shape).unionByName(out)
    return out


def forecast_table(forecasted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The future rows for display: date, forecast and bounds with two decimals."""
    return forecasted.filter("is_future").select(
        *by, F.col("ds").cast("date").alias("date"), half_even(F.col("yhat")).alias("forecast"),
        half_even(F.col("yhat_lower")).alias("lower_bound"),
        half_even(F.col("yhat_upper")).alias("upper_bound"))


def components(forecasted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend and seasonal effects per period, history and future."""
    return forecasted.select(*by, "ds", "trend", "yearly", "weekly")


# What a projected growth suggests.
OUTLOOKS = {
    "strong": ("Capitalize on growth momentum", "Increase inventory to meet demand",
               "Consider expansion opportunities"),
    "mild": ("Maintain current strategies", "Monitor market conditions closely",
             "Optimize operational efficiency"),
    "decline": ("Review and adjust marketing strategies", "Analyze customer retention metrics",
                "Consider promotional campaigns"),
}


def forecast_summary(series: DataFrame, forecasted: DataFrame) -> DataFrame:
    """Averages, projected growth, total, trend direction, best and worst period, outlook.

    ``forecasted`` must include the history; both are one row per period of one series.
    """
    past = one_row(series.agg(money_sum("y").alias("total"), F.count("*").alias("n")))
    mean_past = guarded_ratio(past["total"], past["n"])
    ahead = F.col("is_future")
    sums = forecasted.agg(
        F.avg(F.when(ahead, F.col("yhat"))).alias("avg_forecast"),
        F.sum(F.when(ahead, F.col("yhat"))).alias("total_forecast"),
        F.max_by("trend", "ds").alias("_last"), F.min_by("trend", "ds").alias("_first"),
        F.max_by(F.when(ahead, F.col("ds")), F.when(ahead, F.col("yhat"))).alias("best_period"),
        F.min_by(F.when(ahead, F.col("ds")), F.when(ahead, F.col("yhat"))).alias("worst_period"))
    growth = F.when(mean_past > 0, (F.col("avg_forecast") - mean_past) / mean_past * 100) \
        .otherwise(F.lit(0.0))
    return (sums.withColumn("avg_historical", mean_past).withColumn("growth_pct", growth)
            .select("avg_historical", "avg_forecast", "growth_pct", "total_forecast",
                    F.when(F.col("_last") > F.col("_first"), "increasing").otherwise(
                        "decreasing").alias("trend_direction"),
                    "best_period", "worst_period",
                    F.when(F.col("growth_pct") > 5, "strong").when(
                        F.col("growth_pct") > 0, "mild").otherwise("decline").alias("outlook")))


def outlook_advice(summary: DataFrame) -> DataFrame:
    """(outlook, position, advice) for the summary's outlook."""
    def texts(level: str) -> Column:
        return F.array(*[F.lit(t) for t in OUTLOOKS[level]])

    chosen = (F.when(F.col("outlook") == "strong", texts("strong"))
              .when(F.col("outlook") == "mild", texts("mild")).otherwise(texts("decline")))
    return summary.select("outlook", F.posexplode(chosen).alias("_p", "advice")).select(
        "outlook", (F.col("_p") + 1).cast("bigint").alias("position"), "advice")
