"""Figures of a growing table from stored sketches, without reading old rows again.

A day's (or a file's) sketch is written once. Any span is then the union of its days' sketches: the
number of different customers to within the sketch's error, and any quantile, histogram or scaling
statistic of a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.calendar import period_label, period_start
from patronage.functions.numeric import guarded_ratio, half_even, money_count, money_sum

# 2 ** LOG_SIZE registers: a relative standard error of about 0.8 %.
LOG_SIZE = 14
# Size of the quantile sketches: ranks are off by about 0.3 % of the rows at most.
QUANTILE_SIZE = 800


def daily_sketches(transactions: DataFrame, amount: str | None = None, date: str | None = None,
                   customer: str | None = None) -> DataFrame:
    """(day, total_revenue, transaction_count, customers): one small row per day of sales."""
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    date = roles.pick(transactions, date, roles.SALES_DATE, "date")
    customer = roles.pick(transactions, customer, roles.SALES_CUSTOMER, "customer")
    return (transactions.filter(F.col(date).isNotNull())
            .groupBy(period_start(F.col(date), "day").alias("day"))
            .agg(money_sum(amount).alias("total_revenue"),
                 money_count(amount).alias("transaction_count"),
                 F.hll_sketch_agg(customer, LOG_SIZE).alias("customers")))


def rolled_up(days: DataFrame, period: str) -> DataFrame:
    """Revenue, transactions and different customers per period, from stored days alone."""
    return (days.groupBy(period_start(F.col("day"), period).alias("period_start"))
            .agg(money_sum("total_revenue").alias("total_revenue"),
                 F.sum("transaction_count").alias("transaction_count"),
                 F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"))
            .select("period_start", period_label(F.col("period_start"), period).alias("period"),
                    "total_revenue", "transaction_count", "unique_customers",
                    half_even(guarded_ratio(F.col("total_revenue"), F.col("transaction_count")))
                    .alias("avg_transaction")))


def customers_between(days: DataFrame, first: str, last: str) -> DataFrame:
    """One row: different customers from ``first`` to ``last``, both included."""
    return days.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).cast("bigint")
        .alias("unique_customers"))


def column_sketches(df: DataFrame, columns: Sequence[str], part: Column | None = None) -> DataFrame:
    """(part, feature, n, total, squares, low, high, sketch): one row per part and column.

    ``part`` says which rows belong together, such as the file or the day they came with.
    """
    part = F.input_file_name() if part is None else part
    long = df.select(part.cast("string").alias("part"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns])).alias("e")).select("part", "e.*").filter(
        F.col("value").isNotNull() & ~F.isnan("value"))
    v = F.col("value")
    return long.groupBy("part", "feature").agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(QUANTILE_SIZE)).alias("sketch"))


def profile(sketches: DataFrame) -> DataFrame:
    """(feature, count, mean, std, min, p25, p50, p75, max) from stored sketches.

    Count, mean, deviation and limits are those of all rows; a quartile is a value whose rank is off
    by the sketch's error at most.
    """
    merged = sketches.groupBy("feature").agg(
        F.sum("n").alias("count"), F.sum("total").alias("_t"), F.sum("squares").alias("_s"),
        F.min("low").alias("min"), F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch").alias("_k"))
    mean = F.col("_t") / F.col("count")
    spread = F.greatest(F.col("_s") - F.col("_t") * mean, F.lit(0.0))
    quartiles = {f"p{int(100 * p)}": F.kll_sketch_get_quantile_double("_k", F.lit(p))
                 for p in (0.25, 0.5, 0.75)}
    return merged.select(
        "feature", "count", mean.alias("mean"),
        F.sqrt(F.try_divide(spread, F.col("count") - 1)).alias("std"), "min",
        *[q.alias(n) for n, q in quartiles.items()], "max")


def histogram(sketches: DataFrame, bins: int, marks: int = 500) -> DataFrame:
    """(feature, bin, lower, upper, share): equal-width bins and about which share of rows each has.

    The shares are read from ``marks`` quantiles, so they are multiples of 1 / ``marks``.
    """
    at = [(i + 0.5) / marks for i in range(marks)]
    merged = sketches.groupBy("feature").agg(
        F.min("low").alias("_lo"), F.max("high").alias("_hi"),
        F.kll_merge_agg_double("sketch").alias("_k"))
    merged = merged.select("feature", "_lo", "_hi", F.kll_sketch_get_quantile_double(
        "_k", F.array(*[F.lit(p) for p in at])).alias("_q"))
    edge = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(float(bins))
    out = merged.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumns(
        {"lower": edge(F.col("bin")), "upper": edge(F.col("bin") + 1)})
    last = F.col("bin") == bins - 1
    inside = F.size(F.filter("_q", lambda v: (v >= F.col("lower")) & ((v < F.col("upper")) | last)))
    return out.select("feature", F.col("bin").cast("bigint").alias("bin"), "lower", "upper",
                      (inside / F.lit(float(marks))).alias("share"))
