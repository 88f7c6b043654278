"""Product performance, top lists and the revenue concentration curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.numeric import (
    guarded_ratio, half_even, minor_units, money_count, money_sum)
from patronage.functions.ordering import with_running
from patronage.functions.stats import one_row
from patronage.session import settle


def product_performance(transactions: DataFrame, product: str | None = None,
                        amount: str | None = None) -> DataFrame:
    """Revenue, sales and mean price per product; rows without a product are left out."""
    product = roles.pick(transactions, product, roles.PRODUCT, "product")
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    return (transactions.filter(F.col(product).isNotNull())
            .groupBy(F.col(product).alias("product_id"))
            .agg(money_sum(amount).alias("total_revenue"),
                 money_count(amount).alias("total_sales"))
            .withColumn("avg_price", half_even(
                guarded_ratio(F.col("total_revenue"), F.col("total_sales")))))


def top_by_revenue(performance: DataFrame, n: int = 10) -> DataFrame:
    return performance.orderBy(F.desc("total_revenue"), "product_id").limit(n)


def top_by_volume(performance: DataFrame, n: int = 10) -> DataFrame:
    """Most sold first; equal volumes keep their revenue order."""
    return performance.orderBy(F.desc("total_sales"), F.desc("total_revenue"),
                               "product_id").limit(n)


def _with_share(performance: DataFrame) -> DataFrame:
    total = one_row(performance.agg(money_sum("total_revenue").alias("t")))["t"]
    share = guarded_ratio(F.col("total_revenue"), total) * 100
    return performance.withColumn("_total", total).withColumn(
        "revenue_share", half_even(share))


def product_summary(performance: DataFrame, n: int = 20) -> DataFrame:
    """The n best-selling products with their share of all revenue.

    The product table is written first: its total and its rows come from one pass over the sales.
    """
    return top_by_revenue(_with_share(settle(performance)).drop("_total"), n)


def pareto(performance: DataFrame, rounded: bool = False) -> DataFrame:
    """Products by revenue with their rank from 0 and the cumulative revenue share.

    Exact mode divides an exact running revenue by the total. ``rounded`` instead adds up the
    two-decimal shares, as a report built from a displayed table would. Either way the running
    sum is over whole numbers and is computed range by range, not in one task. The product
    table is written first, so the sales themselves are aggregated once.
    """
    shared = _with_share(settle(performance))
    running = (minor_units("revenue_share") if rounded else minor_units("total_revenue"))
    ranked = with_running(shared, [F.desc("total_revenue"), F.col("product_id")],
                          {"_run": running}, position="product_rank")
    if rounded:
        cumulative = F.col("_run").cast("double") / 100
    else:
        cumulative = guarded_ratio(F.col("_run").cast("double") / 100, F.col("_total")) * 100
    return ranked.withColumn("cumulative_share", cumulative).drop("_run", "_total")


def pareto_summary(curve: DataFrame, threshold: float = 80.0) -> DataFrame:
    """How many products stay within the threshold of cumulative revenue."""
    within = F.count_if(F.col("cumulative_share") <= threshold)
    return curve.agg(within.alias("products_within"), F.count("*").alias("total_products")) \
        .select("products_within", "total_products",
                (guarded_ratio(F.col("products_within"), F.col("total_products"))
                 * 100).alias("pct_products"))
