"""Sales KPIs, period trends and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.calendar import period_label, period_start
from patronage.functions.numeric import guarded_ratio, half_even, money_count, money_sum
from patronage.functions.stats import one_row


def overview_kpis(customers: DataFrame, transactions: DataFrame | None = None,
                  amount: str = "amount", churn: str = "churn") -> DataFrame:
    """Customers, revenue, churn rate in percent, average transaction.

    Missing inputs give 0 for money and null for the churn rate.
    """
    rate = (F.avg(F.col(churn).cast("double")) * 100 if churn in customers.columns
            else F.lit(None).cast("double"))
    base = customers.agg(F.count("*").alias("total_customers"), rate.alias("churn_rate"))
    if transactions is None or amount not in transactions.columns:
        return base.withColumns({"total_revenue": F.lit(0.0), "avg_transaction": F.lit(0.0)})
    money = one_row(transactions.agg(money_sum(amount).alias("total"),
                                     money_count(amount).alias("n")))
    return base.select(
        "total_customers", money["total"].alias("total_revenue"), "churn_rate",
        guarded_ratio(money["total"], money["n"]).alias("avg_transaction"))


def sales_kpis(transactions: DataFrame, amount: str | None = None, customer: str | None = None,
               approx: bool = False) -> DataFrame:
    """Revenue, transactions, mean transaction, distinct customers (null without that column)."""
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    customer = customer or roles.first_match(transactions.columns, roles.SALES_CUSTOMER)
    distinct = F.approx_count_distinct if approx else F.count_distinct
    who = (distinct(customer) if customer else F.lit(None).cast("bigint"))
    return (transactions
            .agg(money_sum(amount).alias("total_revenue"), money_count(amount).alias("_n"),
                 F.count("*").alias("total_transactions"), who.alias("unique_customers"))
            .select("total_revenue", "total_transactions",
                    guarded_ratio(F.col("total_revenue"), F.col("_n")).alias("avg_transaction"),
                    "unique_customers"))


def sales_trend(transactions: DataFrame, period: str = "month", amount: str | None = None,
                date: str | None = None) -> DataFrame:
    """Revenue, count and mean per period; rows without a date are left out."""
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    date = roles.pick(transactions, date, roles.SALES_DATE, "date")
    start = period_start(F.col(date), period)
    return (transactions.filter(F.col(date).isNotNull())
            .groupBy(start.alias("period_start"))
            .agg(money_sum(amount).alias("total_revenue"),
                 money_count(amount).alias("transaction_count"))
            .select("period_start", period_label(F.col("period_start"), period).alias("period"),
                    "total_revenue", "transaction_count",
                    half_even(guarded_ratio(F.col("total_revenue"), F.col("transaction_count"))
                              ).alias("avg_transaction")))


def sales_growth(trend: DataFrame) -> DataFrame:
    """Period-over-period growth in percent; null for the first period and after a zero.

    The input has one row per period, so the single-partition window stays small however many
    transactions there were.
    """
    by_period = Window.orderBy("period_start")

    def growth(column: str):
        now = F.col(column).cast("double")
        before = F.lag(now).over(by_period)
        return (F.try_divide(now, before) - 1) * 100

    return trend.withColumns({"revenue_growth": growth("total_revenue"),
                              "transaction_growth": growth("transaction_count")})


def growth_summary(growth: DataFrame) -> DataFrame:
    """Mean growth rates and the growth of the latest period."""
    return growth.agg(F.avg("revenue_growth").alias("avg_revenue_growth"),
                      F.avg("transaction_growth").alias("avg_transaction_growth"),
                      F.max_by("revenue_growth", "period_start").alias("latest_growth"))
