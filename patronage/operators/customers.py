"""Value per customer and the KPIs over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.numeric import guarded_ratio, half_even, money_count, money_sum
from patronage.functions.stats import equal_width_histograms

VALUE_COLUMNS = ("total_spent", "purchase_frequency", "avg_transaction_value")


def customer_performance(transactions: DataFrame, customer: str | None = None,
                         amount: str | None = None) -> DataFrame:
    """Spend, transactions and mean transaction per customer; null customers are left out."""
    customer = roles.pick(transactions, customer, roles.SALES_CUSTOMER, "customer")
    amount = roles.pick(transactions, amount, roles.SALES_AMOUNT, "amount")
    return (transactions.filter(F.col(customer).isNotNull())
            .groupBy(F.col(customer).alias("customer_id"))
            .agg(money_sum(amount).alias("total_spent"),
                 money_count(amount).alias("total_transactions"))
            .withColumn("avg_transaction", half_even(
                guarded_ratio(F.col("total_spent"), F.col("total_transactions")))))


def customer_value_kpis(performance: DataFrame) -> DataFrame:
    """Mean spend, mean transactions, and the share of customers who bought again."""
    return (performance
            .agg(money_sum("total_spent").alias("_spent"), F.count("*").alias("_n"),
                 F.sum("total_transactions").alias("_tx"),
                 F.count_if(F.col("total_transactions") > 1).alias("repeat_customers"))
            .select(guarded_ratio(F.col("_spent"), F.col("_n")).alias("avg_customer_value"),
                    guarded_ratio(F.col("_tx"), F.col("_n")).alias(
                        "avg_transactions_per_customer"),
                    "repeat_customers",
                    (guarded_ratio(F.col("repeat_customers"), F.col("_n")) * 100).alias(
                        "repeat_rate")))


def top_customers(performance: DataFrame, n: int = 20) -> DataFrame:
    return performance.orderBy(F.desc("total_spent"), "customer_id").limit(n)


def value_histograms(customers: DataFrame, bins: int = 30) -> DataFrame:
    """The distribution of each value column the table has."""
    present = [c for c in VALUE_COLUMNS if c in customers.columns]
    if not present:
        raise roles.MissingRole(f"none of {list(VALUE_COLUMNS)} in {customers.columns}")
    return equal_width_histograms(customers, present, bins)
