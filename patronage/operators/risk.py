"""From churn probabilities to risk groups, actions and revenue at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import (
    guarded_ratio, money_sum, risk_bucket, risk_segment)
from patronage.functions.stats import one_row

# What to do for a customer of each risk group, in this order.
RETENTION_ACTIONS = {
    "High": (
        "Call / message customer personally",
        "Offer discount / loyalty plan upgrade",
        "Provide priority support",
        "Check payment issues / service complaints",
        "Share personalized offers (based on usage)",
    ),
    "Medium": (
        "Send engagement email / app notification",
        "Recommend features / onboarding help",
        "Small coupon / bonus points",
        "Monitor usage weekly",
    ),
    "Low": (
        "Keep regular engagement",
        "Upsell only if customer is active",
        "Collect feedback periodically",
    ),
}
SEGMENTS = ("Low Risk", "Medium Risk", "High Risk")


def with_risk(predictions: DataFrame, probability: str = "churn_probability") -> DataFrame:
    return predictions.withColumn("risk", risk_bucket(F.col(probability)))


def risk_segment_counts(predictions: DataFrame,
                        probability: str = "churn_probability") -> DataFrame:
    """Customers per chart bin; bins without customers are shown with 0."""
    return (predictions
            .agg(*[F.count_if(risk_segment(F.col(probability)) == s).alias(s)
                   for s in SEGMENTS])
            .select(F.explode(F.array(*[
                F.struct(F.lit(s).alias("risk_segment"), F.col(f"`{s}`").alias("customers"))
                for s in SEGMENTS])).alias("r")).select("r.*"))


def retention_actions(with_risk_column: DataFrame, key: str) -> DataFrame:
    """(key, risk, position, action): the ordered actions for every customer.

    The action lists are constants of the plan, so no lookup join is needed.
    """
    def listed(level: str):
        return F.array(*[F.lit(a) for a in RETENTION_ACTIONS[level]])

    actions = (F.when(F.col("risk") == "High", listed("High"))
               .when(F.col("risk") == "Medium", listed("Medium"))
               .otherwise(listed("Low")))
    return with_risk_column.select(
        key, "risk", F.posexplode(actions).alias("_p", "action")).select(
        key, "risk", (F.col("_p") + 1).cast("bigint").alias("position"), "action")


def revenue_and_churn(predictions: DataFrame, performance: DataFrame,
                      key: str = "customer_id") -> DataFrame:
    """Spend beside probability and class, matched on the customer key."""
    return predictions.join(performance, key, "left").select(
        key, "churn_probability", "churn_prediction", "total_spent", "total_transactions")


def revenue_at_risk(predictions: DataFrame, performance: DataFrame, key: str = "customer_id",
                    threshold: float = 0.7) -> DataFrame:
    """Spend of the customers above the threshold, its share of all spend, and its mean."""
    everything = one_row(performance.agg(money_sum("total_spent").alias("t")))["t"]
    high = revenue_and_churn(predictions, performance, key).filter(
        F.col("churn_probability") > threshold)
    return (high.agg(F.count("*").alias("high_risk_customers"),
                     F.count("total_spent").alias("_known"),
                     money_sum("total_spent").alias("revenue_at_risk"))
            .select("high_risk_customers", "revenue_at_risk",
                    (guarded_ratio(F.col("revenue_at_risk"), everything) * 100).alias(
                        "pct_of_revenue"),
                    guarded_ratio(F.col("revenue_at_risk"), F.col("_known")).alias(
                        "avg_high_risk_value")))


def churn_distribution(predictions: DataFrame,
                       prediction: str = "churn_prediction") -> DataFrame:
    """Customers per class, labelled by value."""
    status = F.when(F.col(prediction) == 1, "Churned").otherwise("Not Churned")
    return predictions.groupBy(status.alias("status")).agg(F.count("*").alias("customers"))


def top_risk(predictions: DataFrame, key: str = "customer_id", n: int = 50) -> DataFrame:
    return predictions.orderBy(F.desc("churn_probability"), key).limit(n)
