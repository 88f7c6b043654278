"""Behaviour features per customer: frequency, spend, recency, engagement, tenure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.calendar import parsed_timestamp
from patronage.functions.numeric import money_sum, recency_score, whole_days
from patronage.functions.stats import one_row

NO_PURCHASE_DAYS = 365


def _as_of(value: str | Column | None) -> Column:
    if value is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def customer_rfm(customers: DataFrame, transactions: DataFrame, as_of: str | Column | None,
                 key: str = "customer_id", customer: str | None = None,
                 amount: str | None = None, date: str | None = None) -> DataFrame:
    """Customers plus frequency, spend, mean value, last purchase and days since then.

    All transaction features come from one aggregate over one scan, joined once. Customers
    without purchases get 0, 0, 0, null and 365 days. Amount and date are optional columns of
    the transactions; without them the features they feed are left out.
    """
    customer = roles.pick(transactions, customer, roles.FEATURE_CUSTOMER, "customer")
    amount = amount or roles.first_match(transactions.columns, roles.FEATURE_AMOUNT)
    date = date or roles.first_match(transactions.columns, roles.TRANSACTION_DATE)
    parts = [F.count("*").alias("purchase_frequency")]
    if amount:
        parts.append(money_sum(amount).alias("total_spent"))
    if date:
        parts.append(F.max(F.col(date).cast("timestamp_ntz")).alias("last_purchase_date"))
    made = ["purchase_frequency", "total_spent", "last_purchase_date", "avg_transaction_value",
            "days_since_last_purchase"]
    base = customers.drop(*[c for c in made if c in customers.columns])
    per_customer = (transactions.filter(F.col(customer).isNotNull())
                    .groupBy(F.col(customer).alias(key)).agg(*parts))
    out = base.join(per_customer, key, "left").withColumn(
        "purchase_frequency", F.coalesce("purchase_frequency", F.lit(0)).cast("bigint"))
    if amount:
        out = out.withColumn("total_spent", F.coalesce("total_spent", F.lit(0.0))).withColumn(
            "avg_transaction_value",
            F.when(F.col("purchase_frequency") > 0,
                   F.col("total_spent") / F.col("purchase_frequency")).otherwise(F.lit(0.0)))
    if date:
        out = out.withColumn("days_since_last_purchase", F.coalesce(
            whole_days(F.col("last_purchase_date"), _as_of(as_of)),
            F.lit(NO_PURCHASE_DAYS).cast("bigint")))
    return out


def with_engagement(df: DataFrame) -> DataFrame:
    """Add the recency score, the normalised inputs and the engagement score.

    Inputs are whichever of frequency, spend and recency score are present. Each is centred and
    divided by its sample standard deviation (0 where that is not positive); the score is the
    mean of the available ones.
    """
    inputs = [c for c in ("purchase_frequency", "total_spent") if c in df.columns]
    if "days_since_last_purchase" in df.columns:
        df = df.withColumn("recency_score", recency_score(F.col("days_since_last_purchase")))
        inputs.append("recency_score")
    if not inputs:
        return df
    stats = one_row(df.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in inputs
                             for p, f in (("m", F.avg), ("s", F.stddev_samp))]))
    for c in inputs:
        spread = F.coalesce(stats[f"s_{c}"], F.lit(0.0))
        df = df.withColumn(f"{c}_normalized", F.when(
            spread > 0, (F.col(c).cast("double") - stats[f"m_{c}"]) / spread)
            .otherwise(F.lit(0.0)))
    total = sum((F.col(f"{c}_normalized") for c in inputs[1:]), F.col(f"{inputs[0]}_normalized"))
    return df.withColumn("engagement_score", total / F.lit(float(len(inputs))))


def with_tenure(df: DataFrame, as_of: str | Column | None, signup: str | None = None) -> DataFrame:
    """Add whole days since signup; 0 when the date is missing or no date."""
    signup = signup or roles.first_match(df.columns, roles.SIGNUP_DATE)
    if signup is None:
        return df
    when = F.col(signup)
    if df.schema[signup].dataType.typeName() == "string":
        when = parsed_timestamp(when)
    return df.withColumn("subscription_tenure_days", F.coalesce(
        whole_days(when, _as_of(as_of)), F.lit(0).cast("bigint")))


def first_purchase(transactions: DataFrame, customer: str, date: str) -> DataFrame:
    """The first purchase per customer, for tables that carry no signup date."""
    return transactions.filter(F.col(customer).isNotNull()).groupBy(
        F.col(customer).alias("customer_id")).agg(F.min(date).alias("start_date"))
