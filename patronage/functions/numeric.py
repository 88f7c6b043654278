"""Scalar expressions. Everything here is a plain Column, so it stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 2) -> Column:
    """Round a double the way numpy does: scale, round half to even, scale back."""
    factor = float(10 ** digits)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def minor_units(amount: Column | str, digits: int = 2) -> Column:
    """A money amount as a whole number of minor units (cents by default).

    Whole numbers make sums exact and independent of row order. NaN counts as missing.
    """
    value = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    units = F.rint(value * F.lit(float(10 ** digits))).cast("bigint")
    return F.when(~F.isnan(value), units.cast("decimal(19,0)"))


def money_sum(amount: Column | str, digits: int = 2) -> Column:
    """Aggregate: exact sum of an amount as double; 0 when every value is missing."""
    total = F.coalesce(F.sum(minor_units(amount, digits)), F.lit(0).cast("decimal(29,0)"))
    return total.cast("double") / F.lit(float(10 ** digits))


def money_count(amount: Column | str) -> Column:
    """Aggregate: number of amounts that are neither null nor NaN."""
    value = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    return F.count(F.when(~F.isnan(value), value))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, null where the bottom is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def finite_or_zero(value: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole 24-hour days (not calendar days)."""
    seconds = F.timestamp_diff("SECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return F.floor(seconds / F.lit(86400)).cast("bigint")


# Words that mean "churned" in a text target.
CHURNED_WORDS = ("1", "yes", "y", "true", "churn", "exited")


def binary_target(value: Column, type_name: str) -> Column:
    """Any target as 0/1: booleans as they are, numbers by > 0, text by known words."""
    if type_name == "boolean":
        hit = value
    elif type_name == "string":
        hit = F.lower(F.trim(value)).isin(*CHURNED_WORDS)
    else:
        hit = value.cast("double") > F.lit(0.0)
    return F.coalesce(hit, F.lit(False)).cast("int")


def risk_bucket(probability: Column) -> Column:
    """Low below .3, Medium below .7, else High; Unknown without a probability."""
    return (F.when(probability.isNull(), "Unknown")
            .when(probability < 0.3, "Low")
            .when(probability < 0.7, "Medium")
            .otherwise("High"))


def risk_segment(probability: Column) -> Column:
    """Right-closed chart bins (0,.3], (.3,.7], (.7,1]; null outside, so null at exactly 0."""
    return (F.when((probability > 0) & (probability <= 0.3), "Low Risk")
            .when((probability > 0.3) & (probability <= 0.7), "Medium Risk")
            .when((probability > 0.7) & (probability <= 1.0), "High Risk"))


def recency_score(days: Column) -> Column:
    """Decays with the days since the last purchase; 0 for a purchase today."""
    d = days.cast("double")
    return F.when(d > 0, F.lit(1.0) / (F.lit(1.0) + d / F.lit(30.0))).otherwise(F.lit(0.0))


# Display labels.
RISES, FALLS = "↑ increases churn risk", "↓ decreases churn risk"
ABOVE, BELOW, NEAR = "above average", "below average", "Near average"


def effect_label(impact: Column) -> Column:
    return F.when(impact > 0, RISES).otherwise(FALLS)


def anomaly_label(cluster: Column) -> Column:
    return F.when(cluster == -1, "Anomaly").otherwise("Normal")


def average_label(diff_pct: Column) -> Column:
    return (F.when(diff_pct > 10, ABOVE)
            .when(diff_pct < -10, BELOW)
            .otherwise(NEAR))


def hash_fraction(key: Column | str, seed: int) -> Column:
    """A reproducible uniform number in [0, 1) from a key, the same on any engine.

    The first 13 hexadecimal digits (52 bits) of the MD5 of "key:seed".
    """
    column = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat_ws(":", column.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16 ** 13))
