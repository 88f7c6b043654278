"""Imputation, label encoding and scaling with fitted parameters kept inside the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import finite_or_zero
from patronage.functions.ordering import with_running
from patronage.functions.stats import most_frequent_row, one_row, quantile_row
from patronage.roles import numeric_columns, string_columns
from patronage.session import settle


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
                  approx: bool = False) -> DataFrame:
    """Fill missing numbers with the column's exact median; all-missing columns stay null."""
    columns = list(columns or numeric_columns(df, exclude))
    if not columns:
        return df
    medians = one_row(quantile_row(df, columns, 0.5, approx))

    def filled(c: str):
        v = F.col(f"`{c}`").cast("double")
        return F.coalesce(F.when(~F.isnan(v), v), medians[c])

    return df.withColumns({c: filled(c) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None,
                exclude: Sequence[str] = ()) -> DataFrame:
    """Fill missing text with the column's most frequent value (smallest on ties)."""
    columns = list(columns or string_columns(df, exclude))
    if not columns:
        return df
    modes = one_row(most_frequent_row(df, columns))
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), modes[c]) for c in columns})


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): position of each value among the column's sorted values.

    Only distinct values are ordered, and over ranges, so a column with as many values as rows
    still spreads over the cluster.
    """
    distinct = (df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
                .unpivot([], list(columns), "feature", "value")
                .filter(F.col("value").isNotNull()).distinct())
    placed = settle(with_running(distinct, [F.col("feature"), F.col("value")], {}, "_position"))
    first = placed.groupBy("feature").agg(F.min("_position").alias("_first"))
    # One row per encoded column.
    return placed.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("_position") - F.col("_first")).alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace text columns by their codes; missing values stay null.

    The code table is written out when it is fitted, so the planner knows its true size and
    broadcasts it only below the session's threshold; beyond that it is a shuffled join.
    """
    if not columns:
        return df
    codes = codes if codes is not None else label_codes(df, columns)
    out = df
    for i, c in enumerate(columns):
        mine = codes.filter(F.col("feature") == c).select(
            F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(mine, F.col(f"`{c}`") == F.col(f"_value{i}"), "left")
    picked = {c: i for i, c in enumerate(columns)}
    return out.select(*[
        F.col(f"_code{picked[c]}").alias(c) if c in picked else F.col(f"`{c}`")
        for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df, exclude))
    if not columns:
        return df
    stats = one_row(df.agg(*[
        f(F.col(f"`{c}`").cast("double")).alias(f"{p}{i}") for i, c in enumerate(columns)
        for p, f in (("m", F.avg), ("s", F.stddev_pop))]))
    return df.withColumns({
        c: F.when(F.col(f"`{c}`").isNull(), F.lit(None).cast("double"))
        .when(stats[f"s{i}"] > 0,
              (F.col(f"`{c}`").cast("double") - stats[f"m{i}"]) / stats[f"s{i}"])
        .otherwise(F.lit(0.0))
        for i, c in enumerate(columns)})


def safe_numeric(df: DataFrame, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The key and all numeric features, with NaN, infinities and nulls as 0."""
    features = numeric_columns(df, [key, *exclude])
    return df.select(key, *[finite_or_zero(F.col(f"`{c}`")).alias(c) for c in features])
