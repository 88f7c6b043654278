"""Which column plays which part.

Tables arrive with free column names; each part has an ordered list of known names and the
first one present wins. Only column metadata is looked at, except for the two-valued
fallback of :func:`find_target`, which needs one aggregate over the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from patronage.functions.stats import one_row

# The known column names per part, in order of preference.
PARSED_DATES = ("date", "transaction_date", "created_at", "timestamp")
TRANSACTION_DATE = ("date", "transaction_date", "created_at", "timestamp")
SALES_DATE = ("date", "transaction_date", "created_at", "timestamp", "purchase_date")
FEATURE_AMOUNT = ("amount",)
SALES_AMOUNT = ("amount", "total", "price", "value", "revenue")
PRODUCT = ("product_id", "product", "item_id", "item", "product_name")
FEATURE_CUSTOMER = ("customer_id", "user_id", "id")
SALES_CUSTOMER = ("customer_id", "user_id", "customer", "user")
SIGNUP_DATE = ("created_at", "signup_date", "registration_date", "start_date")
MODEL_TARGET = ("churn", "churned", "is_churn", "target", "label")
PAGE_TARGET = (
    "churn", "Churn", "CHURN", "Exited", "exited", "target", "Target", "label", "Label",
    "is_churn", "IsChurn", "customer_churn",
)
PAGE_ID = ("CustomerID", "customer_id", "id", "ID", "CustID", "cust_id")
NEVER_FEATURES = ("customer_id", "id", "name", "email")


class MissingRole(ValueError):
    """No column of the table can play the requested part."""


def first_match(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def pick(df: DataFrame, given: str | None, candidates: Sequence[str], part: str) -> str:
    """The caller's column if given, else the first known name, else an error."""
    if given is not None:
        if given not in df.columns:
            raise MissingRole(f"{part}: no column {given!r} in {df.columns}")
        return given
    found = first_match(df.columns, candidates)
    if found is None:
        raise MissingRole(f"{part}: expected one of {list(candidates)}, got {df.columns}")
    return found


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if f.dataType.typeName() == "string" and f.name not in skip
    ]


def two_valued_columns(df: DataFrame) -> DataFrame:
    """One row per column: its position and whether it has at most two distinct values.

    A column has at most two distinct non-null values exactly when no value differs from
    both its minimum and its maximum, so two plain aggregates decide it for every column at
    once; no distinct set is ever built.
    """
    ends = one_row(df.agg(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(df.columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(df.columns)],
    ))
    third = df.select(F.lit(1).alias("_one"), *[
        ((F.col(c) != ends[f"lo{i}"]) & (F.col(c) != ends[f"hi{i}"])).alias(f"third{i}")
        for i, c in enumerate(df.columns)
    ]).agg(F.count("*").alias("_rows"),
           *[F.coalesce(F.bool_or(f"third{i}"), F.lit(False)).alias(f"third{i}")
             for i in range(len(df.columns))])
    return third.select(F.explode(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"),
                 (~F.col(f"third{i}")).alias("two_valued"))
        for i, c in enumerate(df.columns)
    ])).alias("r")).select("r.*")


def last_two_valued_column(df: DataFrame) -> DataFrame:
    """The last column with at most two distinct values, as a one-row table."""
    return two_valued_columns(df).filter("two_valued").agg(
        F.max_by("column_name", "position").alias("target_column"))


def find_target(df: DataFrame) -> str | None:
    """The churn column: a known name, else the last column with at most two values."""
    return first_match(df.columns, PAGE_TARGET) or last_two_valued_column(df).first()[0]


def find_id(df: DataFrame) -> str | None:
    return first_match(df.columns, PAGE_ID)
