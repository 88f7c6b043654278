"""From raw tables to the scaled feature table, and its data-quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from patronage import roles
from patronage.operators.features import customer_rfm, with_engagement, with_tenure
from patronage.operators.prepare import impute_median, impute_mode, label_encode, standard_scale
from patronage.session import settle


def engineered(customers: DataFrame, transactions: DataFrame | None, as_of: str | None,
               key: str = "customer_id", signup: str | None = None) -> DataFrame:
    """Customers with purchase features, engagement and tenure, unscaled.

    The joined table is written once: later statistics and rows read a customer-sized table
    instead of aggregating the transactions again.
    """
    out = customers
    if transactions is not None:
        out = settle(customer_rfm(customers, transactions, as_of, key))
    return with_tenure(with_engagement(out), as_of, signup)


def processed_features(customers: DataFrame, transactions: DataFrame | None = None,
                       as_of: str | None = None, key: str = "customer_id",
                       target: str | None = None, signup: str | None = None,
                       drop: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Key, scaled features and (unscaled) target, one row per customer.

    Impute, engineer, encode, scale. Identifier columns never become features; date columns
    feed the tenure and are then left out; the target is neither imputed nor scaled.
    """
    never = {*roles.NEVER_FEATURES, key, *drop}
    kept_out = [*never, *([target] if target else [])]
    raw = customers.drop(*[c for c in never if c != key and c in customers.columns])
    texts = [c for c in roles.string_columns(raw, kept_out)
             if c not in roles.SIGNUP_DATE and c != signup]
    filled = impute_mode(impute_median(raw, exclude=kept_out, approx=approx), texts)
    full = engineered(filled, transactions, as_of, key, signup)
    encoded = label_encode(full, texts)
    features = roles.numeric_columns(encoded, kept_out)
    tail = [target] if target else []
    # Written before scaling: the means and deviations are one pass over a plain table.
    return standard_scale(settle(encoded.select(key, *features, *tail)), features)
