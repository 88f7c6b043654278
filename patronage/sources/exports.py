"""The report files: predictions, segments, trends, products and forecasts as CSV folders.

Each file set is written in parallel. Ordered reports are range partitioned, so reading the parts
in name order gives the order of the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import half_even
from patronage.sources.writers import write_csv


def export_predictions(predictions: DataFrame, path: str, key: str = "customer_id",
                       mode: str = "errorifexists") -> None:
    """All predictions, most endangered customers first."""
    ordered = predictions.select(key, "churn_prediction", "churn_probability").orderBy(
        F.desc("churn_probability"), key)
    write_csv(ordered, path, mode)


def export_segments(clustered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every column of the segmented customers."""
    write_csv(clustered, path, mode)


def export_segment_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(summary, path, mode)


def export_trend(trend: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Periods in order."""
    write_csv(trend.orderBy("period_start"), path, mode)


def export_products(performance: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Products by revenue."""
    write_csv(performance.orderBy(F.desc("total_revenue"), "product_id"), path, mode)


def export_forecast(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Date, forecast and bounds with two decimals, under their display names."""
    keys = [c for c in table.columns
            if c not in ("date", "forecast", "lower_bound", "upper_bound")]
    write_csv(table.orderBy(*keys, "date").select(
        *keys, F.col("date").alias("Date"), half_even(F.col("forecast")).alias("Forecast"),
        half_even(F.col("lower_bound")).alias("Lower Bound"),
        half_even(F.col("upper_bound")).alias("Upper Bound")), path, mode)
