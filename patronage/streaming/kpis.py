"""Tumbling-window revenue and activity on an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import money_sum


def windowed_kpis(events: DataFrame, ts: str = "ts", user: str = "user_id", value: str = "value",
                  width: str = "1 hour", late: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Revenue, events and active customers per window.

    On a stream the watermark bounds the state and late rows are dropped; distinct customers are
    estimated, because an exact distinct count is not available there. On a table the watermark
    has no effect and ``exact`` may be set.
    """
    users = F.count_distinct(user) if exact and not events.isStreaming else \
        F.approx_count_distinct(user)
    if events.isStreaming:
        # Watermarks need an instant, so zone-less times are read in the session's zone.
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (events.groupBy(F.window(ts, width).alias("_w"))
            .agg(money_sum(value).alias("revenue"), F.count("*").alias("events"),
                 users.alias("active_customers"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "revenue", "events", "active_customers"))


def write_windows(kpis: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet, processing what is available and then stopping."""
    return (kpis.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
