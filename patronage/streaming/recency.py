"""Purchases per customer as a stream: running frequency and spend, and a note when one falls silent.

Each customer has one small state: purchases, money in cents, last purchase, and a timer in event
time; when the watermark passes the timer without another purchase, the customer is reported as
quiet. Customers are dealt by hash to a fixed number of buckets, and a batch advances the states of a
bucket at once, as columns: one call a bucket instead of one a customer. State, timers and positions
in the source are in the checkpoint, so a restarted stream goes on where it was; the number of
buckets must stay the same then. A bucket's rows of one batch are read piece by piece, so a customer
with very many purchases needs no more memory than another.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patronage.functions.numeric import minor_units

# The customers of a bucket in Arrow's stream format, by customer; a customer without a timer is quiet.
STATE = "customers binary"
NO_TIMER = (1 << 63) - 1
BUCKETS = 256


def _packed(customers: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(customers), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas()


def _gathered(known: pd.DataFrame | None, batches: Iterator[pd.DataFrame], key: str) -> pd.DataFrame:
    """Purchases, cents and the last purchase of the customers in the batches, by customer."""
    parts = [] if known is None else [known]
    for batch in batches:
        part = batch.groupby(key).agg(
            purchases=("cents", "size"), cents=("cents", "sum"), last_ms=("ms", "max"))
        parts = [pd.concat([*parts, part]).groupby(level=0).agg(
            {"purchases": "sum", "cents": "sum", "last_ms": "max"})]
    return parts[0]


def _advance(quiet_ms: int, key: str) -> Callable:
    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        figures = ["purchases", "cents", "last_ms"]
        now = state.getCurrentWatermarkMs()
        known = _unpacked(bytes(state.get[0])) if state.exists else None
        moved = None if state.hasTimedOut else _gathered(None, batches, key)
        shown = []
        if moved is None:
            after = known
        else:
            both = moved if known is None else pd.concat([known[figures], moved])
            after = both.groupby(level=0).agg(
                {"purchases": "sum", "cents": "sum", "last_ms": "max"})
            after["timer"] = NO_TIMER
            if known is not None:
                after.loc[known.index, "timer"] = known["timer"]
            after.loc[moved.index, "timer"] = (
                after.loc[moved.index, "last_ms"] + quiet_ms).clip(lower=now + 1)
            shown.append(after.loc[moved.index, figures].assign(event="purchase"))
        # Who bought something in this batch is not quiet yet.
        gone = after["timer"] < now
        if moved is not None:
            gone &= ~after.index.isin(moved.index)
        shown.append(after.loc[gone, figures].assign(event="quiet"))
        after.loc[gone, "timer"] = NO_TIMER
        state.update((_packed(after),))
        due = int(after["timer"].min())
        if due < NO_TIMER:
            state.setTimeoutTimestamp(due)
        out = pd.concat([x for x in shown if len(x)] or shown[:1]).rename_axis(key).reset_index()
        yield out.rename(columns={"purchases": "purchase_frequency"})[
            [key, "event", "purchase_frequency", "cents", "last_ms"]]
    return run


def customer_recency(transactions: DataFrame, quiet_after: str = "90 days", late: str = "30 days",
                     customer: str = "customer_id", amount: str = "amount",
                     date: str = "date", buckets: int = BUCKETS) -> DataFrame:
    """(customer, event, purchase_frequency, total_spent, last_purchase_date) of a stream.

    One row per customer and batch with the figures so far (``event`` "purchase"), and one when the
    event time has moved ``quiet_after`` past the last purchase ("quiet"). Rows that come more than
    ``late`` behind the newest date are left out, as are rows without a customer or date. A missing
    amount counts as a purchase of 0.
    """
    key_type = transactions.schema[customer].dataType.simpleString()
    quiet_ms = int(pd.Timedelta(quiet_after).total_seconds() * 1000)
    rows = (transactions.select(
        customer, F.col(date).cast("timestamp").alias("ts"),
        F.coalesce(minor_units(amount), F.lit(0)).cast("bigint").alias("cents"))
        .filter(F.col(customer).isNotNull() & F.col("ts").isNotNull())
        .withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(customer), F.lit(buckets)))
    moved = dealt.groupBy("_bucket").applyInPandasWithState(
        _advance(quiet_ms, customer),
        f"{customer} {key_type}, event string, purchase_frequency bigint, cents bigint, last_ms bigint",
        STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return moved.select(
        customer, "event", "purchase_frequency", (F.col("cents") / F.lit(100.0)).alias("total_spent"),
        F.timestamp_millis("last_ms").cast("timestamp_ntz").alias("last_purchase_date"))


def write_updates(updates: DataFrame, path: str, checkpoint: str):
    """Append the rows of every batch to Parquet, processing what is available and then stopping."""
    return (updates.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_customers(updates: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The latest figures of each customer from all written rows, and whether it is quiet now."""
    quiet = F.col("event") == "quiet"
    figures = F.struct("purchase_frequency", "total_spent", "last_purchase_date", quiet.alias("is_quiet"))
    return updates.groupBy(customer).agg(
        F.max_by(figures, F.struct("purchase_frequency", quiet)).alias("s")).select(customer, "s.*")
