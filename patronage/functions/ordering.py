"""Global order on large tables: ranks and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import settle


def with_running(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column],
                 position: str | None = None) -> DataFrame:
    """Add running totals and/or a 0-based position over a total order.

    Rows are range partitioned by ``order`` (which must end in a unique key, so a value shared
    by a third of the rows still spreads), each range computes its own running totals, and the
    totals of the earlier ranges are added from a table with one row per range. The ranged rows
    are written out first: a range number must not change if a task is recomputed.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = {f"_t{i}": expr for i, expr in enumerate(totals.values())}
    per_range = ranged.groupBy("_range").agg(
        F.count("*").alias("_rows"), *[F.sum(e).alias(a) for a, e in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(a).over(earlier).alias(f"{a}_before") for a in sums])
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "_range")
    added: list[Column] = []
    for (name, expr), alias in zip(totals.items(), sums):
        running = F.sum(expr).over(upto)
        added.append((running + F.coalesce(F.col(f"{alias}_before"),
                                           F.lit(0))).alias(name))
    if position is not None:
        added.append((F.row_number().over(within) - 1 + F.col("_before"))
                     .cast("bigint").alias(position))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *added)
