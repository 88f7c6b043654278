"""Why a model says what it says: per customer and overall."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.numeric import effect_label
from patronage.functions.stats import one_row


def _top_k(df: DataFrame, key: str, entries: list[Column], k: int) -> DataFrame:
    """Rank each row's own entries by their leading sort fields; no shuffle is involved."""
    best = F.slice(F.array_sort(F.array(*entries)), 1, k)
    return df.select(key, F.posexplode(best).alias("_p", "_e")).select(
        key, (F.col("_p") + 1).cast("bigint").alias("reason_rank"), "_e.*").drop("_sort", "_i")


def local_reasons_linear(df: DataFrame, key: str, weights: Mapping[str, float],
                         k: int = 10) -> DataFrame:
    """The k features with the largest |value · coefficient| for every customer."""
    entries = []
    for i, (feature, w) in enumerate(weights.items()):
        v = F.col(f"`{feature}`").cast("double")
        impact = v * F.lit(float(w))
        entries.append(F.struct(
            (-F.abs(impact)).alias("_sort"), F.lit(i).alias("_i"),
            F.lit(feature).alias("feature"), v.alias("value"),
            F.lit(float(w)).alias("coef"), impact.alias("impact"),
            effect_label(impact).alias("effect")))
    return _top_k(df, key, entries, k)


def local_reasons_tree(df: DataFrame, key: str, weights: Mapping[str, float],
                       k: int = 10) -> DataFrame:
    """The k features with the largest |value| · importance for every customer."""
    entries = []
    for i, (feature, w) in enumerate(weights.items()):
        v = F.col(f"`{feature}`").cast("double")
        points = F.abs(v) * F.lit(float(w))
        entries.append(F.struct(
            (-points).alias("_sort"), F.lit(i).alias("_i"), F.lit(feature).alias("feature"),
            v.alias("value"), F.lit(float(w)).alias("importance_weight"),
            points.alias("reason_score")))
    return _top_k(df, key, entries, k)


def permutation_importance(model: PipelineModel, test: DataFrame, key: str,
                           features: Sequence[str], label: str = "churn", repeats: int = 5,
                           seed: int = 42, bucket_rows: int = 10_000) -> DataFrame:
    """Mean drop in accuracy when one feature's values are exchanged between customers.

    Customers fall into hash buckets of about ``bucket_rows`` (the bucket count grows with the
    data) and get a random position there. Each repeat pairs a position with another one at a
    random distance around the bucket, which is a permutation, so one keyed join per repeat
    supplies the exchanged values of all features; there is no global shuffle or sort.
    """
    buckets = max(1, -(-test.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))
    within = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)
    size = F.count("*").over(Window.partitionBy("_bucket"))
    placed = (test.select(key, label, *features).withColumn("_bucket", bucket)
              .withColumn("_pos", F.row_number().over(within) - 1)
              .withColumn("_size", size))
    rng = random.Random(seed)
    turns = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(rng.random()).alias("turn"))
                      for r in range(repeats)])
    # A distance from 1 to size - 1; a bucket of one row can only meet itself.
    distance = F.when(F.col("_size") > 1, 1 + F.floor(
        F.col("_t.turn") * (F.col("_size") - 1)).cast("int")).otherwise(F.lit(0))
    asked = (placed.withColumn("_t", F.explode(turns))
             .withColumn("repeat", F.col("_t.repeat"))
             .withColumn("_from", F.pmod(F.col("_pos") + distance, F.col("_size"))))
    donors = placed.select("_bucket", F.col("_pos").alias("_from"), *[
        F.col(f"`{c}`").alias(f"_other{i}") for i, c in enumerate(features)])
    swapped = (asked.join(donors, ["_bucket", "_from"])
               .withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
               .select("repeat", "_f", label, *[
                   F.when(F.col("_f") == i, F.col(f"_other{i}")).otherwise(F.col(f"`{c}`"))
                   .alias(c) for i, c in enumerate(features)]))
    # Whole numbers of hits, so that a feature without influence has exactly 0.
    right = F.col("prediction") == F.col(label)
    hits, rows = F.sum(right.cast("bigint")).alias("hits"), F.count(right).alias("rows")
    base = one_row(model.transform(test).agg(hits, rows))
    names = F.array(*[F.lit(c) for c in features])
    lost = base["hits"] * F.col("rows") - F.col("hits") * base["rows"]
    return (model.transform(swapped).groupBy("_f").agg(hits, rows)
            .select(F.element_at(names, F.col("_f") + 1).alias("feature"),
                    (lost / (base["rows"] * F.col("rows"))).alias("importance")))
