"""Statistics that feed back into row-level plans.

Two rules hold throughout: one-row results enter other plans as scalar subqueries (never as a
join without keys, never through driver-side literals), and no aggregate keeps an unbounded
set of values in one buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row(aggregated: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery."""
    return aggregated.select(F.struct("*").alias("s")).scalar()


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
              name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: one row per (keys, column), values as double, nulls kept."""
    return (df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
            .unpivot(list(keys), list(columns), name, value))


# Relative rank error of the quantile sketch is 1 / SKETCH_ACCURACY. The first bracket reaches
# BRACKET of the rows to either side of the wanted rank (five times that error); the second cuts
# what is left into CUTS parts and keeps three. Groups up to SMALL_GROUP rows skip both.
SKETCH_ACCURACY = 20_000
BRACKET = 2.5e-4
CUTS = 200
SMALL_GROUP = 100_000


def exact_quantiles(long: DataFrame, keys: Sequence[str], probabilities: Sequence[float],
                    value: str = "value") -> DataFrame:
    """Exact linear-interpolation quantiles per key: (keys, probability, quantile).

    ``keys`` must have few distinct combinations (features, not customers). Two passes with a
    mergeable sketch of bounded rank error bracket the wanted rank, first to about 0.05 % of the
    rows, then to under 0.001 %; the last pass counts what lies below the bracket and orders only
    the distinct values inside. Rows are never shuffled by value, repeated values collapse before
    the ordering step, and the answer is exact because a bracket always contains both
    neighbouring ranks.
    """
    keys = list(keys)
    group = [*keys, "probability"]
    clean = (long.select(*keys, F.col(value).cast("double").alias("_v"))
             .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    v = F.col("_v")

    # First pass: a sketch per key, read at both ends of every bracket.
    lows = [max(p - BRACKET, 0.0) for p in probabilities]
    highs = [min(p + BRACKET, 1.0) for p in probabilities]
    sketch = clean.groupBy(*keys).agg(
        F.min(v).alias("_min"), F.max(v).alias("_max"), F.count("*").alias("_n"),
        F.percentile_approx(v, lows + highs, SKETCH_ACCURACY).alias("_q"))
    small = F.col("_n") <= SMALL_GROUP
    m = len(probabilities)
    first = sketch.select(*keys, F.explode(F.array(*[
        F.struct(
            F.lit(float(p)).alias("probability"),
            ((F.col("_n") - 1) * F.lit(float(p))).alias("_pos"),
            (F.when(small, F.col("_min")).otherwise(F.col("_q")[i]) if lows[i] > 0
             else F.col("_min")).alias("_lo"),
            (F.when(small, F.col("_max")).otherwise(F.col("_q")[m + i]) if highs[i] < 1
             else F.col("_max")).alias("_hi"))
        for i, p in enumerate(probabilities)])).alias("_w")).select(*keys, "_w.*")

    def near(brackets: DataFrame) -> DataFrame:
        # Bracket rows number keys x probabilities, so they are safe to broadcast.
        return clean.join(F.broadcast(brackets), keys).filter(v <= F.col("_hi"))

    # Second pass: what lies below, and a sketch of what lies inside, read at regular cuts.
    inside = F.when(v >= F.col("_lo"), v)
    grid = F.percentile_approx(inside, [i / CUTS for i in range(CUTS + 1)], SKETCH_ACCURACY)
    second = near(first).groupBy(*group, "_pos", "_lo", "_hi").agg(
        F.count_if(v < F.col("_lo")).alias("_below"), F.count(inside).alias("_n"),
        grid.alias("_q"))
    cut = F.floor((F.col("_pos") - F.col("_below")) / F.col("_n") * CUTS).cast("int")
    final = second.select(
        *group, "_pos",
        F.when(small | (cut < 1), F.col("_lo")).otherwise(F.get("_q", cut - 1)).alias("_lo"),
        F.when(small | (cut + 2 > CUTS), F.col("_hi")).otherwise(F.get("_q", cut + 2)).alias("_hi"))

    # Last pass: counts by value; the null value stands for everything below and sorts first.
    counted = near(final).groupBy(*group, "_pos", inside.alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*group).orderBy(v.asc_nulls_first())
    ranked = (counted.withColumn("_upto", F.sum("_c").over(order))
              .withColumn("_from", F.col("_upto") - F.col("_c")))
    low_rank, high_rank = F.floor("_pos"), F.ceil("_pos")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), v))

    fraction = F.max(F.col("_pos") - low_rank)
    return ranked.groupBy(*group).agg(
        (at(low_rank) + (at(high_rank) - at(low_rank)) * fraction).alias("quantile"))


def exact_quantile_row(df: DataFrame, columns: Sequence[str], probability: float) -> DataFrame:
    """One row with one exact quantile per column; null for a column without values."""
    found = exact_quantiles(long_form(df, [], columns), ["feature"], [probability])
    return found.agg(*[
        F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in columns])


def approx_quantile_row(df: DataFrame, columns: Sequence[str], probability: float) -> DataFrame:
    return df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), probability, SKETCH_ACCURACY).alias(c)
        for c in columns])


def quantile_row(df: DataFrame, columns: Sequence[str], probability: float,
                 approx: bool = False) -> DataFrame:
    return (approx_quantile_row if approx else exact_quantile_row)(df, columns, probability)


def most_frequent_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value per text column; ties take the smallest.

    Counts per (column, value) are partially aggregated before the shuffle, so a value that
    fills a third of the rows costs one row per task.
    """
    counts = (df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
              .unpivot([], list(columns), "feature", "value")
              .filter(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count("*").alias("n")))
    return counts.agg(*[
        F.min_by(F.when(F.col("feature") == c, F.col("value")),
                 F.when(F.col("feature") == c, F.struct((-F.col("n")).alias("n"),
                                                        F.col("value").alias("v")))).alias(c)
        for c in columns])


def equal_width_histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """(feature, bin, lower, upper, n) per column over equal-width bins; empty bins count 0.

    One pass finds the ranges of all columns, one more counts; bins are aggregated before the
    shuffle.
    """
    span = one_row(df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{p}{i}")
                            for i, c in enumerate(columns) for p, f in (("lo", F.min), ("hi", F.max))]))

    def edges(i: int) -> list[Column]:
        lo, hi = span[f"lo{i}"], span[f"hi{i}"]
        return [lo.alias("lo"), ((hi - lo) / F.lit(float(bins))).alias("width")]

    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v"), *edges(i))
        for i, c in enumerate(columns)])).alias("e")).select("e.*").filter(F.col("v").isNotNull())
    raw = F.when(F.col("width") > 0, F.floor((F.col("v") - F.col("lo")) / F.col("width"))) \
        .otherwise(F.lit(0))
    counts = values.groupBy("feature", F.least(raw, F.lit(bins - 1)).cast("bigint").alias("bin")) \
        .agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *edges(i)) for i, c in enumerate(columns)])).alias("e")) \
        .select("bin", "e.*")
    return spine.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n) of one column."""
    return equal_width_histograms(df, [column], bins).drop("feature")
