"""Churn labels and the train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import binary_target, hash_fraction
from patronage.functions.stats import exact_quantiles, long_form, one_row, quantile_row

# Tiny positive number that keeps the min-max normalisation defined on constant columns.
EPSILON = 1e-8
# For each label source: whether a higher value means a higher churn risk.
LABEL_SOURCES = {
    "engagement_score": False,
    "purchase_frequency": False,
    "days_since_last_purchase": True,
}


def to_binary(df: DataFrame, target: str, as_name: str = "churn") -> DataFrame:
    """Add the target as 0/1."""
    kind = df.schema[target].dataType.typeName()
    return df.withColumn(as_name, binary_target(F.col(f"`{target}`"), kind))


def median_binarize(df: DataFrame, target: str, as_name: str = "churn",
                    approx: bool = False) -> DataFrame:
    """A numeric target with more than two values becomes 1 above its median; others > 0."""
    y = F.col(f"`{target}`").cast("double")
    ends = one_row(df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")))
    more = one_row(df.select(((y != ends["lo"]) & (y != ends["hi"])).alias("other"))
                   .agg(F.coalesce(F.bool_or("other"), F.lit(False)).alias("many")))["many"]
    median = one_row(quantile_row(df.select(y.alias("y")), ["y"], 0.5, approx))["y"]
    hit = F.when(more, y > median).otherwise(y > 0)
    return df.withColumn(as_name, F.coalesce(hit, F.lit(False)).cast("int"))


def synthetic_churn(df: DataFrame, as_name: str = "churn", quantile: float = 0.7,
                    approx: bool = False) -> DataFrame:
    """Label the customers with the weakest engagement.

    Every available source is min-max normalised so that 1 is the worst value; the score is
    their mean and the label is 1 from the given quantile of the score upwards. The input is
    read several times: settle it first when it is expensive to compute.
    """
    sources = [c for c in LABEL_SOURCES if c in df.columns]
    if not sources:
        raise ValueError(f"none of {list(LABEL_SOURCES)} in {df.columns}")
    ends = one_row(df.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in sources
                            for p, f in (("lo", F.min), ("hi", F.max))]))

    def part(c: str):
        x = ((F.col(c).cast("double") - ends[f"lo_{c}"])
             / (ends[f"hi_{c}"] - ends[f"lo_{c}"] + F.lit(EPSILON)))
        return x if LABEL_SOURCES[c] else F.lit(1.0) - x

    total = sum((part(c) for c in sources[1:]), part(sources[0]))
    scored = df.withColumn("churn_score", total / F.lit(float(len(sources))))
    cut = one_row(quantile_row(scored, ["churn_score"], quantile, approx))["churn_score"]
    return scored.withColumn(as_name, (F.col("churn_score") >= cut).cast("int"))


def split_by_hash(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``. No shuffle, stable per key, stratified in expectation."""
    return df.withColumn("is_test", hash_fraction(key, seed) < F.lit(test_size))


def split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test`` with the exact share per class (to within one row).

    The cut is the exact quantile of the row hashes within each class, so a class of any size
    is never sorted in one task.
    """
    hashed = df.withColumn("_h", hash_fraction(key, seed))
    cuts = exact_quantiles(hashed.select(label, "_h"), [label], [test_size], value="_h")
    # One row per class of a binary label.
    return (hashed.join(F.broadcast(cuts.select(label, "quantile")), label)
            .withColumn("is_test", F.col("_h") <= F.col("quantile"))
            .select(*df.columns, "is_test"))


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """(label, rows, weight) with weight = rows / (2 · rows of the class)."""
    n = one_row(df.agg(F.count(label).alias("n")))["n"]
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows")) \
        .withColumn("weight", n.cast("double") / (F.lit(2.0) * F.col("rows")))


def with_class_weight(df: DataFrame, label: str = "churn", name: str = "weight") -> DataFrame:
    """Balanced weights on every row, from one aggregate and without a join."""
    n = one_row(df.agg(F.count_if(F.col(label) == 1).alias("ones"),
                       F.count_if(F.col(label) == 0).alias("zeros")))
    own = F.when(F.col(label) == 1, n["ones"]).otherwise(n["zeros"])
    return df.withColumn(name, (n["ones"] + n["zeros"]).cast("double") / (F.lit(2.0) * own))
