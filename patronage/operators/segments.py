"""Customer segments: K-Means, and profiles of any given clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.numeric import (
    anomaly_label, average_label, guarded_ratio, half_even, hash_fraction)
from patronage.functions.stats import one_row, quantile_row


def fit_kmeans(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42,
               max_iter: int = 300) -> PipelineModel:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        KMeans(featuresCol="features", k=k, seed=seed, maxIter=max_iter),
    ]).fit(df)


def kmeans_segments(df: DataFrame, key: str, features: Sequence[str], k: int = 4,
                    seed: int = 42, model: PipelineModel | None = None) -> DataFrame:
    """Every customer with its segment; segments are numbered by size, largest first."""
    model = model or fit_kmeans(df, features, k, seed)
    raw = model.transform(df).select(key, *features, F.col("prediction").alias("_raw"))
    sizes = raw.groupBy("_raw").agg(F.count("*").alias("_n"))
    numbered = sizes.select("_raw", (F.row_number().over(
        Window.orderBy(F.desc("_n"), "_raw")) - 1).alias("cluster"))
    # One row per segment, at most k.
    return raw.join(F.broadcast(numbered), "_raw").select(key, *features, "cluster")


def cluster_centers(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(raw_cluster, feature, value): k rows per feature of the model."""
    rows = [(i, f, float(v)) for i, c in enumerate(model.stages[-1].clusterCenters())
            for f, v in zip(features, c)]
    return df.sparkSession.createDataFrame(rows, "raw_cluster int, feature string, value double")


def cluster_distribution(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size and share in percent (one decimal) per cluster, with the extreme sizes marked."""
    sizes = clustered.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("customers"))
    over = one_row(sizes.agg(F.sum("customers").alias("n"), F.max("customers").alias("hi"),
                             F.min("customers").alias("lo")))
    return sizes.select(
        "cluster", "customers",
        half_even(guarded_ratio(F.col("customers"), over["n"]) * 100, 1).alias("percentage"),
        (F.col("customers") == over["hi"]).alias("largest"),
        (F.col("customers") == over["lo"]).alias("smallest"))


def _means(clustered: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, size, feature, mean_value, count): aggregated wide, then turned long."""
    wide = clustered.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("size"),
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(features)])
    return wide.select("cluster", "size", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                 F.col(f"m{i}").alias("mean_value"), F.col(f"n{i}").alias("count"))
        for i, c in enumerate(features)])).alias("f")).select("cluster", "size", "f.*")


def cluster_stats(clustered: DataFrame, features: Sequence[str],
                  cluster: str = "cluster") -> DataFrame:
    """Mean (two decimals) and count per cluster and feature."""
    return _means(clustered, features, cluster).select(
        "cluster", "feature", half_even(F.col("mean_value")).alias("mean_value"), "count")


def cluster_profiles(clustered: DataFrame, features: Sequence[str], cluster: str = "cluster",
                     top: int = 5) -> DataFrame:
    """The ``top`` features per cluster that differ most from the overall mean."""
    overall = one_row(clustered.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)]))
    base = F.element_at(F.array(*[overall[f"m{i}"] for i in range(len(features))]),
                        F.col("position") + 1)
    diff = F.try_divide(F.col("mean_value") - base, base) * 100
    strongest = Window.partitionBy("cluster").orderBy(
        F.abs("diff_pct").desc_nulls_last(), "position")
    return (_means(clustered, features, cluster)
            .withColumn("diff_pct", diff)
            .withColumn("profile_rank", F.row_number().over(strongest).cast("bigint"))
            .filter(F.col("profile_rank") <= top)
            .select("cluster", "size",
                    (guarded_ratio(F.col("size"), overall["n"]) * 100).alias("percentage"),
                    "profile_rank", "feature", "mean_value", "diff_pct",
                    average_label(F.col("diff_pct")).alias("characteristic")))


# Advice per feature, when the cluster mean is above the overall median or not.
RECOMMENDATIONS = {
    "purchase_frequency": (
        "High-frequency buyers - Focus on loyalty programs",
        "Low-frequency buyers - Use re-engagement campaigns",
    ),
    "total_spent": (
        "High-value customers - Offer premium services",
        "Price-sensitive customers - Provide discounts",
    ),
    "engagement_score": (
        "Highly engaged - Perfect for new product launches",
        "Low engagement - Focus on improving experience",
    ),
}
GENERAL_RECOMMENDATION = "Develop targeted marketing based on cluster characteristics"


def segment_recommendations(clustered: DataFrame, cluster: str = "cluster",
                            approx: bool = False) -> DataFrame:
    """(cluster, customers, position, recommendation) from cluster means vs overall medians."""
    used = [c for c in RECOMMENDATIONS if c in clustered.columns]
    sized = clustered.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("customers"),
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in used])
    if not used:
        return sized.select("cluster", "customers", F.lit(1).cast("bigint").alias("position"),
                            F.lit(GENERAL_RECOMMENDATION).alias("recommendation"))
    medians = one_row(quantile_row(clustered, used, 0.5, approx))
    texts = F.array(*[
        F.when(F.col(f"m_{c}") > medians[c], RECOMMENDATIONS[c][0]).otherwise(
            RECOMMENDATIONS[c][1]) for c in used])
    return sized.select("cluster", "customers", F.posexplode(texts).alias("_p", "recommendation")) \
        .select("cluster", "customers", (F.col("_p") + 1).cast("bigint").alias("position"),
                "recommendation")


# For each cross-segment question: the feature, and whether the highest means are wanted.
OPPORTUNITIES = {
    "Focus retention efforts": ("total_spent", True),
    "Upsell opportunities": ("purchase_frequency", True),
    "Re-engagement needed": ("engagement_score", False),
}


def cluster_opportunities(clustered: DataFrame, cluster: str = "cluster", n: int = 2) -> DataFrame:
    """The two clusters with the highest (or lowest) mean per cross-segment question."""
    used = {o: f for o, f in OPPORTUNITIES.items() if f[0] in clustered.columns}
    means = clustered.groupBy(F.col(cluster).alias("cluster")).agg(*[
        F.avg(F.col(c).cast("double")).alias(c) for c, _ in used.values()])
    long = means.select("cluster", F.explode(F.array(*[
        F.struct(F.lit(o).alias("opportunity"), F.col(c).alias("mean_value"),
                 (-F.col(c) if high else F.col(c)).alias("_sort"))
        for o, (c, high) in used.items()])).alias("o")).select("cluster", "o.*")
    best = Window.partitionBy("opportunity").orderBy("_sort", "cluster")
    return (long.withColumn("opportunity_rank", F.row_number().over(best).cast("bigint"))
            .filter(F.col("opportunity_rank") <= n)
            .select("opportunity", "opportunity_rank", "cluster", "mean_value"))


def cluster_sample(clustered: DataFrame, key: str, cluster: str = "cluster", n: int = 10,
                   seed: int = 42) -> DataFrame:
    """Up to n random rows per cluster, the same for the same seed.

    The rank filter is applied inside each task before the shuffle, so a cluster of any size
    sends at most n rows per task.
    """
    order = Window.partitionBy(cluster).orderBy(hash_fraction(key, seed), key)
    return (clustered.withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") <= n).drop("_rank"))


def anomaly_summary(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Customers, anomalies, clusters and the anomaly rate in percent."""
    c = F.col(cluster)
    return clustered.groupBy(c.alias("_c")).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("total_customers"),
        F.coalesce(F.sum(F.when(F.col("_c") == -1, F.col("_n"))), F.lit(0)).alias("n_outliers"),
        F.count_if(F.col("_c") != -1).alias("n_clusters")).withColumn(
        "outlier_percentage", F.coalesce(guarded_ratio(
            F.col("n_outliers"), F.col("total_customers")) * 100, F.lit(0.0)))


def outlier_characteristics(clustered: DataFrame, features: Sequence[str],
                            cluster: str = "cluster", first: int = 5,
                            at_least: float = 10.0) -> DataFrame:
    """How the outliers' means differ from the normal ones, where by more than 10 %."""
    shown = list(features)[:first]
    out = F.col(cluster) == -1

    def mean(c: str, which):
        return F.avg(F.when(which, F.col(f"`{c}`").cast("double")))

    wide = clustered.agg(*[mean(c, out).alias(f"o{i}") for i, c in enumerate(shown)],
                         *[mean(c, ~out).alias(f"n{i}") for i, c in enumerate(shown)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"o{i}").alias("outlier_mean"),
                 F.col(f"n{i}").alias("normal_mean"),
                 F.coalesce(F.try_divide(F.col(f"o{i}") - F.col(f"n{i}"), F.col(f"n{i}")) * 100,
                            F.lit(0.0)).alias("diff_pct"))
        for i, c in enumerate(shown)])).alias("r")).select("r.*").filter(
        F.abs("diff_pct") > at_least)


def outlier_sample(clustered: DataFrame, key: str, cluster: str = "cluster",
                   n: int = 5) -> DataFrame:
    return clustered.filter(F.col(cluster) == -1).orderBy(key).limit(n)


def scatter_frame(clustered: DataFrame, key: str, x: str, y: str,
                  cluster: str = "cluster") -> DataFrame:
    """Two features with the cluster and the anomaly label, ready to be drawn."""
    return clustered.select(key, x, y, F.col(cluster).alias("cluster"),
                            anomaly_label(F.col(cluster)).alias("type"))


def export_summary(clustered: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Key and cluster, with spend, frequency and engagement where present."""
    kept = [c for c in ("total_spent", "purchase_frequency", "engagement_score")
            if c in clustered.columns]
    return clustered.select(key, F.col(cluster).alias("cluster"), *kept)
