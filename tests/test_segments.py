"""K-Means and segment profiles."""

import pytest
from pyspark.sql import functions as F

from patronage.operators import segments


@pytest.fixture(scope="module")
def clustered(spark):
    return spark.createDataFrame([
        (1, 0, 1.0, 10.0, -1.0), (2, 0, 3.0, 10.0, -1.0), (3, 1, 10.0, 40.0, 2.0),
        (4, 2, 2.0, 20.0, 0.0)],
        "customer_id bigint, cluster int, purchase_frequency double, total_spent double, "
        "engagement_score double")


def test_kmeans_numbers_segments_by_size(spark):
    df = spark.range(300).select(
        F.col("id").alias("k"),
        (F.when(F.col("id") < 200, 0.0).when(F.col("id") < 280, 50.0).otherwise(99.0)
         + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    sizes = segments.kmeans_segments(df, "k", ["x", "y"], k=3).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in sizes} == {0: 200, 1: 80, 2: 20}
    costs = [segments.fit_kmeans(df, ["x", "y"], k).stages[-1].summary.trainingCost for k in (2, 3)]
    assert costs == sorted(costs, reverse=True)
    model = segments.fit_kmeans(df, ["x", "y"], 3)
    assert segments.cluster_centers(model, df, ["x", "y"]).count() == 6


def test_distribution(clustered):
    rows = {r.cluster: r for r in segments.cluster_distribution(clustered).collect()}
    assert (rows[0].customers, rows[0].percentage, rows[0].largest, rows[0].smallest) == (2, 50.0, True, False)
    assert rows[1].smallest and rows[2].smallest


def test_stats_and_profiles(clustered):
    stats = {(r.cluster, r.feature): (r.mean_value, r["count"]) for r in segments.cluster_stats(
        clustered, ["purchase_frequency", "total_spent"]).collect()}
    assert stats[0, "purchase_frequency"] == (2.0, 2) and len(stats) == 6
    rows = segments.cluster_profiles(
        clustered, ["purchase_frequency", "total_spent", "engagement_score"], top=2).collect()
    first = {r.cluster: r for r in rows if r.profile_rank == 1}
    # The overall engagement is 0, so its difference is undefined and ranks last.
    assert (first[1].feature, first[1].diff_pct, first[1].characteristic) == (
        "purchase_frequency", 150.0, "above average")
    assert (first[2].feature, first[2].characteristic) == ("purchase_frequency", "below average")


def test_recommendations_and_opportunities(clustered):
    rows = segments.segment_recommendations(clustered).filter("cluster = 1").orderBy("position").collect()
    assert [r.recommendation.split(" - ")[0] for r in rows] == [
        "High-frequency buyers", "High-value customers", "Highly engaged"]
    bare = segments.segment_recommendations(clustered.select("customer_id", "cluster")).collect()
    assert {r.recommendation for r in bare} == {segments.GENERAL_RECOMMENDATION}
    got = {(r.opportunity, r.opportunity_rank): r.cluster
           for r in segments.cluster_opportunities(clustered).collect()}
    assert got == {("Focus retention efforts", 1): 1, ("Focus retention efforts", 2): 2,
                   ("Upsell opportunities", 1): 1, ("Upsell opportunities", 2): 0,
                   ("Re-engagement needed", 1): 0, ("Re-engagement needed", 2): 2}


def test_sample_is_limited_before_the_shuffle(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(
        F.col("id") < 4000, 0).otherwise(F.col("id") % 5).alias("cluster")).repartition(6)
    sample = segments.cluster_sample(df, "k", n=10)
    counts = {r.cluster: r["count"] for r in sample.groupBy("cluster").count().collect()}
    assert counts == {c: 10 for c in range(5)}
    assert sorted(r.k for r in sample.collect()) == sorted(
        r.k for r in segments.cluster_sample(df.coalesce(1), "k", n=10).collect())
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()


def test_exports(clustered):
    assert segments.export_summary(clustered, "customer_id").columns == [
        "customer_id", "cluster", "total_spent", "purchase_frequency", "engagement_score"]
    frame = segments.scatter_frame(clustered, "customer_id", "total_spent", "engagement_score")
    assert {r.type for r in frame.collect()} == {"Normal"}
