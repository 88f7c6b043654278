"""Every analysis as a named query over the star-schema tables.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``patronage.plans.oracles`` holds the
matching SQL where the result can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage import roles
from patronage.functions.calendar import parsed_timestamp, period_start
from patronage.functions.numeric import half_even
from patronage.functions.stats import equal_width_histogram, one_row
from patronage.operators import (
    boosting, changepoints, customers as customer_ops, explain, features, forecast, labels, metrics,
    models, prepare, products as product_ops, profile, risk, sales, segments, sketches)
from patronage.operators.dbscan import dbscan
from patronage.plans import churn_run, testdata as td
from patronage.plans.feature_table import engineered, processed_features
from patronage.session import fresh_path, settle
from patronage.sources.buckets import write_bucketed
from patronage.sources.checked import read_checked
from patronage.streaming import recency
from patronage.streaming.kpis import windowed_kpis

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _digits(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Fixed decimals for values whose last bits depend on summation order."""
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def _six(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, for rates and scaled values."""
    return _digits(df, 6, *columns)


BEHAVIOUR = ["purchase_frequency", "total_spent", "avg_transaction_value",
             "days_since_last_purchase"]
RFM3 = ["purchase_frequency", "total_spent", "days_since_last_purchase"]
# Stated coefficients and importances, so that explanations have a checkable result.
LINEAR_WEIGHTS = {"purchase_frequency": -0.25, "total_spent": -0.000001,
                  "avg_transaction_value": 0.00001, "days_since_last_purchase": 0.01}
TREE_WEIGHTS = {"purchase_frequency": 0.375, "total_spent": 0.000001,
                "avg_transaction_value": 0.00002, "days_since_last_purchase": 0.125}


def _rfm(spark: SparkSession, d: str) -> DataFrame:
    return features.customer_rfm(td.customers(spark, d), td.transactions(spark, d), td.AS_OF)


def _rule_probability() -> Column:
    """A stated churn score from recency: 0 at 153 days or less, 1 from 1153 days on."""
    return F.least(F.greatest((F.col("days_since_last_purchase") - 153) / F.lit(1000.0),
                              F.lit(0.0)), F.lit(1.0))


def _rule_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = _rfm(spark, d).select("customer_id", _rule_probability().alias("churn_probability"))
    return p.withColumn("churn_prediction", (F.col("churn_probability") > 0.5).cast("int"))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their behaviour, the nation standing for a given cluster."""
    full = engineered(td.customers(spark, d), td.transactions(spark, d), td.AS_OF)
    return full.select("customer_id", F.col("nation").alias("cluster"), *BEHAVIOUR,
                       "engagement_score")


# --- sources and profiling -------------------------------------------------------------------

@query
def scan_customers(spark, d):
    return td.customers(spark, d)


@query
def scan_transactions_dates(spark, d):
    raw = td.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "P", "not a date")
        .otherwise(F.col("o_orderdate").cast("string")).alias("date"))
    return raw.withColumn("date", parsed_timestamp(F.col("date")))


@query
def scan_products(spark, d):
    return td.products(spark, d)


@query
def preview(spark, d):
    return profile.preview(td.customers(spark, d), "customer_id")


@query
def table_summary(spark, d):
    return profile.table_summary({
        "customers": td.customers_with_gaps(spark, d),
        "transactions": td.transactions(spark, d), "products": td.products(spark, d)})


@query
def dtype_histogram(spark, d):
    return profile.dtype_counts({
        "customers": td.customers(spark, d), "transactions": td.transactions(spark, d),
        "products": td.products(spark, d)})


@query
def missing_by_column(spark, d):
    return profile.missing_by_column(td.customers_with_gaps(spark, d))


@query
def completeness(spark, d):
    return profile.completeness(td.customers_with_gaps(spark, d))


@query
def describe_features(spark, d):
    rfm = settle(_rfm(spark, d).select("balance", *BEHAVIOUR))
    return _digits(profile.describe_features(rfm), 4, "mean", "std", "p25", "p50", "p75")


@query
def find_target_column(spark, d):
    return roles.last_two_valued_column(td.table(spark, d, "labels"))


@query
def safe_numeric(spark, d):
    dirty = td.customers(spark, d).withColumns({
        "nation": F.when(F.col("nation") > 0, F.col("nation")),
        "balance": F.when(F.col("balance") < 0, F.lit(float("nan")))
        .when(F.col("balance") > 9000, F.lit(float("inf"))).otherwise(F.col("balance"))})
    return prepare.safe_numeric(dirty, "customer_id")


@query
def customer_lookup(spark, d):
    return profile.lookup(td.customers(spark, d), "customer_id", " 77 ")


@query
def customer_profile(spark, d):
    return profile.attribute_rows(
        td.customers(spark, d).drop("balance"), "customer_id", "77")


# --- sales -----------------------------------------------------------------------------------

@query
def overview_kpis(spark, d):
    churned = td.customers(spark, d).withColumn("churn", (F.col("balance") < 0).cast("int"))
    return _six(sales.overview_kpis(churned, td.transactions(spark, d)), "churn_rate")


@query
def sales_kpis(spark, d):
    return sales.sales_kpis(td.transactions(spark, d))


def _trend(period: str) -> Query:
    return lambda spark, d: sales.sales_trend(td.transactions(spark, d), period)


for _name, _period in (("daily", "day"), ("monthly", "month"), ("quarterly", "quarter"),
                       ("yearly", "year")):
    QUERIES[f"sales_trend_{_name}"] = _trend(_period)


@query
def sales_growth_monthly(spark, d):
    return sales.sales_growth(sales.sales_trend(td.transactions(spark, d), "month"))


@query
def growth_summary(spark, d):
    return _six(sales.growth_summary(sales_growth_monthly(spark, d)),
                "avg_revenue_growth", "avg_transaction_growth")


def _products(spark, d):
    return product_ops.product_performance(td.sales_lines(spark, d))


@query
def product_performance(spark, d):
    return _products(spark, d)


@query
def top_products_revenue(spark, d):
    return product_ops.top_by_revenue(_products(spark, d))


@query
def top_products_volume(spark, d):
    return product_ops.top_by_volume(_products(spark, d))


@query
def product_summary_top20(spark, d):
    return product_ops.product_summary(_products(spark, d))


@query
def product_pareto(spark, d):
    return product_ops.pareto(_products(spark, d))


@query
def product_pareto_rounded(spark, d):
    return product_ops.pareto(_products(spark, d), rounded=True)


@query
def pareto_summary(spark, d):
    return product_ops.pareto_summary(product_pareto(spark, d))


def _customer_value(spark, d):
    return customer_ops.customer_performance(td.transactions(spark, d))


@query
def customer_performance(spark, d):
    return _customer_value(spark, d)


@query
def customer_value_kpis(spark, d):
    return customer_ops.customer_value_kpis(_customer_value(spark, d))


@query
def top_customers(spark, d):
    return customer_ops.top_customers(_customer_value(spark, d))


@query
def hist_total_spent(spark, d):
    return equal_width_histogram(_customer_value(spark, d), "total_spent", 50)


@query
def hist_transactions(spark, d):
    return equal_width_histogram(_customer_value(spark, d), "total_transactions", 30)


@query
def hist_probability(spark, d):
    return equal_width_histogram(_rule_predictions(spark, d), "churn_probability", 50)


@query
def customer_value_histograms(spark, d):
    return customer_ops.value_histograms(settle(_rfm(spark, d).select(*customer_ops.VALUE_COLUMNS)))


# --- features --------------------------------------------------------------------------------

@query
def customer_rfm(spark, d):
    return _rfm(spark, d).select("customer_id", "last_purchase_date", *BEHAVIOUR)


@query
def customer_recency(spark, d):
    from patronage.functions.numeric import recency_score
    return _rfm(spark, d).select(
        "customer_id", "days_since_last_purchase",
        recency_score(F.col("days_since_last_purchase")).alias("recency_score"))


@query
def engagement_score(spark, d):
    made = ["purchase_frequency_normalized", "total_spent_normalized",
            "recency_score_normalized", "engagement_score"]
    full = engineered(td.customers(spark, d), td.transactions(spark, d), td.AS_OF)
    return _six(full.select("customer_id", *made), *made)


@query
def subscription_tenure(spark, d):
    started = features.first_purchase(td.transactions(spark, d), "customer_id", "date")
    dated = td.customers(spark, d).join(started, "customer_id", "left")
    return features.with_tenure(dated, td.AS_OF).select(
        "customer_id", "start_date", "subscription_tenure_days")


@query
def impute_median(spark, d):
    gaps = td.customers_with_gaps(spark, d).select("customer_id", "nation", "balance")
    return prepare.impute_median(gaps, exclude=["customer_id"])


@query
def impute_mode(spark, d):
    gaps = td.customers_with_gaps(spark, d).select("customer_id", "segment")
    return prepare.impute_mode(gaps)


@query
def label_encode(spark, d):
    texts = td.customers(spark, d).select("customer_id", "segment", "name")
    return prepare.label_encode(texts, ["segment", "name"])


@query
def standard_scale(spark, d):
    rfm = settle(_rfm(spark, d).select("customer_id", *BEHAVIOUR))
    return _six(prepare.standard_scale(rfm, BEHAVIOUR), *BEHAVIOUR)


def _processed(spark, d):
    out = processed_features(td.customers_with_gaps(spark, d), td.transactions(spark, d), td.AS_OF)
    return _six(out, *[c for c in out.columns if c != "customer_id"])


QUERIES["processed_features"] = _processed


# --- labels, metrics, risk -------------------------------------------------------------------

@query
def binary_target(spark, d):
    base = td.customers(spark, d).select(
        "customer_id", "balance", (F.col("balance") < 0).alias("in_debt"),
        F.when(F.col("segment") == "BUILDING", " Yes ").when(
            F.col("segment") == "MACHINERY", "exited").when(
            F.col("segment") == "FURNITURE", "no").otherwise(
            F.col("nation").cast("string")).alias("answer"))
    for source, name in (("balance", "from_number"), ("in_debt", "from_flag"),
                         ("answer", "from_text")):
        base = labels.to_binary(base, source, name)
    return base.select("customer_id", "from_number", "from_flag", "from_text")


@query
def median_binarize(spark, d):
    return labels.median_binarize(td.customers(spark, d).select("customer_id", "balance"), "balance")


@query
def synthetic_churn(spark, d):
    full = settle(engineered(td.customers(spark, d), td.transactions(spark, d), td.AS_OF).select(
        "customer_id", "engagement_score", "purchase_frequency", "days_since_last_purchase"))
    return _six(labels.synthetic_churn(full).select("customer_id", "churn_score", "churn"),
                "churn_score")


@query
def train_test_split(spark, d):
    return labels.split_stratified(
        td.table(spark, d, "labels"), "doc_id", "toxic", 0.2).select(
        "doc_id", "toxic", "is_test")


@query
def train_test_split_hashed(spark, d):
    return labels.split_by_hash(td.customers(spark, d), "customer_id", 0.2).select(
        "customer_id", "is_test")


@query
def class_weights(spark, d):
    return labels.class_weights(td.table(spark, d, "labels"), "toxic")


def _matrix(spark, d):
    return metrics.confusion_matrix(td.table(spark, d, "labels"), "quality", "toxic")


@query
def confusion_matrix(spark, d):
    return _matrix(spark, d)


@query
def metrics_weighted(spark, d):
    return _six(metrics.metrics_weighted(_matrix(spark, d)),
                "accuracy", "precision", "recall", "f1")


@query
def metrics_binary(spark, d):
    return metrics.metrics_binary(_matrix(spark, d))


@query
def churn_distribution(spark, d):
    return risk.churn_distribution(_rule_predictions(spark, d))


@query
def risk_bucket(spark, d):
    return risk.with_risk(_rule_predictions(spark, d)).select(
        "customer_id", "churn_probability", "risk")


@query
def risk_segments(spark, d):
    return risk.risk_segment_counts(_rule_predictions(spark, d))


@query
def retention_actions(spark, d):
    return risk.retention_actions(risk.with_risk(_rule_predictions(spark, d)), "customer_id")


@query
def revenue_at_risk(spark, d):
    return risk.revenue_at_risk(_rule_predictions(spark, d), _customer_value(spark, d))


@query
def revenue_vs_churn(spark, d):
    return risk.revenue_and_churn(_rule_predictions(spark, d), _customer_value(spark, d))


@query
def top_risk(spark, d):
    return risk.top_risk(_rule_predictions(spark, d))


@query
def local_reasons_linear(spark, d):
    return explain.local_reasons_linear(_rfm(spark, d), "customer_id", LINEAR_WEIGHTS, k=3)


@query
def local_reasons_tree(spark, d):
    return explain.local_reasons_tree(_rfm(spark, d), "customer_id", TREE_WEIGHTS, k=3)


# --- models ----------------------------------------------------------------------------------

def _prepared(spark, d):
    table = processed_features(td.customers(spark, d), td.transactions(spark, d), td.AS_OF)
    return churn_run.prepare(settle(table))


def _scored(kind: str, **options) -> Query:
    def run(spark, d):
        table, names = _prepared(spark, d)
        return churn_run.train(table, names, kind, **options).predictions(table.filter("is_test"))
    return run


QUERIES["churn_lr"] = _scored("lr", balanced=True, max_iter=100)
QUERIES["churn_rf"] = _scored("rf", balanced=True)
QUERIES["churn_gbt"] = _scored("gbt", rounds=20)
QUERIES["churn_gbt_sampled"] = _scored("gbt_sampled", rounds=20)
QUERIES["churn_mlp"] = _scored("mlp")
QUERIES["churn_network"] = _scored("network", balanced=True, epochs=40)
QUERIES["churn_boosted"] = _scored("boosted", rounds=20, max_depth=4)
QUERIES["churn_boosted_leaf"] = _scored("boosted_leaf", rounds=10, leaves=8)

# Stated cuts, so that the gains have a checkable result.
GAIN_EDGES = {"purchase_frequency": [2, 5, 8, 10, 12, 15, 20],
              "days_since_last_purchase": [160, 200, 300, 500, 900],
              "avg_transaction_value": [100_000, 130_000, 150_000, 170_000, 200_000]}


@query
def boosting_split_gains(spark, d):
    """The gain of every first cut of a boosted tree that predicts a negative balance."""
    rfm = _rfm(spark, d).withColumn("y", (F.col("balance") < 0).cast("double"))
    share = one_row(rfm.agg(F.avg("y").alias("p")))["p"]
    rows = boosting.binned(rfm, GAIN_EDGES, [F.lit(0).alias("node"), (share - F.col("y")).alias("g"),
                                             (share * (1 - share)).alias("h")])
    gains = boosting.split_gains(boosting.histograms(settle(rows)))
    return _six(gains.drop("node"), "gain", "g_left", "h_left", "g_right", "h_right")


@query
def model_comparison(spark, d):
    """Weighted test metrics of all five kinds of model: linear, forest, both boostings, network."""
    table, names = _prepared(spark, d)
    runs = [churn_run.train(table, names, "lr", max_iter=100),
            churn_run.train(table, names, "rf", trees=20),
            churn_run.train(table, names, "boosted", rounds=5, max_depth=4),
            churn_run.train(table, names, "boosted_leaf", rounds=5, leaves=6),
            churn_run.train(table, names, "mlp")]
    return metrics.metrics_table({r.name: r.confusion() for r in runs})


@query
def batch_predictions(spark, d):
    table, names = _prepared(spark, d)
    return churn_run.train(table, names, "rf", trees=20).predictions()


@query
def feature_importance(spark, d):
    table, names = _prepared(spark, d)
    run = churn_run.train(table, names, "rf", trees=20)
    return models.feature_importance(run.model, table, names, 15)


@query
def permutation_importance(spark, d):
    table, names = _prepared(spark, d)
    return churn_run.train(table, names, "rf", trees=20).importance()


# --- segments and anomalies ------------------------------------------------------------------

def _scaled_rfm(spark, d):
    rfm = settle(_rfm(spark, d).select("customer_id", *RFM3))
    return settle(prepare.standard_scale(rfm, RFM3))


@query
def segment_kmeans(spark, d):
    return segments.kmeans_segments(_scaled_rfm(spark, d), "customer_id", RFM3, k=4)


@query
def kmeans_centers(spark, d):
    scaled = _scaled_rfm(spark, d)
    return segments.cluster_centers(segments.fit_kmeans(scaled, RFM3, 4), scaled, RFM3)


@query
def segment_export_summary(spark, d):
    return _six(segments.export_summary(_clustered(spark, d), "customer_id"), "engagement_score")


@query
def cluster_distribution(spark, d):
    return segments.cluster_distribution(td.table(spark, d, "embeddings"), "label")


@query
def cluster_stats(spark, d):
    return segments.cluster_stats(_clustered(spark, d), [*BEHAVIOUR, "engagement_score"])


@query
def cluster_profiles(spark, d):
    out = segments.cluster_profiles(_clustered(spark, d), BEHAVIOUR)
    return _digits(_six(out, "diff_pct"), 4, "mean_value")


@query
def segment_recommendations(spark, d):
    return segments.segment_recommendations(settle(_clustered(spark, d)))


@query
def cluster_opportunities(spark, d):
    return _digits(segments.cluster_opportunities(_clustered(spark, d)), 4, "mean_value")


@query
def cluster_sample(spark, d):
    return segments.cluster_sample(_customer_clusters(spark, d), "customer_id")


def _customer_clusters(spark, d):
    return td.customers(spark, d).select(
        "customer_id", "balance", F.col("nation").alias("cluster"))


def _anomalies(spark, d):
    rfm = settle(_rfm(spark, d).select("customer_id", *RFM3))
    return dbscan(rfm, "customer_id", RFM3, eps=0.3, min_samples=5)


@query
def dbscan_noise(spark, d):
    return _anomalies(spark, d).select(
        "customer_id", "is_core", (F.col("cluster") == -1).alias("is_noise"))


@query
def dbscan_clusters(spark, d):
    return _anomalies(spark, d).select("customer_id", "cluster")


@query
def dbscan_all_features(spark, d):
    """Anomalies over every numeric column of the feature table, twelve of them."""
    table = settle(_processed(spark, d))
    names = [c for c in table.columns if c != "customer_id"]
    found = dbscan(table, "customer_id", names, eps=1.25, min_samples=5, scale=False)
    return found.select("customer_id", "cluster", "is_core")


@query
def anomaly_summary(spark, d):
    return segments.anomaly_summary(_anomalies(spark, d))


@query
def outlier_characteristics(spark, d):
    rfm = _rfm(spark, d).select(*BEHAVIOUR, F.when(
        F.col("days_since_last_purchase") > 700, -1).otherwise(F.col("nation")).alias("cluster"))
    out = segments.outlier_characteristics(settle(rfm), BEHAVIOUR)
    return _digits(_six(out, "diff_pct"), 4, "outlier_mean", "normal_mean")


@query
def outlier_sample(spark, d):
    return segments.outlier_sample(_anomalies(spark, d), "customer_id")


@query
def anomaly_scatter(spark, d):
    rfm = _rfm(spark, d).withColumn("cluster", F.when(
        F.col("days_since_last_purchase") > 700, -1).otherwise(F.col("nation")))
    return segments.scatter_frame(rfm, "customer_id", "total_spent", "purchase_frequency")


# --- forecasting -----------------------------------------------------------------------------

def _series(period: str) -> Query:
    return lambda spark, d: forecast.sales_series(td.transactions(spark, d), period)


for _name, _period in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):
    QUERIES[f"series_{_name}"] = _series(_period)


@query
def future_calendar(spark, d):
    return forecast.future_calendar(_series("week")(spark, d), "week", 90)


def _forecast(spark, d, period, steps, history=False):
    # Settled: the history is fitted and also summarised.
    series = settle(_series(period)(spark, d))
    return series, forecast.forecast(series, period, steps, history=history)


@query
def forecast_daily(spark, d):
    return forecast.forecast_table(_forecast(spark, d, "day", 90)[1])


@query
def forecast_weekly(spark, d):
    return forecast.forecast_table(_forecast(spark, d, "week", 90)[1])


@query
def forecast_monthly(spark, d):
    return forecast.forecast_table(_forecast(spark, d, "month", 12)[1])


@query
def forecast_by_product(spark, d):
    series = forecast.sales_series(td.sales_lines(spark, d), "month", by=["product_id"])
    ahead = forecast.forecast(series, "month", 3, by=["product_id"])
    return forecast.forecast_table(ahead, by=["product_id"])


@query
def forecast_normal_sums(spark, d):
    """The sums that a fit with a bending trend solves, by place in the upper triangle."""
    sums = changepoints.normal_sums(_series("month")(spark, d), changepoints.SHAPES["month"])
    return _six(sums.select(F.posexplode("products").alias("place", "product")), "product")


@query
def forecast_changepoint(spark, d):
    ahead = changepoints.forecast(_series("month")(spark, d), "month", 12)
    return _digits(ahead.drop("is_future", "weekly"), 0, "yhat", "yhat_lower", "yhat_upper", "trend",
                   "yearly")


@query
def forecast_changepoint_weekly(spark, d):
    ahead = changepoints.forecast(_series("week")(spark, d), "week", 52)
    return _digits(ahead.drop("is_future", "weekly"), 0, "yhat", "yhat_lower", "yhat_upper", "trend",
                   "yearly")


@query
def forecast_changepoint_by_product(spark, d):
    series = forecast.sales_series(td.sales_lines(spark, d), "month", by=["product_id"])
    ahead = changepoints.forecast(series, "month", 3, by=["product_id"], changes=6, yearly=2)
    return _digits(ahead.select("product_id", "ds", "yhat", "yhat_lower", "yhat_upper"), 0, "yhat",
                   "yhat_lower", "yhat_upper")


@query
def forecast_components(spark, d):
    both = _forecast(spark, d, "month", 12, history=True)[1]
    return _digits(forecast.components(both), 2, "trend", "yearly", "weekly")


@query
def forecast_summary(spark, d):
    out = forecast.forecast_summary(*_forecast(spark, d, "month", 12, history=True))
    return _digits(_six(out, "growth_pct"), 2, "avg_historical", "avg_forecast", "total_forecast")


@query
def forecast_advice(spark, d):
    return forecast.outlook_advice(
        forecast.forecast_summary(*_forecast(spark, d, "month", 12, history=True)))


# --- event-time KPIs -------------------------------------------------------------------------

@query
def events_kpi_hourly(spark, d):
    return windowed_kpis(td.table(spark, d, "events"), exact=True).drop("window_end")


@query
def customer_stream(spark, d):
    """The latest figures per customer after all transactions have passed as a stream."""
    table = td.transactions(spark, d)
    source = fresh_path(spark, "stream-in")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    updates = recency.customer_recency(stream, late="36500 days")
    recency.write_updates(updates, out, state).awaitTermination()
    return recency.current_customers(spark.read.parquet(out)).drop("is_quiet")


# --- growing tables --------------------------------------------------------------------------

@query
def sales_from_sketches(spark, d):
    """Quarters rolled up from stored days; distinct customers within 3 % of the exact number."""
    days = settle(sketches.daily_sketches(td.transactions(spark, d)))
    exact = td.transactions(spark, d).groupBy(period_start(F.col("date"), "quarter").alias(
        "period_start")).agg(F.count_distinct("customer_id").alias("_exact"))
    near = F.abs(F.col("unique_customers") - F.col("_exact")) <= 0.03 * F.col("_exact")
    return sketches.rolled_up(days, "quarter").join(exact, "period_start").select(
        "period", "total_revenue", "transaction_count", near.alias("customers_within_3_percent"))


@query
def profile_from_sketches(spark, d):
    """Figures of the order values from one stored sketch per priority."""
    stored = settle(sketches.column_sketches(
        td.table(spark, d, "orders"), ["o_totalprice"], F.col("o_orderpriority")))
    return _digits(sketches.profile(stored).drop("p25", "p50", "p75"), 2, "mean", "std")


@query
def scan_with_quarantine(spark, d):
    """Customers written as CSV, every 40th with a broken balance and every 41st cut short, read back."""
    source, path = td.customers(spark, d), fresh_path(spark, "csv")
    balance = F.when(F.col("customer_id") % 40 == 0, "unknown").otherwise(F.col("balance").cast("string"))
    since = F.when(F.col("customer_id") % 7 == 0, "some day").otherwise("2001-05-06")
    whole = F.concat_ws(",", "customer_id", balance, since)
    source.select(F.when(F.col("customer_id") % 41 == 0, F.col("customer_id").cast("string"))
                  .otherwise(whole).alias("customer_id,balance,created_at")) \
        .write.option("header", True).option("sep", "\x01").csv(path)
    return read_checked(spark, path, "customer_id bigint, balance double, created_at string").report


@query
def customer_rfm_bucketed(spark, d):
    """Frequency, spend and recency from tables laid out by customer, without an exchange."""
    left = write_bucketed(td.customers(spark, d), "patronage_customers", "customer_id", 8)
    right = write_bucketed(td.transactions(spark, d), "patronage_transactions", "customer_id", 8)
    return features.customer_rfm(left, right, td.AS_OF).select(
        "customer_id", "last_purchase_date", *BEHAVIOUR)
