"""Sales, product, customer and risk operators on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage import roles
from patronage.operators import customers, products, risk, sales

D = dt.datetime


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame([
        (1, "p1", 10.0, D(2024, 1, 5)), (1, "p2", 0.0, D(2024, 2, 1)),
        (2, "p1", 5.0, D(2024, 2, 2)), (2, None, 7.0, D(2024, 3, 1)),
        (3, "p3", None, D(2024, 3, 9)), (None, "p1", 2.0, None),
    ], "customer_id bigint, product_id string, amount double, date timestamp_ntz")


def test_kpis(tx):
    r = sales.sales_kpis(tx).first()
    assert (r.total_revenue, r.total_transactions, r.unique_customers) == (24.0, 6, 3)
    assert r.avg_transaction == pytest.approx(24 / 5)


def test_overview_defaults(spark, tx):
    people = spark.createDataFrame([(1, 1), (2, 0)], "customer_id bigint, churn int")
    r = sales.overview_kpis(people, tx).first()
    assert (r.total_customers, r.total_revenue, r.churn_rate) == (2, 24.0, 50.0)
    bare = sales.overview_kpis(people.drop("churn")).first()
    assert (bare.total_revenue, bare.avg_transaction, bare.churn_rate) == (0.0, 0.0, None)


def test_trend_drops_dateless_rows(tx):
    rows = sales.sales_trend(tx, "month").orderBy("period").collect()
    assert [(r.period, r.total_revenue, r.transaction_count, r.avg_transaction) for r in rows] == [
        ("2024-01", 10.0, 1, 10.0), ("2024-02", 5.0, 2, 2.5), ("2024-03", 7.0, 1, 7.0)]


def test_growth_after_a_zero_period_is_null(spark):
    trend = spark.createDataFrame(
        [(dt.date(2024, m, 1), v, n) for m, v, n in ((1, 0.0, 1), (2, 5.0, 2), (3, 0.0, 2), (4, 3.0, 1))],
        "period_start date, total_revenue double, transaction_count bigint")
    grown = sales.sales_growth(trend)
    assert [r.revenue_growth for r in grown.orderBy("period_start").collect()] == [
        None, None, -100.0, None]
    r = sales.growth_summary(grown).first()
    assert (r.avg_revenue_growth, r.latest_growth) == (-100.0, None)
    assert r.avg_transaction_growth == pytest.approx((100 + 0 - 50) / 3)


def test_products_skip_null_keys_and_keep_all_null_amounts(tx):
    got = {r.product_id: (r.total_revenue, r.total_sales, r.avg_price)
           for r in products.product_performance(tx).collect()}
    assert got == {"p1": (17.0, 3, 5.67), "p2": (0.0, 1, 0.0), "p3": (0.0, 0, None)}


def test_volume_ties_keep_revenue_order(spark):
    perf = spark.createDataFrame([("a", 1.0, 3), ("b", 9.0, 3), ("c", 5.0, 4)],
                                 "product_id string, total_revenue double, total_sales bigint")
    assert [r.product_id for r in products.top_by_volume(perf).collect()] == ["c", "b", "a"]
    assert [r.product_id for r in products.top_by_revenue(perf, 2).collect()] == ["b", "c"]


def test_pareto(spark):
    perf = spark.createDataFrame(
        [("a", 70.0, 1, 70.0), ("b", 20.0, 1, 20.0), ("c", 5.0, 1, 5.0), ("d", 5.0, 1, 5.0)],
        "product_id string, total_revenue double, total_sales bigint, avg_price double")
    rows = products.pareto(perf).orderBy("product_rank").collect()
    assert [(r.product_id, r.cumulative_share) for r in rows] == [
        ("a", 70.0), ("b", 90.0), ("c", 95.0), ("d", 100.0)]
    s = products.pareto_summary(products.pareto(perf, rounded=True)).first()
    assert (s.products_within, s.total_products, s.pct_products) == (1, 4, 25.0)


def test_customer_value(tx):
    perf = customers.customer_performance(tx)
    assert perf.count() == 3
    r = customers.customer_value_kpis(perf).first()
    assert r.avg_customer_value == pytest.approx(22 / 3)
    assert (r.repeat_customers, r.repeat_rate) == (2, pytest.approx(200 / 3))
    assert [x.customer_id for x in customers.top_customers(perf, 2).collect()] == [2, 1]


def test_revenue_at_risk_matches_on_the_key(spark):
    pred = spark.createDataFrame([(1, 0.9, 1), (2, 0.7, 1), (3, 0.8, 1), (9, 0.95, 1)],
                                 "customer_id bigint, churn_probability double, churn_prediction int")
    perf = spark.createDataFrame([(3, 30.0, 1), (2, 50.0, 2), (1, 20.0, 1)],
                                 "customer_id bigint, total_spent double, total_transactions bigint")
    r = risk.revenue_at_risk(pred, perf).first()
    # 0.7 itself is not above the threshold; customer 9 has no revenue on record.
    assert (r.high_risk_customers, r.revenue_at_risk, r.pct_of_revenue) == (3, 50.0, 50.0)
    assert r.avg_high_risk_value == 25.0


def test_retention_actions_are_ordered(spark):
    df = spark.createDataFrame([(1, "High"), (2, "Medium"), (3, "Low"), (4, "Unknown")],
                               "customer_id bigint, risk string")
    got = risk.retention_actions(df, "customer_id").groupBy("customer_id").agg(
        F.count("*").alias("n")).collect()
    assert {r.customer_id: r.n for r in got} == {1: 5, 2: 4, 3: 3, 4: 3}


def test_distributions(spark):
    pred = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "customer_id int, churn_prediction int")
    assert {r.status: r.customers for r in risk.churn_distribution(pred).collect()} == {
        "Churned": 1, "Not Churned": 2}
    people = spark.createDataFrame([(1.0, 1), (2.0, 1), (4.0, 9)], "total_spent double, purchase_frequency int")
    rows = customers.value_histograms(people, 2).collect()
    assert {(r.feature, r.bin): r.n for r in rows} == {
        ("total_spent", 0): 2, ("total_spent", 1): 1,
        ("purchase_frequency", 0): 2, ("purchase_frequency", 1): 1}
    with pytest.raises(roles.MissingRole):
        customers.value_histograms(pred)


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 5), (2, 3.0, "y", 5), (3, 3.0, "x", None)],
                               "user_id int, total double, flag string, third int")
    assert roles.pick(df, None, roles.SALES_AMOUNT, "amount") == "total"
    assert roles.pick(df, None, roles.SALES_CUSTOMER, "customer") == "user_id"
    with pytest.raises(roles.MissingRole):
        roles.pick(df, None, roles.SALES_DATE, "date")
    assert roles.find_target(df) == "third"
    assert roles.find_target(df.withColumn("Exited", F.lit(1))) == "Exited"
    flags = {r.column_name: r.two_valued for r in roles.two_valued_columns(df).collect()}
    assert flags == {"user_id": False, "total": True, "flag": True, "third": True}
