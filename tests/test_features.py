"""Preparation and behaviour features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage.operators import features, labels, prepare, profile
from patronage.plans.feature_table import processed_features

D = dt.datetime
AS_OF = "2024-04-01 00:00:00"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (1, "a", 10.0, "gold", "2024-01-01"), (2, "b", None, None, "bad"),
        (3, "c", 30.0, "gold", None), (4, "d", 20.0, "basic", "2023-04-02")],
        "customer_id bigint, name string, age double, tier string, signup_date string")


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame([
        (1, 10.0, D(2024, 3, 1)), (1, 20.0, D(2024, 3, 31, 12)), (2, 5.0, D(2024, 1, 1)),
        (3, None, None), (None, 9.0, D(2024, 1, 1))],
        "customer_id bigint, amount double, date timestamp_ntz")


def test_rfm_defaults(people, tx):
    got = {r.customer_id: (r.purchase_frequency, r.total_spent, r.avg_transaction_value,
                           r.days_since_last_purchase)
           for r in features.customer_rfm(people, tx, AS_OF).collect()}
    assert got == {1: (2, 30.0, 15.0, 0), 2: (1, 5.0, 5.0, 91), 3: (1, 0.0, 0.0, 365),
                   4: (0, 0.0, 0.0, 365)}


def test_rfm_can_run_twice(people, tx):
    once = features.customer_rfm(people, tx, AS_OF)
    twice = features.customer_rfm(once, tx, AS_OF)
    assert sorted(once.columns) == sorted(twice.columns)
    assert once.orderBy("customer_id").select(sorted(once.columns)).collect() == \
        twice.orderBy("customer_id").select(sorted(twice.columns)).collect()


def test_rfm_scans_transactions_once(spark, folder):
    from patronage.plans.catalog import QUERIES
    plan = QUERIES["customer_rfm"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1
    assert "o_orderpriority" not in plan and "Cartesian" not in plan


def test_engagement_of_constant_inputs_is_zero(spark):
    df = spark.createDataFrame([(1, 5, 7.0, 10), (2, 5, 7.0, 10)],
                               "customer_id bigint, purchase_frequency bigint, "
                               "total_spent double, days_since_last_purchase bigint")
    assert [r.engagement_score for r in features.with_engagement(df).collect()] == [0.0, 0.0]
    one = features.with_engagement(df.limit(1)).first()
    assert one.engagement_score == 0.0


def test_tenure(people):
    got = {r.customer_id: r.subscription_tenure_days
           for r in features.with_tenure(people, AS_OF).collect()}
    assert got == {1: 91, 2: 0, 3: 0, 4: 365}


def test_impute(people):
    rows = prepare.impute_mode(prepare.impute_median(people, ["age"]), ["tier"]).collect()
    assert {r.customer_id: (r.age, r.tier) for r in rows} == {
        1: (10.0, "gold"), 2: (20.0, "gold"), 3: (30.0, "gold"), 4: (20.0, "basic")}


def test_label_order_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "k int, x string")
    got = {r.k: r.x for r in prepare.label_encode(df, ["x"]).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: None}


def test_scale(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (2, 3.0, 5), (3, None, 5)], "k int, x double, c int")
    got = {r.k: (r.x, r.c) for r in prepare.standard_scale(df, ["x", "c"]).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}


def test_processed_features(people, tx):
    table = people.withColumn("churn", (F.col("customer_id") == 1).cast("int"))
    out = processed_features(table, tx, AS_OF, target="churn")
    assert "name" not in out.columns and "signup_date" not in out.columns
    assert {r.customer_id: r.churn for r in out.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    for c in out.columns:
        if c not in ("customer_id", "churn"):
            mean, dev, nulls = out.agg(F.avg(c), F.stddev_pop(c), F.count_if(F.isnull(c))).first()
            assert abs(mean) < 1e-9 and nulls == 0
            assert dev == pytest.approx(1.0) or dev == 0.0


def test_result_does_not_depend_on_partitioning(people, tx):
    one = processed_features(people.coalesce(1), tx.coalesce(1), AS_OF).orderBy("customer_id")
    many = processed_features(people.repartition(8), tx.repartition(8), AS_OF).orderBy("customer_id")
    for a, b in zip(one.collect(), many.collect()):
        assert list(a) == pytest.approx(list(b))


def test_profile(people):
    assert {r.column_name: r.missing_count for r in profile.missing_by_column(people).collect()} \
        == {"age": 1, "tier": 1, "signup_date": 1}
    r = profile.table_summary({"people": people}).first()
    assert (r.n_rows, r.n_columns, r.missing_cells) == (4, 5, 3)
    assert profile.completeness(people).first().completeness_pct == pytest.approx(85.0)
    r = profile.describe_features(people, ["age"]).first()
    assert (r["count"], r.p25, r.p50, r.p75, r.std) == (3, 15.0, 20.0, 25.0, 10.0)
    assert profile.lookup(people, "customer_id", " 3 ").count() == 1
    assert [x.attribute for x in profile.attribute_rows(people, "customer_id", "3", 2).collect()] \
        == ["customer_id", "name"]
    assert profile.attribute_rows(people, "customer_id", "99").count() == 0


def test_median_binarize(spark):
    many = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "y double")
    assert [r.churn for r in labels.median_binarize(many, "y").orderBy("y").collect()] == [0, 0, 1, 1]
    two = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "y double")
    assert [r.churn for r in labels.median_binarize(two, "y").orderBy("y").collect()] == [0, 1, 1]


def test_synthetic_label_marks_the_weakest(spark):
    df = spark.createDataFrame([(i, 10 - i, i * 10) for i in range(11)],
                               "customer_id bigint, purchase_frequency bigint, "
                               "days_since_last_purchase bigint")
    got = {r.customer_id: r.churn for r in labels.synthetic_churn(df).collect()}
    assert [i for i, c in got.items() if c] == [7, 8, 9, 10]
    with pytest.raises(ValueError):
        labels.synthetic_churn(df.select("customer_id"))


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    exact = labels.split_stratified(df, "k", "y", 0.2).cache()
    shares = {r.y: r.t for r in exact.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
    assert shares[1] in (50, 51) and shares[0] in (150, 151)
    assert exact.count() == 1000
    a = labels.split_by_hash(df, "k", 0.3, seed=1).orderBy("k").collect()
    b = labels.split_by_hash(df.repartition(9), "k", 0.3, seed=1).orderBy("k").collect()
    assert a == b and 240 < sum(r.is_test for r in a) < 360


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "churn int")
    assert {r.churn: r.weight for r in labels.class_weights(df).collect()} == {
        1: 2.0, 0: pytest.approx(2 / 3)}
    assert {r.churn: r.weight for r in labels.with_class_weight(df).collect()} == {
        1: 2.0, 0: pytest.approx(2 / 3)}
