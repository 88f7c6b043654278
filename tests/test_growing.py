"""Stored sketches, checked scans, bucketed tables and the customer stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage.operators import features, sketches
from patronage.operators.profile import describe_features
from patronage.sources.buckets import write_bucketed
from patronage.sources.checked import read_checked
from patronage.streaming import recency


def sales(spark, n=20_000):
    return spark.range(n).select(
        (F.col("id") * 7919 % 4001).alias("customer_id"), (F.col("id") % 97 + 0.25).alias("amount"),
        F.expr("timestamp_ntz'2023-01-01 10:00:00' + make_dt_interval(cast(id % 730 as int))").alias("date"))


def test_spans_from_stored_days(spark, tmp_path):
    tx = sales(spark)
    sketches.daily_sketches(tx).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 730
    for period in ("month", "quarter", "year"):
        exact = {r.p: r for r in tx.groupBy(F.date_trunc(period, "date").cast("date").alias("p")).agg(
            F.count_distinct("customer_id").alias("u"), F.sum("amount").alias("s"),
            F.count("*").alias("n")).collect()}
        got = sketches.rolled_up(days, period).collect()
        assert len(got) == len(exact)
        for r in got:
            e = exact[r.period_start]
            assert abs(r.unique_customers - e.u) <= 0.03 * e.u
            assert (r.total_revenue, r.transaction_count) == (pytest.approx(e.s), e.n)
    some = sketches.customers_between(days, "2023-02-10", "2023-03-05").first()[0]
    true = tx.filter("date >= '2023-02-10' and date < '2023-03-06'").select("customer_id").distinct().count()
    assert abs(some - true) <= 0.03 * true
    assert sketches.customers_between(days, "2030-01-01", "2031-01-01").first()[0] == 0


def test_profiles_from_stored_sketches(spark, tmp_path):
    tx = sales(spark).withColumn("customer_id", F.col("customer_id").cast("double")).repartition(7)
    sketches.column_sketches(tx, ["amount", "customer_id"], F.spark_partition_id()) \
        .write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    got = {r.feature: r for r in sketches.profile(stored).collect()}
    want = {r.feature: r for r in describe_features(tx.select("amount", "customer_id")).collect()}
    n = tx.count()
    for name, r in got.items():
        w = want[name]
        assert (r["count"], r["min"], r["max"]) == (n, w["min"], w["max"])
        assert (r["mean"], r["std"]) == (pytest.approx(w["mean"]), pytest.approx(w["std"]))
        for p in (0.25, 0.5, 0.75):
            value = r[f"p{int(100 * p)}"]
            below, upto = (tx.filter(F.col(name) < value).count(), tx.filter(F.col(name) <= value).count())
            assert below - 0.01 * n <= p * n <= upto + 0.01 * n
    shares = [r for r in sketches.histogram(stored, 10).collect() if r.feature == "customer_id"]
    assert len(shares) == 10 and sum(r.share for r in shares) == pytest.approx(1)
    assert all(abs(r.share - 0.1) < 0.01 for r in shares)


def test_rows_that_cannot_be_read_are_kept(spark, tmp_path):
    text = ("id,amount,date\n1,2.5,2024-01-05\n2,many,2024-01-06\n3,4\n4,1.5,someday\n"
            "5,6.0,2024-02-01,extra\n6,,\n")
    (tmp_path / "t.csv").write_text(text)
    got = read_checked(spark, str(tmp_path / "t.csv"), "id bigint, amount double, date string")
    rows = {r.id: r for r in got.rows.collect()}
    assert set(rows) == {1, 4, 6} and rows[4].date is None and rows[6].amount is None
    assert rows[1].date == dt.datetime(2024, 1, 5)
    assert sorted(r.record for r in got.quarantine.collect()) == [
        "2,many,2024-01-06", "3,4", "5,6.0,2024-02-01,extra"]
    assert {(r.measure, r.column): r.n for r in got.report.collect()} == {
        ("rows", None): 3, ("quarantined", None): 3, ("coerced_dates", "date"): 1}
    (tmp_path / "e.csv").write_text("id,amount,date\n")
    none = read_checked(spark, str(tmp_path / "e.csv"), "id bigint, amount double, date string")
    assert none.rows.count() == 0 and {r.n for r in none.report.collect()} == {0}


def test_bucketed_tables_join_without_exchange(spark):
    customers = spark.range(500).select(F.col("id").alias("customer_id"))
    tx = sales(spark, 5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = write_bucketed(customers, "patronage_test_customers", "customer_id", 4)
        right = write_bucketed(tx, "patronage_test_sales", "customer_id", 4)
        got = features.customer_rfm(left, right, "2025-01-01")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = features.customer_rfm(customers, tx, "2025-01-01")
        assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS patronage_test_customers")
        spark.sql("DROP TABLE IF EXISTS patronage_test_sales")


def test_customer_stream_restarts_and_notes_silence(spark, tmp_path):
    schema = "customer_id bigint, amount double, date timestamp_ntz"
    at = lambda *d: dt.datetime(2024, *d)
    files = [
        [(1, 10.0, at(1, 1)), (2, 5.5, at(1, 2)), (None, 9.0, at(1, 2)), (3, None, at(1, 3))],
        [(1, 2.25, at(1, 20)), (2, 1.0, at(1, 15)), (3, 1.0, None)],
        # A purchase on an earlier day than customer 1's newest one still counts; the last file moves
        # the clock on.
        [(1, 4.0, at(1, 18)), (4, 8.0, at(6, 1))],
        [(4, 1.0, at(6, 20)), (1, 100.0, at(1, 5))],
        [(4, 1.0, at(6, 21))],
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, rows in enumerate(files):  # a new run of the stream for every file
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = recency.write_updates(recency.customer_recency(stream, "60 days", "30 days"), out, state)
        assert query.awaitTermination(180) and query.exception() is None
    log = spark.read.parquet(out)
    now = {r.customer_id: r for r in recency.current_customers(log).collect()}
    kept = spark.createDataFrame([r for f in files for r in f if r[1] != 100.0 and r[2]], schema)
    want = features.customer_rfm(spark.range(1, 5).withColumnRenamed("id", "customer_id"), kept,
                                 "2024-07-01").collect()
    for r in want:
        mine = now[r.customer_id]
        assert (mine.purchase_frequency, mine.total_spent, mine.last_purchase_date) == (
            r.purchase_frequency, r.total_spent, r.last_purchase_date)
    assert {k: r.is_quiet for k, r in now.items()} == {1: True, 2: True, 3: True, 4: False}
    assert log.filter("event = 'quiet'").count() == 3


def test_customer_stream_calls_by_bucket_and_timers_by_customer(spark, tmp_path):
    """Customers of one bucket, with names as keys: silence is noted for each at its own time."""
    schema = "customer_id string, amount double, date timestamp_ntz"
    at = lambda *d: dt.datetime(2024, *d)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 1.0, at(1, 1)), ("b", 2.0, at(3, 1)), ("a", 1.0, at(1, 2))],
                 [("c", 3.0, at(4, 20))],    # a is quiet, b not yet
                 [("a", 4.0, at(4, 21)), ("c", 1.0, at(4, 22))],
                 [("c", 1.0, at(9, 1))]):    # all but c are quiet
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        updates = recency.customer_recency(stream, "60 days", "10 days", buckets=1)
        query = recency.write_updates(updates, out, state)
        assert query.awaitTermination(180) and query.exception() is None
    log = sorted((r.customer_id, r.purchase_frequency, r.event, r.total_spent)
                 for r in spark.read.parquet(out).collect())
    assert log == [("a", 2, "purchase", 2.0), ("a", 2, "quiet", 2.0), ("a", 3, "purchase", 6.0),
                   ("a", 3, "quiet", 6.0), ("b", 1, "purchase", 2.0), ("b", 1, "quiet", 2.0),
                   ("c", 1, "purchase", 3.0), ("c", 2, "purchase", 4.0), ("c", 3, "purchase", 5.0)]
