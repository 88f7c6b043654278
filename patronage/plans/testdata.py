"""The star-schema tables as customers, transactions and products.

Each function only renames and projects, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The day all ages are counted to.
AS_OF = "2002-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))


def customers_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with missing cells: negative balances, nations 0-4, one market segment."""
    return customers(spark, folder).withColumns({
        "nation": F.when(F.col("nation") >= 5, F.col("nation")),
        "balance": F.when(F.col("balance") >= 0, F.col("balance")),
        "segment": F.when(F.col("segment") != "BUILDING", F.col("segment"))})


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("date"))


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("date"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
