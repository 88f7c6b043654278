"""Table readers: CSV with a header, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from patronage import roles
from patronage.functions.calendar import parsed_timestamp


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes null."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floating
        else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               schema: StructType | str | None = None) -> DataFrame:
    """Read a table; for CSV give ``schema`` to avoid the extra pass type inference needs."""
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option(
            "inferSchema", True)
        return nan_to_null(reader.csv(path))
    if fmt == "parquet":
        return nan_to_null((spark.read.schema(schema) if schema else spark.read).parquet(path))
    raise ValueError(f"format must be csv or parquet, got {fmt!r}")


def parse_dates(df: DataFrame, candidates=roles.PARSED_DATES) -> DataFrame:
    """Parse every known date column; values that are no dates become null."""
    known = set(candidates)
    return df.select(*[
        parsed_timestamp(F.col(c)).alias(c)
        if c in known and df.schema[c].dataType.typeName() == "string"
        else F.col(f"`{c}`") for c in df.columns])


def read_customers(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    return read_table(spark, path, fmt, schema)


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema=None) -> DataFrame:
    return parse_dates(read_table(spark, path, fmt, schema))


def read_products(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    return read_table(spark, path, fmt, schema)
