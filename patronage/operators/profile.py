"""Table profiling: size, missing cells, completeness, column statistics, type counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.stats import exact_quantiles, long_form
from patronage.roles import numeric_columns


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType.typeName()
    return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()


def _missing_counts(df: DataFrame) -> DataFrame:
    """One pass: rows plus one missing count per column (m0, m1, …)."""
    return df.agg(F.count("*").alias("rows"),
                  *[F.count_if(_missing(df, c)).alias(f"m{i}")
                    for i, c in enumerate(df.columns)])


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    return df.orderBy(key).limit(rows)


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns, missing cells."""
    parts = []
    for name, df in tables.items():
        total = sum((F.col(f"m{i}") for i in range(1, len(df.columns))), F.col("m0"))
        parts.append(_missing_counts(df).select(
            F.lit(name).alias("table_name"), F.col("rows").alias("n_rows"),
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            total.alias("missing_cells")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dtype_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns per type and table, from the schemas alone, over the tables' row counts."""
    parts = []
    for name, df in tables.items():
        kinds: dict[str, int] = {}
        for f in df.schema.fields:
            kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
        rows = df.agg(F.count("*").alias("n_rows"))
        parts.append(rows.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(k).alias("data_type"),
                     F.lit(n).cast("bigint").alias("n_columns"), F.col("n_rows"))
            for k, n in sorted(kinds.items())])).alias("r")).select("r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns that have missing cells, with their count."""
    return (_missing_counts(df)
            .select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
                for i, c in enumerate(df.columns)])).alias("r"))
            .select("r.*").filter("missing_count > 0"))


def completeness(df: DataFrame) -> DataFrame:
    """Rows, columns and the share of filled cells in percent."""
    missing = sum((F.col(f"m{i}") for i in range(1, len(df.columns))), F.col("m0"))
    cells = F.col("rows") * F.lit(len(df.columns))
    return _missing_counts(df).select(
        F.lit(len(df.columns)).cast("bigint").alias("total_features"),
        F.col("rows").alias("samples"),
        ((F.lit(1.0) - F.try_divide(missing.cast("double"), cells.cast("double")))
         * F.lit(100.0)).alias("completeness_pct"))


def describe_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column."""
    columns = columns or numeric_columns(df)
    long = long_form(df, [], columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    base = long.groupBy("feature").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quart = exact_quantiles(long, ["feature"], [0.25, 0.5, 0.75]).groupBy("feature").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(quart, "feature").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def lookup(df: DataFrame, key: str, wanted: str) -> DataFrame:
    """Rows whose id, as text, equals the searched text."""
    return df.filter(F.col(key).cast("string") == F.lit(wanted.strip()))


def attribute_rows(df: DataFrame, key: str, wanted: str, fields: int = 25) -> DataFrame:
    """One customer as (position, attribute, value) rows, first ``fields`` attributes.

    A customer id names one row; should it name several, the smallest row is shown.
    """
    shown = df.columns[:fields]
    one = lookup(df, key, wanted).agg(F.min(F.struct(*[
        F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(shown)])).alias("r"))
    return one.filter(F.col("r").isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("attribute"),
                 F.col(f"r.a{i}").alias("value"))
        for i, c in enumerate(shown)])).alias("x")).select("x.*")
