"""CSV scans that keep what they could not read.

A cell that does not fit its type makes the plain reader return null without a word. Here every row
is read once, permissively, with the text of a row that does not fit kept beside it; good rows,
quarantined rows and the figures all come from that one written scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from patronage import roles
from patronage.functions.calendar import parsed_timestamp
from patronage.session import settle
from patronage.sources.readers import nan_to_null

CORRUPT = "_corrupt_record"


@dataclass
class CheckedTable:
    """``rows`` that fit, ``quarantine`` (file, record) of those that do not, and a ``report``."""

    rows: DataFrame
    quarantine: DataFrame
    report: DataFrame


def read_checked(spark: SparkSession, path: str, schema: StructType | str,
                 dates: Sequence[str] = roles.PARSED_DATES) -> CheckedTable:
    """Read a CSV with a header against ``schema``.

    A row with a cell that is not of its type, or with more or fewer cells than columns, is
    quarantined as it stands. Text columns named in ``dates`` are parsed; a text that is no date
    becomes null and is counted. ``report`` has (measure, column, n): ``rows``, ``quarantined`` and,
    per date column, ``coerced_dates``. A file without rows gives empty tables and zeros.
    """
    wanted = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in wanted.fields]
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT)
           .schema(StructType([*wanted.fields]).add(CORRUPT, "string")).csv(path))
    texts = {f.name for f in wanted.fields if f.dataType.typeName() == "string"}
    parsed = [c for c in names if c in set(dates) and c in texts]
    read = settle(raw.select(
        *[F.col(f"`{c}`") for c in names if c not in parsed],
        *[F.struct(F.col(f"`{c}`").alias("text"), parsed_timestamp(F.col(f"`{c}`")).alias("at")).alias(c)
          for c in parsed], CORRUPT, F.input_file_name().alias("_file")))
    good = read.filter(F.col(CORRUPT).isNull())
    rows = nan_to_null(good.select(*[F.col(f"`{c}`.at").alias(c) if c in parsed else F.col(f"`{c}`")
                                     for c in names]))
    bad = F.col(CORRUPT).isNotNull()
    coerced = [(~bad & F.col(f"`{c}`.text").isNotNull() & F.col(f"`{c}`.at").isNull()) for c in parsed]
    figures = read.agg(
        F.count_if(~bad).alias("rows"), F.count_if(bad).alias("quarantined"),
        *[F.count_if(x).alias(f"d{i}") for i, x in enumerate(coerced)])
    lines = [("rows", None, "rows"), ("quarantined", None, "quarantined"),
             *[("coerced_dates", c, f"d{i}") for i, c in enumerate(parsed)]]
    report = figures.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(c).cast("string").alias("column"), F.col(n).alias("n"))
        for m, c, n in lines])))
    return CheckedTable(rows, read.filter(bad).select(F.col("_file").alias("file"),
                                                      F.col(CORRUPT).alias("record")), report)
