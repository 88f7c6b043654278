"""Period starts, labels and step arithmetic for daily to yearly grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month", "quarter", "year")


def _check(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")


def period_start(when: Column, period: str) -> Column:
    """First day of the period as a date; weeks start on Monday."""
    _check(period)
    return F.date_trunc(period, when.cast("timestamp_ntz")).cast("date")


def period_label(start: Column, period: str) -> Column:
    """2024-01-05, 2024-01-01/2024-01-07, 2024-01, 2024Q1 or 2024."""
    _check(period)
    if period == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if period == "week":
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if period == "month":
        return F.date_format(start, "yyyy-MM")
    if period == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.year(start).cast("string")


def step_interval(period: str) -> Column:
    """One period as an interval, for ``sequence``."""
    _check(period)
    return {
        "day": F.expr("INTERVAL 1 DAY"),
        "week": F.expr("INTERVAL 7 DAY"),
        "month": F.expr("INTERVAL 1 MONTH"),
        "quarter": F.expr("INTERVAL 3 MONTH"),
        "year": F.expr("INTERVAL 1 YEAR"),
    }[period]


def add_steps(start: Column, period: str, steps: int) -> Column:
    """The period start ``steps`` periods later."""
    _check(period)
    if period in ("day", "week"):
        return F.date_add(start, steps * (7 if period == "week" else 1))
    return F.add_months(start, steps * {"month": 1, "quarter": 3, "year": 12}[period])


def parsed_timestamp(value: Column) -> Column:
    """Text to timestamp without zone; anything unparseable becomes null."""
    return F.try_to_timestamp(value.cast("string")).cast("timestamp_ntz")
