"""Calendar parts of a date (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_COLUMNS = [
    "day_of_month",
    "day_of_week",
    "iso_week_of_year",
    "month",
    "quarter",
    "year",
    "week_of_month",
    "iso_year",
    "iso_week",
    "day_name",
    "month_name",
]
CALENDAR_NUMBERS = [c for c in CALENDAR_COLUMNS if not c.endswith("_name")]


def calendar_columns(date: Column) -> dict[str, Column]:
    """Day of week counts Sunday as 1; ``iso_week_of_year`` is the Sunday-based
    week 0-53 under the name the feature tables have always used for it."""
    return {
        "day_of_month": F.dayofmonth(date),
        "day_of_week": F.dayofweek(date),
        "iso_week_of_year": F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / 7).cast("int"),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "week_of_month": F.ceil(F.dayofmonth(date) / 7.0).cast("int"),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), date).cast("int"),
        "iso_week": F.weekofyear(date),
        "day_name": F.date_format(date, "EEEE"),
        "month_name": F.date_format(date, "MMMM"),
    }


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date)))


def day_number(date: Column) -> Column:
    return F.unix_date(date)
