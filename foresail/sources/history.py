"""Date-bounded and point-in-time reads of a history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.contracts import BacktestContract

EPOCH = dt.date(1900, 1, 1)
YEAR_LOOKBACK = 366


def _bounds(c: BacktestContract, lookback: int) -> tuple[dt.date, dt.date]:
    first = min(c.origins) - dt.timedelta(days=lookback)
    return first, max(c.origins) + dt.timedelta(days=max(c.horizons))


def _bounded(df: DataFrame, c: BacktestContract, lookback: int) -> DataFrame:
    lo, hi = _bounds(c, lookback)
    return df.filter(F.col(c.date_column).between(F.lit(lo), F.lit(hi)))


def bounded_history(df: DataFrame, c: BacktestContract) -> DataFrame:
    """Baseline history: only the columns and dates any origin can need.

    The bounds are literals, so they prune partitions and reach the scan.
    """
    lookback = max(c.train_window_days, YEAR_LOOKBACK if c.needs_last_year else 0)
    columns = list(
        dict.fromkeys([*c.entity_columns, *c.segment_columns, c.date_column, c.actual_column])
    )
    return _bounded(df, c, lookback).select(*columns)


def bounded_model_history(df: DataFrame, c: BacktestContract) -> DataFrame:
    """Model history: every column, reaching back one training window plus the
    longest horizon (a label is only known that many days later)."""
    lookback = c.train_window_days + max(c.horizons)
    if c.needs_last_year:
        lookback = max(lookback, YEAR_LOOKBACK)
    return _bounded(df, c, lookback)


def train_slice(df: DataFrame, as_of: dt.date, days: int, date: str = "date") -> DataFrame:
    """Rows strictly inside the ``days`` before ``as_of``."""
    lo = as_of - dt.timedelta(days=days)
    return df.filter((F.col(date) > F.lit(lo)) & (F.col(date) <= F.lit(as_of - dt.timedelta(days=1))))


def predict_slice(df: DataFrame, as_of: dt.date, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) == F.lit(as_of))


def high_watermark(target: DataFrame | None, column: str = "date") -> dt.date:
    """Latest date already loaded; the epoch for a missing or empty target."""
    if target is None:
        return EPOCH
    return target.agg(F.max(column)).first()[0] or EPOCH


def incremental_filter(source: DataFrame, target: DataFrame | None, column: str = "date") -> DataFrame:
    """Rows newer than anything the target holds, as a literal filter."""
    return source.filter(F.col(column) > F.lit(high_watermark(target, column)))
