"""Joins and totals whose small side has a known bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_up_to(frame: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``frame`` if its row bound is small; otherwise leave the join to Spark.

    ``rows`` is a bound that is cheap to know: the row count of the dimension
    ``frame`` is grouped by, or its own count if it aggregates a written table.
    """
    return F.broadcast(frame) if rows <= limit else frame


def total(frame: DataFrame, value: Column) -> Column:
    """One value over the whole frame, as a scalar subquery usable in any expression."""
    return frame.agg(value.alias("total")).scalar()
