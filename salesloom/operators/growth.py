"""Change against the previous row of an aggregated series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.functions.money import ratio, rounded


def growth(
    value: str, order: list[str], partition: list[str] | None = None, places: int = 1
) -> tuple[Column, Column]:
    """(value of the previous row, % change against it).

    For aggregates over calendar periods: the window runs over one row per period.
    The previous row counts, even if a period between is missing.
    """
    window = W.partitionBy(*(partition or [])).orderBy(*order)
    prev = F.lag(value).over(window)
    return prev, rounded(ratio(F.col(value) - prev, prev) * 100, places)
