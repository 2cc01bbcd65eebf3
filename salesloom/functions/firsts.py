"""The earliest row of each group, with any key type and no bound on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NULL_FIRST, _NULL_LAST = -(2**31), 2**31 - 1


def earliest(frame: DataFrame, groups: Sequence[str], day: str, key: str, nulls_first: bool = False) -> DataFrame:
    """``groups``, ``day`` and ``key`` of each group's first row: the earliest day, and on it the lowest key.

    A row without a day comes last, or first if ``nulls_first``. Two hash aggregates: the lowest key of each day, then the
    key of the first day, which no longer has ties; a hot group is combined before either shuffle.
    """
    daily = frame.groupBy(*groups, day).agg(F.min(key).alias(key))
    place = F.coalesce(F.unix_date(day), F.lit(_NULL_FIRST if nulls_first else _NULL_LAST))
    first = daily.withColumn("_place", place).groupBy(*groups)
    return first.agg(F.min_by(day, "_place").alias(day), F.min_by(key, "_place").alias(key))
