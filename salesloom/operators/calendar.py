"""Series without gaps: a row for each period between a group's own first and last one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}


def filled(
    series: DataFrame,
    period: str,
    step: str,
    groups: Sequence[str] = (),
    zero: Sequence[str] = (),
    carried: Sequence[str] = (),
) -> DataFrame:
    """``series`` (one row per group and ``period``, the date a ``step`` begins with) with a row for every step between each group's first
    and last period.

    In the new rows the columns ``zero`` are 0, ``carried`` are the last figure known before, any others null. A null group is a group; rows
    without a period stay as they are. The spine comes from two aggregates, not from the rows: it has a row per group and
    step, whatever the group holds.
    """
    if step not in STEPS:
        raise ValueError(f"no such step: {step}")
    dated, undated = series.where(F.col(period).isNotNull()), series.where(F.col(period).isNull())
    ends = dated.groupBy(*groups).agg(F.min(period).alias("__low"), F.max(period).alias("__high"))
    spine = ends.where("__low IS NOT NULL").select(
        *(F.col(g).alias(f"__{g}") for g in groups),
        F.explode(F.sequence("__low", "__high", F.expr(STEPS[step]))).alias(f"__{period}"),
    )
    keys = [*groups, period]
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    met = spine.join(dated.withColumn("__held", F.lit(True)), same, "left")
    new = F.col("__held").isNull()
    columns: dict[str, Column] = {key: F.col(f"__{key}") for key in keys}
    columns |= {c: F.when(new, F.lit(0)).otherwise(F.col(c)).cast(dict(series.dtypes)[c]) for c in zero}
    if carried:
        before = W.partitionBy(*(f"__{g}" for g in groups)).orderBy(f"__{period}").rowsBetween(W.unboundedPreceding, -1)
        columns |= {c: F.when(new, F.last(c, ignorenulls=True).over(before)).otherwise(F.col(c)) for c in carried}
    return met.select(*(columns.get(c, F.col(c)).alias(c) for c in series.columns)).unionByName(undated)
