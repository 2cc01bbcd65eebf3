"""First-match classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Searched CASE: the label of the first condition that is true."""
    (cond, label), *rest = cases
    out = F.when(cond, F.lit(label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def bucketize(value: Column, uppers: Sequence[tuple[float, str]], else_label: str) -> Column:
    """Label by the first inclusive upper bound that holds the value."""
    return first_match([(value <= F.lit(upper), label) for upper, label in uppers], else_label)
