"""Exact money and ratio expressions.

Amounts are whole millionths in ``decimal(18,0)``: cents x (10000 - discount in
basis points) is an integer, so sums are exact, do not depend on the order of
the rows, and the per-row work is integer arithmetic.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MILLIONTH = Decimal("0.000001")
_UNITS = "decimal(18,0)"
_FINE = "decimal(24,2)"
_EXACT = "decimal(28,8)"


def whole(value: Column, scale: int) -> Column:
    """A fractional number of at most log10(scale) places as a whole number of 1/scale."""
    return F.rint(value * scale).cast("bigint")


def net(cents: Column, discount_bp: Column) -> Column:
    """Line amount after discount, in millionths."""
    return (cents * (F.lit(10_000) - discount_bp)).cast(_UNITS)


def gross(cents: Column) -> Column:
    """Line amount before discount, in millionths."""
    return (cents * F.lit(10_000)).cast(_UNITS)


def fine_net(price: Column, discount: Column) -> Column:
    """Line amount after discount in millionths, from a decimal price of four places and a discount of four: exact to
    hundredths of a millionth."""
    left = F.lit(Decimal("1.0000")) - discount.cast("decimal(5,4)")
    return (price.cast("decimal(19,4)") * left * F.lit(Decimal(1_000_000))).cast(_FINE)


def fine_gross(price: Column) -> Column:
    return (price.cast("decimal(19,4)") * F.lit(Decimal(1_000_000))).cast(_FINE)


def money(millionths: Column) -> Column:
    """Millionths back to the currency unit, still exact."""
    return millionths * F.lit(_MILLIONTH)


def dec_round(value: Column, places: int) -> Column:
    """Round half up on a decimal, never on a binary fraction."""
    return F.round(value.cast(_EXACT), places)


def rounded(value: Column, places: int) -> Column:
    """Rounded report figure as a double."""
    return dec_round(value, places).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def safe_pct(num: Column, den: Column, places: int) -> Column:
    return rounded(ratio(num, den) * 100, places)
