"""Edges of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom.functions.classify import bucketize
from salesloom.functions.firsts import earliest
from salesloom.functions.money import fine_gross, fine_net, gross, money, net, ratio, rounded, safe_pct, whole
from salesloom.plans.reports.revenue import DISCOUNT_ABOVE, DISCOUNT_BUCKETS
from salesloom.plans.reports.shipping import ORDER_LARGE, ORDER_SIZES
from salesloom.plans.reports.supply import stock_status


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, places, want", [(1.005, 2, 1.01), (6.55, 1, 6.6), (-0.001, 2, 0.0), (2.5, 0, 3.0)])
def test_round_half_up(spark, value, places, want):
    assert _one(spark, rounded(F.lit(value), places)) == want


def test_zero_denominators_are_null(spark):
    assert _one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert _one(spark, safe_pct(F.lit(1), F.lit(None).cast("int"), 1)) is None


def test_line_amounts_are_exact(spark):
    cents, bp = whole(F.lit(19.99), 100), whole(F.lit(0.15), 10_000)
    assert str(_one(spark, money(net(cents, bp)))) == "16.991500"
    assert str(_one(spark, money(gross(cents)))) == "19.990000"


@pytest.mark.parametrize(
    "discount, want",
    [
        (0.0, "0% (No Discount)"),
        (0.01, "1-5%"),
        (0.05, "1-5%"),
        (0.0501, "6-10%"),
        (0.10, "6-10%"),
        (0.15, "11-15%"),
        (0.20, "16-20%"),
        (0.25, "21-25%"),
    ],
)
@pytest.mark.parametrize("type_", ["double", "float", "decimal(5,4)"])
def test_discount_edges(spark, discount, want, type_):
    bp = whole(F.lit(discount).cast(type_), 10_000)
    assert _one(spark, bucketize(bp, DISCOUNT_BUCKETS, DISCOUNT_ABOVE)) == want


@pytest.mark.parametrize("units, want", [(20, "Small"), (21, "Medium"), (50, "Medium"), (51, "Large")])
def test_size_edges(spark, units, want):
    assert _one(spark, bucketize(F.lit(units), ORDER_SIZES, ORDER_LARGE)).startswith(want)


@pytest.mark.parametrize(
    "stock, on_order, level, want",
    [
        (0, 9, 5, "OUT"),
        (4, 0, 5, "CRITICAL"),
        (4, 1, 5, "BELOW"),
        (5, 0, 5, "LOW"),
        (7, 0, 5, "LOW"),
        (15, 0, 10, "OK"),
        (1, 0, 0, "OK"),
    ],
)
def test_stock_classes(spark, stock, on_order, level, want):
    frame = spark.createDataFrame([(stock, on_order, level)], "UnitsInStock int, UnitsOnOrder int, ReorderLevel int")
    assert frame.select(stock_status().alias("s")).first()["s"].startswith(want)


def test_earliest_takes_any_key_and_null_days(spark):
    rows = [
        (1, dt.date(2020, 1, 3), 10**13), (1, dt.date(2020, 1, 1), 3 * 10**13 + 7), (1, dt.date(2020, 1, 1), 4 * 10**13),
        (2, dt.date(1900, 5, 1), -5), (2, dt.date(1900, 5, 1), 3), (3, None, 9), (3, dt.date(2000, 1, 1), 8),
    ]
    frame = spark.createDataFrame(rows, "g int, d date, k bigint")
    last = {r["g"]: (r["d"], r["k"]) for r in earliest(frame, ["g"], "d", "k").collect()}
    assert last == {1: (dt.date(2020, 1, 1), 3 * 10**13 + 7), 2: (dt.date(1900, 5, 1), -5), 3: (dt.date(2000, 1, 1), 8)}
    first = {r["g"]: (r["d"], r["k"]) for r in earliest(frame, ["g"], "d", "k", nulls_first=True).collect()}
    assert first == last | {3: (None, 9)}


def test_four_place_prices_are_exact(spark):
    price, discount = F.lit("1.2345").cast("decimal(19,4)") * 1000, F.lit("0.15").cast("decimal(5,4)")
    assert str(_one(spark, money(fine_gross(price)))) == "1234.50000000"
    assert str(_one(spark, money(fine_net(price, discount)))) == "1049.32500000"
