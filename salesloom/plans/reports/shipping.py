"""Shipping: carriers, order size against delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.functions.classify import bucketize, first_match
from salesloom.functions.money import dec_round, money, ratio, rounded, safe_pct
from salesloom.operators.materialize import materialize
from salesloom.operators.ordering import Key, Spec, measure
from salesloom.plans.retail import Retail

# Inclusive upper edges of the order sizes in units
ORDER_SIZES = [(20, "Small  (≤20 units)"), (50, "Medium (21-50 units)")]
ORDER_LARGE = "Large  (>50 units)"
# The delivery outcomes
NOT_SHIPPED = "Not Yet Shipped"
ON_TIME = "On Time"
LATE = "Late"


def shipped() -> Column:
    return F.col("ShippedDate").isNotNull()


def on_time() -> Column:
    return F.col("ShippedDate") <= F.col("RequiredDate")


def late() -> Column:
    return F.col("ShippedDate") > F.col("RequiredDate")


def days_to_ship() -> Column:
    return F.datediff("ShippedDate", "OrderDate")


def delivery_status() -> Column:
    """A shipped order without a required date counts as late."""
    return first_match([(~shipped(), NOT_SHIPPED), (on_time(), ON_TIME)], LATE)


def carrier_sla(retail: Retail) -> DataFrame:
    """Orders, punctuality, days to ship and freight per shipper, fastest first."""
    carriers = (
        retail.order_book("left")
        .withColumn("Days", days_to_ship())
        .groupBy("ShipperID")
        .agg(
            F.count("*").alias("TotalOrders"),
            F.count_if(shipped()).alias("ShippedOrders"),
            F.count_if(~shipped()).alias("UnshippedOrders"),
            F.count_if(on_time()).alias("OnTimeOrders"),
            F.count_if(late()).alias("LateOrders"),
            ratio(F.sum("Days"), F.count("Days")).alias("Speed"),
            F.min("Days").cast("bigint").alias("MinDaysToShip"),
            F.max("Days").cast("bigint").alias("MaxDaysToShip"),
            ratio(F.sum("Freight"), F.count("Freight")).alias("FreightCharge"),
        )
    )
    return (
        retail.name_shipper(carriers)
        .withColumn("SpeedRank", F.rank().over(W.orderBy("Speed")).cast("bigint"))
        .select(
            "Shipper",
            "TotalOrders",
            "ShippedOrders",
            "UnshippedOrders",
            "OnTimeOrders",
            "LateOrders",
            safe_pct(F.col("OnTimeOrders"), F.col("ShippedOrders"), 1).alias("OnTimePct"),
            rounded(F.col("Speed"), 2).alias("AvgDaysToShip"),
            "MinDaysToShip",
            "MaxDaysToShip",
            rounded(F.col("FreightCharge"), 2).alias("AvgFreightCharge"),
            "SpeedRank",
        )
        .orderBy("SpeedRank", "Shipper")
    )


def sized_orders(
    retail: Retail, sizes: Sequence[tuple[float, str]] = ORDER_SIZES, products: bool = False
) -> DataFrame:
    """Orders with lines, their revenue, size class, freight share and delivery status."""
    return (
        retail.order_book("inner", products)
        .withColumn("OrderRevenue", dec_round(money(F.col("NetU")), 2))
        .withColumns(
            {
                "FreightPct": safe_pct(F.col("Freight"), F.col("OrderRevenue"), 1),
                "OrderSizeCategory": bucketize(F.col("Units"), sizes, ORDER_LARGE),
                "DaysToShip": days_to_ship().cast("bigint"),
                "DeliveryStatus": delivery_status(),
            }
        )
    )


def order_size_delivery(
    retail: Retail, sizes: Sequence[tuple[float, str]] = ORDER_SIZES, tiles: int = 4
) -> DataFrame:
    """Every order with its size, revenue quartile and delivery, largest revenue first.

    One order serves the sort and the quartile: tiles are numbered from its far end.
    """
    base = materialize(
        retail.name_shipper(sized_orders(retail, sizes, products=True))
        .join(retail.customers(), "CustomerID")
        .select(
            "OrderID",
            "CompanyName",
            "Country",
            "Shipper",
            F.col("Units").alias("TotalQuantity"),
            "OrderRevenue",
            F.col("Products").alias("UniqueProducts"),
            F.col("Freight").cast("double").alias("Freight"),
            "FreightPct",
            "OrderSizeCategory",
            "DaysToShip",
            "DeliveryStatus",
        )
    )
    (order,) = measure(base, Spec(Key("OrderRevenue", desc=True), (Key("OrderID", desc=True),)))
    return (
        order.arrange()
        .withColumn("Position", order.row_number())
        .select(
            "OrderID",
            "CompanyName",
            "Country",
            "Shipper",
            "TotalQuantity",
            F.col("OrderRevenue").cast("double").alias("OrderRevenue"),
            "UniqueProducts",
            "Freight",
            "FreightPct",
            "OrderSizeCategory",
            order.ntile(tiles, F.col("Position"), reverse=True).alias("RevenueQuartile"),
            "DaysToShip",
            "DeliveryStatus",
        )
    )
