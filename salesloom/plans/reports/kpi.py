"""Executive snapshot: fifteen figures, each table read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dec_round, money, ratio
from salesloom.plans.reports.shipping import late, shipped
from salesloom.plans.retail import Retail


def _dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(dec_round(amount, 0), 0))


def _whole(count: Column) -> Column:
    return F.format_number(count, 0)


def _percent(num: Column, den: Column) -> Column:
    return F.concat(F.format_number(dec_round(ratio(num, den) * 100, 1), 1), F.lit("%"))


def _share(num: Column, den: Column) -> Column:
    return F.concat(_whole(num), F.lit(" ("), _percent(num, den), F.lit(")"))


def kpi_snapshot(retail: Retail) -> DataFrame:
    """KPI, Value (text) and Number (the figure the text starts with).

    Orders and line totals meet in one full join and shrink to customers on the
    way, so distinct customers are counted without a second pass over the orders.
    """
    per_customer = (
        retail.order_book("outer")
        .groupBy("CustomerID")
        .agg(
            F.count("Booked").alias("orders"),
            F.sum("NetU").alias("net"),
            F.sum("GrossU").alias("gross"),
            F.sum("Lines").alias("lines"),
            F.sum("DiscountedLines").alias("discounted"),
            F.count_if(F.col("Booked") & shipped()).alias("shipped"),
            F.count_if(F.col("Booked") & late()).alias("late"),
        )
    )
    facts = per_customer.agg(
        F.count_if(F.col("CustomerID").isNotNull() & (F.col("orders") > 0)).alias("customers"),
        *(
            F.sum(c).alias(c)
            for c in ("orders", "net", "gross", "lines", "discounted", "shipped", "late")
        ),
    )
    active = F.col("Discontinued") == 0
    products = retail.listed_products().agg(
        F.struct(
            F.count_if(active).alias("active"),
            F.count_if(F.col("Discontinued") == 1).alias("discontinued"),
            F.count_if(active & (F.col("UnitsInStock") <= F.col("ReorderLevel"))).alias("low"),
            F.count_if(active & (F.col("UnitsInStock") == 0)).alias("out"),
        ).alias("p")
    )
    suppliers = retail.supplier_keys().agg(F.count("*").alias("n"))
    snapshot = facts.select(
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "orders", "lines", "discounted")),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("shipped", "late")),
        money(F.col("net")).alias("net"),
        money(F.col("gross")).alias("gross"),
        products.scalar().alias("p"),
        suppliers.scalar().alias("suppliers"),
    ).withColumns(
        {"lost": F.col("gross") - F.col("net"), "unshipped": F.col("orders") - F.col("shipped")}
    )
    c = F.col
    # The names of the figures and their order
    figures = [
        ("Net Revenue (after discounts)", _dollars(c("net")), dec_round(c("net"), 0)),
        ("Gross Revenue (before discounts)", _dollars(c("gross")), dec_round(c("gross"), 0)),
        ("Revenue Lost to Discounts", _dollars(c("lost")), dec_round(c("lost"), 0)),
        (
            "Discount Cost %",
            _percent(c("lost"), c("gross")),
            dec_round(ratio(c("lost"), c("gross")) * 100, 1),
        ),
        ("Total Orders", _whole(c("orders")), c("orders")),
        ("Total Order Lines", _whole(c("lines")), c("lines")),
        ("Active Customers", _whole(c("customers")), c("customers")),
        ("Active Products", _whole(c("p.active")), c("p.active")),
        ("Discontinued Products", _whole(c("p.discontinued")), c("p.discontinued")),
        ("Suppliers", _whole(c("suppliers")), c("suppliers")),
        ("Order Lines with Discounts", _share(c("discounted"), c("lines")), c("discounted")),
        ("Unshipped Orders", _whole(c("unshipped")), c("unshipped")),
        ("Late Orders (of shipped)", _share(c("late"), c("shipped")), c("late")),
        ("Products Below Reorder Level (active)", _whole(c("p.low")), c("p.low")),
        ("Products Out of Stock (active)", _whole(c("p.out")), c("p.out")),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("KPI"), text.alias("Value"), number.cast("double").alias("Number")
        )
        for name, text, number in figures
    ]
    return snapshot.select(F.inline(F.array(*rows)))
