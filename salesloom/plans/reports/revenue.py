"""Revenue: categories, products, discounts, quarters."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.functions.classify import bucketize
from salesloom.functions.money import dec_round, money, ratio, rounded, safe_pct
from salesloom.operators.calendar import filled
from salesloom.operators.growth import growth
from salesloom.operators.increments import Ledger
from salesloom.operators.lookups import total
from salesloom.operators.materialize import materialize, scratch_dir
from salesloom.operators.ordering import Key, Spec, measure
from salesloom.plans.retail import Retail

# Inclusive upper edges of the discount classes in basis points
DISCOUNT_BUCKETS = [
    (0, "0% (No Discount)"),
    (500, "1-5%"),
    (1000, "6-10%"),
    (1500, "11-15%"),
    (2000, "16-20%"),
]
DISCOUNT_ABOVE = "21-25%"


def category_yoy(retail: Retail, fill: bool = False) -> DataFrame:
    """Revenue per category and year, growth on the previous year, rank within the year.

    ``fill`` adds the years between a category's first and last one in which it sold nothing, so that growth is
    against the year before and not the last one with sales.

    Lines meet their orders once, then shrink to product and year before the
    products are joined. A hot order or product is met by the partial sums and, in
    the join, by the adaptive skew split.
    """
    years = retail.orders().select("OrderID", F.year("OrderDate").cast("bigint").alias("OrderYear"))
    sold = (
        retail.lines()
        .join(years, "OrderID")
        .groupBy("ProductID", "OrderYear")
        .agg(F.sum("NetU").alias("NetU"))
    )
    revenue = (
        sold.join(retail.products().select("ProductID", "CategoryName"), "ProductID")
        .groupBy("CategoryName", "OrderYear")
        .agg(dec_round(money(F.sum("NetU")), 2).alias("Revenue"))
    )
    if fill:
        begun = revenue.withColumn("Begins", F.make_date("OrderYear", F.lit(1), F.lit(1)))
        revenue = filled(begun, "Begins", "year", ["CategoryName"], zero=["Revenue"])
        revenue = revenue.withColumn("OrderYear", F.year("Begins").cast("bigint")).drop("Begins")
    prev, change = growth("Revenue", ["OrderYear"], ["CategoryName"])
    rank = F.rank().over(W.partitionBy("OrderYear").orderBy(F.desc("Revenue")))
    return (
        revenue.select(
            "CategoryName",
            "OrderYear",
            F.col("Revenue").cast("double").alias("Revenue"),
            prev.cast("double").alias("PrevYearRevenue"),
            change.alias("YoY_Growth_Pct"),
            rank.cast("bigint").alias("RankWithinYear"),
        )
    ).orderBy("CategoryName", "OrderYear")


def product_pareto(retail: Retail) -> DataFrame:
    """Revenue, share, ranks and running share per product, best first."""
    base = retail.product_base()
    grand_total = total(base, money(F.sum("NetU")))
    known = base.filter("Known")
    tie = (Key("ProductID"),)
    (in_category,) = measure(
        known, Spec(Key("Revenue", desc=True), tie, within=("CategoryName",)), keys_only=True
    )
    ranks = in_category.arrange().select("ProductID", in_category.rank().alias("RankInCategory"))
    (overall,) = measure(
        known.join(ranks, "ProductID"),
        Spec(Key("Revenue", desc=True), tie, sums=("Revenue",)),
        rows=in_category.rows,
    )
    return (
        overall.arrange()
        .withColumns({"GlobalRank": overall.rank(), "Running": overall.running_sum("Revenue")})
        .select(
            "CategoryName",
            "ProductName",
            F.col("UnitPrice").cast("double").alias("UnitPrice"),
            F.col("Revenue").cast("double").alias("Revenue"),
            F.col("Units").alias("TotalUnitsSold"),
            safe_pct(F.col("Revenue"), grand_total, 2).alias("PctOfTotalRevenue"),
            "GlobalRank",
            "RankInCategory",
            "Discontinued",
            safe_pct(F.col("Running"), grand_total, 1).alias("CumulativeRevenuePct"),
        )
    )


def discount_depth(
    retail: Retail,
    buckets: Sequence[tuple[float, str]] = DISCOUNT_BUCKETS,
    above: str = DISCOUNT_ABOVE,
) -> DataFrame:
    """Lines, revenue and revenue given away per discount class; ``buckets`` in basis points."""
    depth = (
        retail.lines()
        .groupBy(bucketize(F.col("DiscountBp"), buckets, above).alias("DiscountBucket"))
        .agg(
            F.count("*").alias("OrderLines"),
            F.sum("NetU").alias("NetU"),
            F.sum("GrossU").alias("GrossU"),
            F.sum("Quantity").alias("Units"),
            F.sum("DiscountBp").alias("DiscountBp"),
            F.count("Quantity").alias("Counted"),
            F.count("DiscountBp").alias("Rated"),
            F.min("DiscountBp").alias("Lowest"),
        )
    )
    all_lines = F.sum("OrderLines").over(W.partitionBy())
    return (
        depth.withColumn("AllLines", all_lines)
        .orderBy("Lowest")
        .select(
            "DiscountBucket",
            "OrderLines",
            rounded(money(F.col("NetU")), 2).alias("NetRevenue"),
            rounded(money(F.col("GrossU")), 2).alias("GrossRevenue"),
            rounded(money(F.col("GrossU") - F.col("NetU")), 2).alias("RevenueForgone"),
            rounded(ratio(F.col("Units"), F.col("Counted")), 1).alias("AvgQuantity"),
            rounded(ratio(F.col("DiscountBp"), F.col("Rated")) / 100, 1).alias(
                "AvgDiscountPct"
            ),
            safe_pct(F.col("OrderLines"), F.col("AllLines"), 1).alias("PctOfAllLines"),
        )
    )


def quarterly_trend(retail: Retail, fill: bool = False) -> DataFrame:
    """Orders and revenue per quarter and the change on the quarter before; ``fill`` adds quarters without orders."""
    quarters = (
        retail.order_book("inner")
        .groupBy(*_quarter())
        .agg(
            F.count("*").alias("OrderCount"),
            money(F.sum("NetU")).alias("Revenue"),
            F.sum("PricedLines").alias("Priced"),
        )
    )
    return _trend(quarters, fill)


def _quarter() -> list[Column]:
    return [F.year("OrderDate").cast("bigint").alias("OrderYear"), F.quarter("OrderDate").cast("bigint").alias("Quarter")]


# what reports by day and customer need, kept up to date by batches of orders
DAY_KEYS, DAY_SUMS = ("CustomerID", "OrderDate"), ("NetU", "GrossU", "Units", "Lines", "PricedLines")


def order_changes(retail: Retail, sign: int = 1) -> DataFrame:
    """The rows a `Ledger` of DAY_KEYS and DAY_SUMS takes: one for each order with lines. A batch holds whole orders; an order that
    changes is taken back as it was (``sign=-1``) and added as it is."""
    return retail.order_book("inner").select(*DAY_KEYS, *DAY_SUMS, F.lit(sign).alias("sign"))


def trend_of_days(state: DataFrame, fill: bool = False) -> DataFrame:
    """`quarterly_trend` from the state of a ledger, without the orders."""
    quarters = state.groupBy(*_quarter()).agg(
        F.sum("rows").alias("OrderCount"), money(F.sum("NetU")).alias("Revenue"), F.sum("PricedLines").alias("Priced")
    )
    return _trend(quarters, fill)


def customers_of_days(state: DataFrame) -> DataFrame:
    """CustomerID, Orders, NetU, FirstOrder and LastOrder, as the customer reports sum them, from the state of a ledger."""
    return state.groupBy("CustomerID").agg(
        F.sum("rows").alias("Orders"),
        F.sum("NetU").alias("NetU"),
        F.min("OrderDate").alias("FirstOrder"),
        F.max("OrderDate").alias("LastOrder"),
    )


def refreshed_trend(retail: Retail, batches: int = 4) -> DataFrame:
    """`quarterly_trend` from a ledger that took the orders in ``batches``, each twice, with a batch that was wrong and taken
    back between them."""
    spark = retail.orders().sparkSession
    ledger = Ledger(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}", DAY_KEYS, DAY_SUMS)
    changes = materialize(retail.order_book("inner").select("OrderID", *DAY_KEYS, *DAY_SUMS))
    part = F.pmod(F.xxhash64("OrderID"), F.lit(batches))
    for i in range(batches):
        batch = changes.where(part == i).drop("OrderID")
        if i == 1:
            wrong = batch.withColumn("NetU", F.col("NetU") * 2)
            ledger.apply("wrong", wrong.withColumn("sign", F.lit(1)))
            ledger.apply("taken back", wrong.withColumn("sign", F.lit(-1)))
        for _ in range(2):
            ledger.apply(f"part {i}", batch.withColumn("sign", F.lit(1)))
    return trend_of_days(ledger.state())


def _trend(quarters: DataFrame, fill: bool) -> DataFrame:
    if fill:
        begun = quarters.withColumn("Begins", F.make_date("OrderYear", F.col("Quarter") * 3 - 2, F.lit(1)))
        quarters = filled(begun, "Begins", "quarter", zero=["OrderCount", "Revenue", "Priced"])
        year, quarter = F.year("Begins").cast("bigint"), F.quarter("Begins").cast("bigint")
        quarters = quarters.withColumns({"OrderYear": year, "Quarter": quarter}).drop("Begins")
    _, change = growth("Revenue", ["OrderYear", "Quarter"])
    return (
        quarters.withColumn("QoQ_Growth_Pct", change)
        .select(
            "OrderYear",
            "Quarter",
            F.concat(
                F.lit("Q"),
                F.col("Quarter").cast("string"),
                F.lit(" "),
                F.col("OrderYear").cast("string"),
            ).alias("YearQuarter"),
            "OrderCount",
            rounded(F.col("Revenue"), 2).alias("Revenue"),
            rounded(ratio(F.col("Revenue"), F.col("Priced")), 2).alias("AvgLineRevenue"),
            "QoQ_Growth_Pct",
        )
        .orderBy("OrderYear", "Quarter")
    )


def customer_quarters(retail: Retail) -> DataFrame:
    """Orders and revenue of each customer in every quarter from the first to the last order, quarters without orders included: revenue
    of the quarter before, change against it (null if that was nothing), and revenue so far."""
    series = (
        retail.order_book("inner")
        .where(F.col("CustomerID").isNotNull() & F.col("OrderDate").isNotNull())
        .groupBy("CustomerID", F.trunc("OrderDate", "quarter").alias("QuarterStart"))
        .agg(F.count("*").alias("Orders"), dec_round(money(F.sum("NetU")), 2).alias("Revenue"))
    )
    line = W.partitionBy("CustomerID").orderBy("QuarterStart")
    series = series.withColumn("RevenueSoFar", F.sum("Revenue").over(line))
    full = filled(series, "QuarterStart", "quarter", ["CustomerID"], zero=["Orders", "Revenue"], carried=["RevenueSoFar"])
    prev, change = growth("Revenue", ["QuarterStart"], ["CustomerID"])
    return full.select(
        F.col("CustomerID").cast("string").alias("CustomerID"),
        "QuarterStart",
        "Orders",
        F.col("Revenue").cast("double").alias("Revenue"),
        prev.cast("double").alias("PrevQuarterRevenue"),
        change.alias("QoQ_Growth_Pct"),
        F.col("RevenueSoFar").cast("double").alias("RevenueSoFar"),
    )
