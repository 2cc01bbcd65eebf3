"""Distinct customers and quantiles of order values for any period, from small figures stored once a day.

A stored row holds two sketches of a country's orders on a day: a theta sketch of its customers and a KLL sketch of the order values in
cents. Sketches merge, so a period reads one row a day and country instead of its orders. The exact forms stand beside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.money import dec_round, money, rounded
from salesloom.operators.materialize import materialize
from salesloom.operators.selection import group_quantiles
from salesloom.plans.retail import Retail

THETA_BITS = 12  # 4,096 samples: a standard error of 1.6 %; fewer customers are counted exactly
KLL_K = 800  # rank error below half a per cent
CUSTOMERS_OFF, RANK_OFF = 0.06, 0.02  # what the stored figures may be off


def _orders(retail: Retail) -> DataFrame:
    return (
        retail.order_book("inner")
        .join(retail.customers().select("CustomerID", "Country"), "CustomerID")
        .where("OrderDate IS NOT NULL")
        .select(
            "Country",
            "OrderDate",
            F.col("CustomerID").cast("string").alias("CustomerID"),
            (dec_round(money(F.col("NetU")), 2) * 100).cast("bigint").alias("Cents"),
        )
    )


def daily_sketches(retail: Retail) -> DataFrame:
    """Country, OrderDate, Orders, Cents, Customers (theta), OrderValues (KLL): a row for each country and day with orders. A customer of
    no country and an order without a date are left out."""
    return (
        _orders(retail)
        .groupBy("Country", "OrderDate")
        .agg(
            F.count("*").alias("Orders"),
            F.sum("Cents").alias("Cents"),
            F.theta_sketch_agg("CustomerID", THETA_BITS).alias("Customers"),
            F.kll_sketch_agg_bigint("Cents", KLL_K).alias("OrderValues"),
        )
    )


def store(sketches: DataFrame, path: str) -> None:
    """Writes the days of ``sketches``, a folder a month; a month that is written again is replaced as a whole."""
    dated = sketches.withColumn("Month", F.trunc("OrderDate", "month"))
    writer = dated.repartition("Month").sortWithinPartitions("OrderDate", "Country").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("Month").parquet(path)


def stored(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The stored days from ``first`` to ``last``; only the folders of their months are read."""
    days = spark.read.parquet(path)
    if first:
        days = days.where((F.col("OrderDate") >= F.lit(first)) & (F.col("Month") >= F.lit(first.replace(day=1))))
    if last:
        days = days.where((F.col("OrderDate") <= F.lit(last)) & (F.col("Month") <= F.lit(last)))
    return days


def merged(days: DataFrame, *groups: str) -> DataFrame:
    """groups, Orders, Revenue, Customers (estimated), LowerQuartile, MedianOrderValue, UpperQuartile, from stored days."""
    whole = days.groupBy(*groups).agg(
        F.sum("Orders").alias("Orders"),
        F.sum("Cents").alias("Cents"),
        F.theta_union_agg("Customers", THETA_BITS).alias("Customers"),
        F.kll_merge_agg_bigint("OrderValues").alias("OrderValues"),
    )
    value = lambda q: rounded(F.kll_sketch_get_quantile_bigint("OrderValues", F.lit(q)).cast("decimal(28,2)") / 100, 2)
    return whole.select(
        *groups,
        "Orders",
        rounded(F.col("Cents").cast("decimal(28,2)") / 100, 2).alias("Revenue"),
        F.theta_sketch_estimate("Customers").alias("Customers"),
        value(0.25).alias("LowerQuartile"),
        value(0.5).alias("MedianOrderValue"),
        value(0.75).alias("UpperQuartile"),
        "OrderValues",
    )


def exact(retail: Retail, *groups: str) -> DataFrame:
    """groups, Orders, Customers and MedianOrderValue without sketches; a group is a column of orders (Country, OrderDate, OrderYear)."""
    orders = materialize(_orders(retail).withColumn("OrderYear", F.year("OrderDate").cast("bigint")))
    # distinct pairs first: a hot group is spread over its customers
    customers = orders.groupBy(*groups, "CustomerID").agg(F.count("*").alias("n"))
    counted = customers.groupBy(*groups).agg(F.sum("n").alias("Orders"), F.count("*").alias("Customers"))
    middle = group_quantiles(orders, groups, "Cents", [0.5])
    return counted.join(
        middle.select(*groups, rounded(F.col("quantiles")[0] / 100, 2).alias("MedianOrderValue")), list(groups), "left"
    )


def period_sketches(retail: Retail, path: str | None = None) -> DataFrame:
    """Per country and year the exact figures, and whether those merged from the stored days agree: customers within CUSTOMERS_OFF, and
    the exact median between the values at the ranks RANK_OFF below and above a half. ``path`` keeps the stored days."""
    sketches = daily_sketches(retail)
    if path:
        store(sketches, path)
        days = stored(sketches.sparkSession, path)
    else:
        days = materialize(sketches)
    groups = ["Country", "OrderYear"]
    near = merged(days.withColumn("OrderYear", F.year("OrderDate").cast("bigint")), *groups)
    near = near.select(*groups, F.col("Customers").alias("Estimate"), "OrderValues")
    met = exact(retail, *groups).join(near, groups)
    off = F.abs(F.col("Estimate") - F.col("Customers")) <= F.col("Customers") * CUSTOMERS_OFF
    around = (F.kll_sketch_get_quantile_bigint("OrderValues", F.lit(0.5 + side)) for side in (-RANK_OFF, RANK_OFF))
    cents = F.round(F.col("MedianOrderValue") * 100).cast("bigint")
    return met.select(
        *groups,
        "Orders",
        "Customers",
        "MedianOrderValue",
        off.alias("CustomersAgree"),
        cents.between(*around).alias("MedianAgrees"),
    ).orderBy(*groups)
