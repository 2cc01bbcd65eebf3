"""Supply: stock risk, supplier portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.classify import first_match
from salesloom.functions.money import ratio, rounded, safe_pct
from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize
from salesloom.operators.ordering import Key, Spec, measure
from salesloom.plans.retail import Retail

# The stock classes
STOCK_OUT = "OUT OF STOCK"
STOCK_CRITICAL = "CRITICAL — No Reorder Placed"
STOCK_BELOW = "BELOW REORDER — Order Pending"
STOCK_LOW = "LOW — Monitor Closely"
STOCK_OK = "OK"


def stock_status(low_factor: float = 1.5) -> Column:
    stock, level = F.col("UnitsInStock"), F.col("ReorderLevel")
    below = stock < level
    return first_match(
        [
            (stock == 0, STOCK_OUT),
            (below & (F.col("UnitsOnOrder") == 0), STOCK_CRITICAL),
            (below, STOCK_BELOW),
            (stock < level * F.lit(low_factor), STOCK_LOW),
        ],
        STOCK_OK,
    )


def stock_risk(retail: Retail, low_factor: float = 1.5) -> DataFrame:
    """Stock position of every active product, lowest stock first.

    Stock has few distinct values, each shared by many products; the order cuts
    such a value along the tie-break keys.
    """
    suppliers = retail.suppliers().select(
        "SupplierID", F.col("CompanyName").alias("Supplier"), F.col("Country").alias("SupplierCountry")
    )
    base = materialize(
        retail.products()
        .filter(F.col("Discontinued") == 0)
        .join(retail.product_suppliers(), "ProductID")
        .join(suppliers, "SupplierID")
        .withColumn("StockStatus", stock_status(low_factor))
    )
    (order,) = measure(
        base, Spec(Key("UnitsInStock"), (Key("ReorderLevel", desc=True), Key("ProductID")))
    )
    return (
        order.arrange()
        .withColumns({"StockCumDist": order.cume_dist(), "StockPercentile": order.percent_rank()})
        .select(
            "Supplier",
            "SupplierCountry",
            "ProductName",
            "CategoryName",
            F.col("UnitPrice").cast("double").alias("UnitPrice"),
            "UnitsInStock",
            "UnitsOnOrder",
            "ReorderLevel",
            (F.col("UnitsInStock") - F.col("ReorderLevel")).alias("StockSurplusOrDeficit"),
            "StockStatus",
            "StockCumDist",
            "StockPercentile",
        )
    )


def supplier_portfolio(retail: Retail) -> DataFrame:
    """Products and stock per supplier, ranked by stock and by portfolio size."""
    portfolio = (
        retail.listed_products()
        .join(retail.product_suppliers(), "ProductID")
        .groupBy("SupplierID")
        .agg(
            F.count("*").alias("TotalProducts"),
            F.count_if(F.col("Discontinued") == 0).alias("ActiveProducts"),
            F.count_if(F.col("Discontinued") == 1).alias("DiscontinuedProducts"),
            F.sum("UnitPrice").alias("Prices"),
            F.count("UnitPrice").alias("Priced"),
            F.sum("UnitsInStock").alias("TotalUnitsInStock"),
            F.sum("UnitsOnOrder").alias("TotalUnitsOnOrder"),
        )
    )
    base = materialize(portfolio.join(retail.suppliers(), "SupplierID"))
    tie = (Key("SupplierID"),)
    (by_stock,) = measure(base, Spec(Key("TotalUnitsInStock", desc=True), tie), keys_only=True)
    ranks = by_stock.arrange().select("SupplierID", by_stock.rank().alias("StockRank"))
    countries = base.groupBy("Country").agg(F.sum("TotalUnitsInStock").alias("TotalStockByCountry"))
    ranked = base.join(broadcast_up_to(countries, countries.count()), "Country").join(ranks, "SupplierID")
    (by_size,) = measure(
        ranked, Spec(Key("TotalProducts", desc=True), (Key("ActiveProducts", desc=True), *tie)), rows=by_stock.rows
    )
    return (
        by_size.arrange()
        .withColumn("PortfolioSizeRank", by_size.rank())
        .select(
            "CompanyName",
            "Country",
            "ContactName",
            "TotalProducts",
            "ActiveProducts",
            "DiscontinuedProducts",
            rounded(ratio(F.col("Prices"), F.col("Priced")), 2).alias("AvgUnitPrice"),
            "TotalUnitsInStock",
            "TotalUnitsOnOrder",
            "StockRank",
            "PortfolioSizeRank",
            safe_pct(F.col("DiscontinuedProducts"), F.col("TotalProducts"), 0).alias(
                "DiscontinuedRatePct"
            ),
            "TotalStockByCountry",
        )
    )
