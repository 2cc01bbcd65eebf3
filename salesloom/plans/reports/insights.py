"""Further figures the business questions quote: pivots, medians, shares, run rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.functions.money import dec_round, money, ratio, rounded, safe_pct
from salesloom.operators.growth import growth
from salesloom.operators.lookups import total
from salesloom.operators.materialize import materialize
from salesloom.operators.ordering import Key, Spec, measure, quantiles
from salesloom.operators.windows import global_row_number
from salesloom.plans.reports.employees import employee_figures, tenures
from salesloom.plans.reports.shipping import ORDER_SIZES, late, shipped, sized_orders
from salesloom.plans.reports.supply import STOCK_OK, stock_status
from salesloom.plans.retail import Retail

MAX_PIVOT_COLUMNS = 1000
NO_LABEL = "(none)"


def monthly_sales(retail: Retail) -> DataFrame:
    """Monthly revenue per employee, a row for each: the report behind the pivot, for any number of employees."""
    return (
        retail.employee_sales()
        .groupBy("EmployeeID", F.trunc("OrderDate", "month").alias("Month"))
        .agg(F.sum("NetU").alias("NetU"))
        .join(retail.employees(), "EmployeeID")
        .orderBy("Month", "EmployeeID")
        .select("Month", "EmployeeID", "EmployeeName", rounded(money(F.col("NetU")), 2).alias("Revenue"))
    )


def _labelled(staff: DataFrame, column: str) -> DataFrame:
    """Employees with a label each: those who share a name, or have none, get their id beside it."""
    if column != "EmployeeName":
        return staff.withColumn(column, F.coalesce(column, F.lit(NO_LABEL)))
    number = F.concat(F.lit("("), F.col("EmployeeID").cast("string"), F.lit(")"))
    shared = F.count("*").over(W.partitionBy(column)) > 1
    return staff.withColumn(
        column, F.when(shared, F.concat_ws(" ", column, number)).otherwise(F.coalesce(column, number))
    )


def monthly_pivot(
    retail: Retail, column: str = "EmployeeName", values: DataFrame | None = None
) -> DataFrame:
    """Monthly revenue with one column per employee, or per value of another employee column.

    The columns come from ``values`` (default: the employees), read when the report
    is built; more than MAX_PIVOT_COLUMNS of them is an error, never a cut: ``pivot_blocks`` has no limit.
    """
    staff = _labelled(retail.employees(), column)
    source = staff.select(column) if values is None else values.select(F.coalesce(column, F.lit(NO_LABEL)))
    labels = sorted(r[0] for r in source.distinct().limit(MAX_PIVOT_COLUMNS + 1).collect())
    if len(labels) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"more than {MAX_PIVOT_COLUMNS} values of {column}: pivot a coarser column")
    sales = _sales_by(retail, staff.select("EmployeeID", column), column)
    return sales.groupBy("Month").pivot(column, labels).agg(F.first("Revenue")).orderBy("Month")


def _sales_by(retail: Retail, staff: DataFrame, *keys: str) -> DataFrame:
    """Month, ``keys`` and Revenue; ``staff`` has EmployeeID and the keys."""
    return (
        retail.employee_sales()
        .groupBy("EmployeeID", F.trunc("OrderDate", "month").alias("Month"))
        .agg(F.sum("NetU").alias("NetU"))
        .join(staff, "EmployeeID")
        .groupBy("Month", *keys)
        .agg(rounded(money(F.sum("NetU")), 2).alias("Revenue"))
    )


@dataclass(frozen=True)
class PivotBlocks:
    """A pivot cut into blocks of columns: ``figures`` (Month, Block, C0, C1, ...) and ``manifest`` (Block, Place, label)."""

    manifest: DataFrame
    figures: DataFrame


def pivot_blocks(
    retail: Retail, column: str = "EmployeeName", values: DataFrame | None = None, width: int = MAX_PIVOT_COLUMNS
) -> PivotBlocks:
    """``monthly_pivot`` for any number of labels: they are numbered in their order and dealt into blocks of ``width``
    columns. A row holds a month of one block, so its size is bounded; the sales are read once, and no label reaches the driver.
    A month has a row for each block in which something was sold. The places of the last block that no label has are null.
    """
    staff = _labelled(retail.employees(), column)
    source = staff.select(column) if values is None else values.select(F.coalesce(column, F.lit(NO_LABEL)).alias(column))
    number = F.col("row_number") - 1
    manifest = materialize(
        global_row_number(source.distinct(), column, ()).select(
            F.floor(number / width).cast("bigint").alias("Block"), (number % width).cast("int").alias("Place"), column
        )
    )
    placed = staff.select("EmployeeID", column).join(manifest, column).drop(column)
    sales = _sales_by(retail, placed, "Block", "Place")
    figures = sales.groupBy("Month", "Block").pivot("Place", list(range(width))).agg(F.first("Revenue"))
    named = [F.col(f"`{i}`").alias(f"C{i}") for i in range(width)]
    return PivotBlocks(manifest, figures.orderBy("Month", "Block").select("Month", "Block", *named))


def monthly_pivot_blocks(retail: Retail, width: int = 10) -> DataFrame:
    """The figures of ``pivot_blocks`` by employee."""
    return pivot_blocks(retail, width=width).figures


def median_order_value(retail: Retail, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Mean and quartiles of the order value. ``exact=False``: one pass, within 1/accuracy."""
    values = retail.order_totals().select(
        "OrderID", dec_round(money(F.col("NetU")), 2).alias("OrderValue")
    )
    spots = [0.25, 0.5, 0.75]
    names = ["LowerQuartile", "MedianOrderValue", "UpperQuartile"]
    figures = [
        F.count("*").alias("Orders"),
        rounded(ratio(F.sum("OrderValue"), F.count("*")), 2).alias("MeanOrderValue"),
        F.max("OrderValue").cast("double").alias("MaxOrderValue"),
    ]
    if not exact:
        approx = F.percentile_approx("OrderValue", spots, accuracy).alias("q")
        return values.agg(*figures, approx).select(
            "Orders",
            "MeanOrderValue",
            "MaxOrderValue",
            *(rounded(F.col("q")[i], 2).alias(n) for i, n in enumerate(names)),
        )
    values = materialize(values)
    (order,) = measure(values, Spec(Key("OrderValue"), (Key("OrderID"),)))
    found = quantiles(order, spots)
    return values.agg(*figures).select(
        "Orders",
        "MeanOrderValue",
        "MaxOrderValue",
        *(rounded(F.lit(q).cast("double"), 2).alias(n) for q, n in zip(found, names)),
    )


def category_quarters(retail: Retail) -> DataFrame:
    """Revenue per category and quarter, the next quarter's, and the dense rank in the quarter."""
    quarters = retail.orders().select(
        "OrderID", F.trunc("OrderDate", "quarter").alias("QuarterStart")
    )
    revenue = (
        retail.lines()
        .join(quarters, "OrderID")
        .groupBy("ProductID", "QuarterStart")
        .agg(F.sum("NetU").alias("NetU"))
        .join(retail.products().select("ProductID", "CategoryName"), "ProductID")
        .groupBy("CategoryName", "QuarterStart")
        .agg(dec_round(money(F.sum("NetU")), 2).alias("Revenue"))
    )
    following = F.lead("Revenue").over(W.partitionBy("CategoryName").orderBy("QuarterStart"))
    rank = F.dense_rank().over(W.partitionBy("QuarterStart").orderBy(F.desc("Revenue")))
    return revenue.select(
        "CategoryName",
        "QuarterStart",
        F.col("Revenue").cast("double").alias("Revenue"),
        following.cast("double").alias("NextQuarterRevenue"),
        rank.cast("bigint").alias("DenseRankInQuarter"),
    ).orderBy("CategoryName", "QuarterStart")


def product_dense_rank(retail: Retail) -> DataFrame:
    """Products by units sold: dense rank in the category and overall."""
    known = retail.product_base().filter("Known")
    tie = (Key("ProductID"),)
    (in_category,) = measure(
        known, Spec(Key("Units", desc=True), tie, within=("CategoryName",), dense=True), keys_only=True
    )
    ranks = in_category.arrange().select("ProductID", in_category.dense_rank().alias("DenseRankInCategory"))
    (overall,) = measure(
        known.join(ranks, "ProductID"), Spec(Key("Units", desc=True), tie, dense=True), rows=in_category.rows
    )
    return (
        overall.arrange()
        .withColumn("DenseRank", overall.dense_rank())
        .select(
            "CategoryName",
            "ProductName",
            F.col("Units").alias("TotalUnitsSold"),
            "DenseRankInCategory",
            "DenseRank",
        )
    )


def _top_shares(base: DataFrame, entity: str, key: str, sizes: Sequence[int]) -> DataFrame:
    """Top-k keeps k rows per task; everything after it works on max(sizes) rows."""
    everything = total(base, money(F.sum("NetU")))
    best = base.filter("Known").orderBy(F.desc("Revenue"), key).limit(max(sizes))
    numbered = best.withColumn("n", F.row_number().over(W.orderBy(F.desc("Revenue"), key)))
    return (
        numbered.withColumn("TopN", F.explode(F.array(*(F.lit(k).cast("bigint") for k in sizes))))
        .filter(F.col("n") <= F.col("TopN"))
        .groupBy("TopN")
        .agg(F.sum("Revenue").alias("Revenue"))
        .select(
            F.lit(entity).alias("Entity"),
            "TopN",
            F.col("Revenue").cast("double").alias("Revenue"),
            safe_pct(F.col("Revenue"), everything, 1).alias("SharePct"),
        )
    )


def top_n_share(retail: Retail, sizes: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Share of revenue held by the best few products and customers."""
    products = _top_shares(retail.product_base(), "Product", "ProductID", sizes)
    customers = _top_shares(retail.customer_base(), "Customer", "CustomerID", sizes)
    return products.unionByName(customers).orderBy("Entity", "TopN")


def reorder_gap(retail: Retail) -> DataFrame:
    """Days between consecutive orders of a customer.

    Orders shrink to customer and day first, so the window sees at most one row per
    calendar day of a customer; n orders on a day are n - 1 gaps of zero days. The
    percentile runs over one weighted row per gap length.
    """
    days = (
        retail.orders()
        .filter(F.col("CustomerID").isNotNull() & F.col("OrderDate").isNotNull())
        .groupBy("CustomerID", "OrderDate")
        .agg(F.count("*").alias("n"))
    )
    prev = F.lag("OrderDate").over(W.partitionBy("CustomerID").orderBy("OrderDate"))
    gaps = (
        days.select(
            F.array(
                F.struct(F.datediff("OrderDate", prev).alias("gap"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("w")),
            ).alias("gaps")
        )
        .select(F.inline("gaps"))
        .filter(F.col("gap").isNotNull() & (F.col("w") > 0))
        .groupBy("gap")
        .agg(F.sum("w").alias("w"))
    )
    quartiles = F.percentile("gap", [0.25, 0.5, 0.75], F.col("w"))
    return gaps.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("Gaps"),
        rounded(ratio(F.sum(F.col("gap") * F.col("w")), F.sum("w")), 2).alias("MeanGapDays"),
        F.max("gap").cast("bigint").alias("MaxGapDays"),
        quartiles.alias("q"),
    ).select(
        "Gaps",
        "MeanGapDays",
        "MaxGapDays",
        F.col("q")[0].alias("LowerQuartileDays"),
        F.col("q")[1].alias("MedianGapDays"),
        F.col("q")[2].alias("UpperQuartileDays"),
    )


def one_time_customers(retail: Retail) -> DataFrame:
    """How many customers never ordered, ordered once, ordered at all."""
    orders = retail.orders().groupBy("CustomerID").agg(F.count("*").alias("Orders"))
    return (
        retail.customers()
        .join(orders, "CustomerID", "left")
        .agg(
            F.count("*").alias("Customers"),
            F.count("Orders").alias("OrderingCustomers"),
            F.count_if(F.col("Orders").isNull()).alias("NeverOrdered"),
            F.count_if(F.col("Orders") == 1).alias("OneTimeCustomers"),
            safe_pct(F.count_if(F.col("Orders") == 1), F.count("Orders"), 1).alias("OneTimePct"),
        )
    )


def monthly_run_rate(retail: Retail, first_month: int = 1, last_month: int = 12) -> DataFrame:
    """Average revenue per month in each year, and the change on the year before."""
    months = (
        retail.order_book("inner")
        .filter(F.month("OrderDate").between(first_month, last_month))
        .groupBy(F.trunc("OrderDate", "month").alias("Month"))
        .agg(F.sum("NetU").alias("NetU"))
    )
    years = (
        months.groupBy(F.year("Month").cast("bigint").alias("OrderYear"))
        .agg(F.count("*").alias("Months"), money(F.sum("NetU")).alias("Revenue"))
        .withColumn("AvgMonthlyRevenue", dec_round(ratio(F.col("Revenue"), F.col("Months")), 2))
    )
    prev, change = growth("AvgMonthlyRevenue", ["OrderYear"])
    return years.select(
        "OrderYear",
        "Months",
        rounded(F.col("Revenue"), 2).alias("Revenue"),
        F.col("AvgMonthlyRevenue").cast("double").alias("AvgMonthlyRevenue"),
        prev.cast("double").alias("PrevAvgMonthlyRevenue"),
        change.alias("ChangePct"),
    ).orderBy("OrderYear")


def recent_demand(retail: Retail, months: int = 3, low_factor: float = 1.5) -> DataFrame:
    """Units sold lately of every active product whose stock is not OK, most demanded first."""
    # one value, fetched first: as a literal the bound reaches the scan
    latest = retail.orders().agg(F.add_months(F.max("OrderDate"), -months)).first()[0]
    recent = retail.orders_after(latest).select("OrderID")
    demand = (
        retail.lines()
        .join(recent, "OrderID")
        .groupBy("ProductID")
        .agg(F.sum("Quantity").alias("RecentUnits"))
    )
    at_risk = (
        retail.products()
        .filter(F.col("Discontinued") == 0)
        .withColumn("StockStatus", stock_status(low_factor))
        .filter(F.col("StockStatus") != STOCK_OK)
    )
    return (
        at_risk.join(demand, "ProductID", "left")
        .withColumn("RecentUnits", F.coalesce("RecentUnits", F.lit(0)))
        .orderBy(F.desc("RecentUnits"), "ProductID")
        .select(
            "ProductName", "StockStatus", "UnitsInStock", "UnitsOnOrder", "ReorderLevel", "RecentUnits"
        )
    )


def late_rate_by_size(
    retail: Retail,
    sizes: Sequence[tuple[float, str]] = ORDER_SIZES,
    freight_share: float = 0.2,
) -> DataFrame:
    """Late rate per order size and orders whose freight exceeds a share of their value."""
    high = F.col("Freight") > F.col("OrderRevenue") * F.lit(Decimal(str(freight_share)))
    return (
        sized_orders(retail, sizes)
        .groupBy("OrderSizeCategory")
        .agg(
            F.count("*").alias("Orders"),
            F.count_if(shipped()).alias("ShippedOrders"),
            F.count_if(late()).alias("LateOrders"),
            F.count_if(high).alias("HighFreightOrders"),
        )
        .withColumn("LatePct", safe_pct(F.col("LateOrders"), F.col("ShippedOrders"), 1))
        .orderBy("OrderSizeCategory")
    )


def revenue_per_territory(retail: Retail) -> DataFrame:
    """Revenue of an employee over the territories covered, best first."""
    covered = retail.coverage().groupBy("EmployeeID").agg(F.count("*").alias("Territories"))
    return (
        employee_figures(retail)
        .join(covered, "EmployeeID")
        .withColumn(
            "RevenuePerTerritory", rounded(ratio(F.col("TotalRevenue"), F.col("Territories")), 2)
        )
        .orderBy(F.desc("RevenuePerTerritory"), "EmployeeID")
        .select(
            "EmployeeName",
            F.col("TotalRevenue").cast("double").alias("TotalRevenue"),
            "Territories",
            "RevenuePerTerritory",
        )
    )


def discounted_lines(retail: Retail) -> DataFrame:
    """Lines with and without a discount: share, mean quantity and largest discount. A line whose discount is unknown
    counts as one without."""
    kinds = (
        retail.lines()
        .groupBy(F.when(F.col("DiscountBp") > 0, "Discounted").otherwise("Undiscounted").alias("LineKind"))
        .agg(
            F.count("*").alias("Lines"),
            F.sum("Quantity").alias("Units"),
            F.count("Quantity").alias("Counted"),
            F.max("DiscountBp").alias("Highest"),
        )
    )
    return kinds.select(
        "LineKind",
        "Lines",
        safe_pct(F.col("Lines"), F.sum("Lines").over(W.partitionBy()), 1).alias("SharePct"),
        rounded(ratio(F.col("Units"), F.col("Counted")), 2).alias("AvgQuantity"),
        rounded(F.col("Highest") / 100, 2).alias("MaxDiscountPct"),
    ).orderBy("LineKind")


def discount_revenue_correlation(retail: Retail) -> DataFrame:
    """Correlation, over the employees, of the mean discount given with the revenue earned, and of their ranks (Spearman; employees
    with equal figures share the mean of their ranks). Null if either is constant."""
    figures = materialize(
        employee_figures(retail).select(
            "EmployeeID", F.col("AvgDiscountPct").alias("Discount"), F.col("TotalRevenue").alias("Revenue")
        )
    )
    return _employees_correlated(figures, "Discount", "Revenue")


def tenure_correlation(retail: Retail) -> DataFrame:
    """Correlation, over the employees who sold, of days since they were hired with the revenue earned, and of their ranks. One
    without a hire date counts as an employee only."""
    figures = materialize(
        tenures(retail).select("EmployeeID", F.col("TenureDays").alias("Tenure"), F.col("TotalRevenue").alias("Revenue"))
    )
    return _employees_correlated(figures, "Tenure", "Revenue")


def _employees_correlated(figures: DataFrame, one: str, two: str) -> DataFrame:
    by_amount = figures.agg(
        F.count("*").alias("Employees"),
        # not F.corr, which divides by zero if a column is constant
        F.round(_correlation(F.col(one).cast("double"), F.col(two).cast("double")), 3).alias("Correlation"),
    )
    by_rank = rank_correlation(figures, "EmployeeID", one, two)
    return by_amount.withColumn("RankCorrelation", by_rank.scalar())


def _correlation(one: Column, two: Column) -> Column:
    both = one.isNotNull() & two.isNotNull()
    one, two = F.when(both, one), F.when(both, two)
    return ratio(F.covar_pop(one, two), F.stddev_pop(one) * F.stddev_pop(two))


def rank_correlation(figures: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """RankCorrelation, one row: Spearman's coefficient of two columns over the rows that have both. Ranks are doubled, so that means of
    peers are whole and all sums exact."""
    held = materialize(figures.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select(key, one, two))
    (by_one,) = measure(held, Spec(Key(one), (Key(key),)))
    ranked = by_one.arrange().select(key, two, (by_one.rank() + by_one.last_peer()).alias("first"))
    (by_two,) = measure(materialize(ranked), Spec(Key(two), (Key(key),)), rows=by_one.rows)
    ranks = by_two.arrange().select("first", (by_two.rank() + by_two.last_peer()).alias("second"))
    # both columns of ranks have the mean rows + 1
    apart = {c: (F.col(c) - (by_one.rows + 1)).cast("decimal(19,0)") for c in ("first", "second")}
    sums = ranks.agg(
        F.sum(apart["first"] * apart["second"]).cast("double").alias("both"),
        F.sum(apart["first"] * apart["first"]).cast("double").alias("one"),
        F.sum(apart["second"] * apart["second"]).cast("double").alias("two"),
    )
    return sums.select(F.round(F.try_divide("both", F.sqrt("one") * F.sqrt("two")), 3).alias("RankCorrelation"))
