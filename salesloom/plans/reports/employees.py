"""Employees: scorecard, territory coverage, founders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.classify import first_match
from salesloom.functions.firsts import earliest
from salesloom.functions.money import dec_round, money, ratio
from salesloom.operators.lookups import broadcast_up_to, total
from salesloom.operators.materialize import materialize
from salesloom.operators.ordering import Key, Spec, measure, quantiles
from salesloom.plans.retail import Retail


# The performance tiers and discount flags
TIER_TOP = "Top Performer"
TIER_HIGH = "High Performer"
TIER_LOW = "Needs Coaching"
TIER_OTHER = "Average"
FLAG_REVIEW = "REVIEW: High Discount + Low Revenue"
FLAG_MONITOR = "Monitor: High Discount Usage"
FLAG_NONE = "OK"


def employee_figures(retail: Retail) -> DataFrame:
    """One row per employee who sold."""
    return retail.employee_totals().join(retail.employees(), "EmployeeID").select(
        "EmployeeID",
        "EmployeeName",
        "Title",
        "TotalOrders",
        "TotalUnitsSold",
        dec_round(money(F.col("NetU")), 2).alias("TotalRevenue"),
        dec_round(ratio(F.col("DiscountBp"), F.col("Rated")) / 100, 2).alias("AvgDiscountPct"),
        dec_round(ratio(money(F.col("NetU")), F.col("TotalOrders")), 2).alias("RevenuePerOrder"),
    )


def agent_scorecard(
    retail: Retail,
    high_discount: float = 6.0,
    high_quantile: float = 0.75,
    low_quantile: float = 0.25,
) -> DataFrame:
    """Sales, discount and efficiency ranks per employee, with a tier and a discount flag."""
    base = materialize(employee_figures(retail))
    tie = (Key("EmployeeID"),)
    discount, efficiency = measure(
        base,
        Spec(Key("AvgDiscountPct", desc=True), tie),
        Spec(Key("RevenuePerOrder", desc=True), tie),
        keys_only=True,
    )
    discounts = discount.arrange().select("EmployeeID", discount.rank().alias("DiscountRank"))
    efficiencies = efficiency.arrange().select("EmployeeID", efficiency.rank().alias("EfficiencyRank"))
    (revenue,) = measure(
        base.join(discounts, "EmployeeID").join(efficiencies, "EmployeeID"),
        Spec(Key("TotalRevenue", desc=True), tie),
        rows=discount.rows,
    )
    low, high, top = quantiles(revenue, [low_quantile, high_quantile, 1.0])
    mean = base.agg(ratio(F.sum("TotalRevenue"), F.count("TotalRevenue")).alias("mean")).scalar()
    ranked = revenue.arrange().withColumn("RevenueRank", revenue.rank())
    earned = F.col("TotalRevenue").cast("double")
    generous = F.col("AvgDiscountPct").cast("double") > high_discount
    return ranked.select(
        "EmployeeName",
        "Title",
        "TotalOrders",
        "TotalUnitsSold",
        earned.alias("TotalRevenue"),
        F.col("AvgDiscountPct").cast("double").alias("AvgDiscountPct"),
        F.col("RevenuePerOrder").cast("double").alias("RevenuePerOrder"),
        "RevenueRank",
        "DiscountRank",
        "EfficiencyRank",
        first_match(
            [
                (earned == F.lit(top), TIER_TOP),
                (earned >= F.lit(high), TIER_HIGH),
                (earned <= F.lit(low), TIER_LOW),
            ],
            TIER_OTHER,
        ).alias("PerformanceTier"),
        first_match(
            [
                (generous & (earned < mean), FLAG_REVIEW),
                (generous, FLAG_MONITOR),
            ],
            FLAG_NONE,
        ).alias("DiscountFlag"),
    )


def _region_hires(retail: Retail) -> DataFrame:
    """Territories and hire date per employee and region."""
    return (
        retail.coverage()
        .groupBy("EmployeeID", "RegionID", "Region")
        .agg(F.count("TerritoryID").alias("TerritoryCount"))
        .join(retail.hire_dates(), "EmployeeID")
    )


def territory_coverage(retail: Retail) -> DataFrame:
    """Territories per employee and region, and the earliest hire in that region."""
    base = materialize(_region_hires(retail).join(retail.employees(), "EmployeeID"))
    # a missing date comes first, as in an ascending order that begins with nulls
    unknown = F.count_if(F.col("HireDate").isNull()) > 0
    first_hires = base.groupBy("RegionID").agg(
        F.when(~unknown, F.min("HireDate")).alias("EarliestHireInRegion")
    )
    with_first = base.join(broadcast_up_to(first_hires, retail.region_count()), "RegionID")
    (order,) = measure(
        with_first, Spec(Key("TerritoryCount", desc=True), (Key("EmployeeID"), Key("RegionID"))), rows=base.count()
    )
    return (
        order.arrange()
        .withColumn("TerritoryRank", order.rank())
        .select(
            "EmployeeID",
            "EmployeeName",
            "Title",
            "TerritoryCount",
            F.col("Region").alias("PrimaryRegion"),
            "TerritoryRank",
            "EarliestHireInRegion",
        )
    )


def region_founder(retail: Retail) -> DataFrame:
    """The first employee hired in each region: the lowest id on a shared day; one without a date comes before all,
    so that every region with employees has a row."""
    hires = earliest(_region_hires(retail), ["RegionID", "Region"], "HireDate", "EmployeeID", nulls_first=True)
    first = hires.select(F.col("Region").alias("RegionDescription"), "EmployeeID", "HireDate")
    return (
        broadcast_up_to(first, retail.region_count())
        .join(retail.employees(), "EmployeeID")
        .select(
            "RegionDescription",
            F.col("EmployeeName").alias("FoundingEmployee"),
            "Title",
            "HireDate",
        )
        .orderBy("RegionDescription")
    )


def tenures(retail: Retail) -> DataFrame:
    """Employees who sold, with HireDate and TenureDays: the days from it to the latest order, null without a hire date."""
    latest = total(retail.orders(), F.max("OrderDate"))
    return (
        employee_figures(retail)
        .join(retail.hire_dates(), "EmployeeID", "left")
        .withColumn("TenureDays", F.datediff(latest, "HireDate").cast("bigint"))
    )


def tenure_revenue(retail: Retail) -> DataFrame:
    """Tenure as of the latest order beside revenue, and the rank of each; an unknown tenure ranks last."""
    base = materialize(tenures(retail))
    tie = (Key("EmployeeID"),)
    (tenure,) = measure(base, Spec(Key("TenureDays", desc=True), tie), keys_only=True)
    ranks = tenure.arrange().select("EmployeeID", tenure.rank().alias("TenureRank"))
    (revenue,) = measure(base.join(ranks, "EmployeeID"), Spec(Key("TotalRevenue", desc=True), tie), rows=tenure.rows)
    earned = F.col("TotalRevenue").cast("double")
    return revenue.arrange().select(
        "EmployeeID",
        "EmployeeName",
        "HireDate",
        "TenureDays",
        earned.alias("TotalRevenue"),
        "TenureRank",
        revenue.rank().alias("RevenueRank"),
    )
