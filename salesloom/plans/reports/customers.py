"""Customers: concentration, segments, markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.functions.classify import first_match
from salesloom.functions.money import dec_round, money, ratio, rounded, safe_pct
from salesloom.operators.lookups import total
from salesloom.operators.ordering import Key, Spec, measure, tile_columns
from salesloom.plans.retail import Retail


def customer_pareto(retail: Retail, tiles: int = 5) -> DataFrame:
    """Revenue, share, rank, running share and revenue quintile per customer, best first."""
    base = retail.customer_base()
    grand_total = total(base, money(F.sum("NetU")))
    known = base.filter("Known")
    (order,) = measure(
        known, Spec(Key("Revenue", desc=True), (Key("CustomerID"),), sums=("Revenue",))
    )
    return (
        order.arrange()
        .withColumns(
            {
                "RevenueRank": order.rank(),
                "Running": order.running_sum("Revenue"),
                "Position": order.row_number(),
            }
        )
        .select(
            "CustomerID",
            "CompanyName",
            "Country",
            F.col("Orders").alias("TotalOrders"),
            F.col("Revenue").cast("double").alias("Revenue"),
            "FirstOrder",
            "LastOrder",
            F.datediff("LastOrder", "FirstOrder").cast("bigint").alias("CustomerLifespanDays"),
            rounded(ratio(F.col("Revenue"), F.col("Orders")), 2).alias("RevenuePerOrder"),
            safe_pct(F.col("Revenue"), grand_total, 2).alias("PctOfTotalRevenue"),
            "RevenueRank",
            safe_pct(F.col("Running"), grand_total, 1).alias("CumulativePct"),
            order.ntile(tiles, F.col("Position")).alias("RevenueQuintile"),
        )
    )


def at_risk_rule(variant: str) -> Column:
    """``reference``: bought lately but seldom, as the report has always had it.

    ``intended``: bought often but not lately, as its description says.
    """
    r, f = F.col("R_Score"), F.col("F_Score")
    rules = {"reference": (r <= 2) & (f >= 4), "intended": (r >= 4) & (f <= 2)}
    return rules[variant]


# Highest score total of a champion, a loyal and a potential customer
RFM_CUTS = (5, 8, 11)
# and the segments
CHAMPION = "Champion"
LOYAL = "Loyal"
AT_RISK = "At Risk"
POTENTIAL = "Potential"
OTHERS = "Needs Attention"


def rfm(
    base: DataFrame,
    recency: Key,
    frequency: Key,
    monetary: Key,
    customer: str,
    tiles: int = 5,
    cuts: tuple[int, int, int] = RFM_CUTS,
    at_risk: str = "reference",
) -> DataFrame:
    """``base`` (a written table) with R, F and M scores, their total and the segment.

    Each key sorts the best customers first; score 1 is the best. The three scores
    are cuts in three orders of the bare keys, so no wide row moves to get them.
    """
    tie = (Key(customer),)
    orders = measure(base, *(Spec(key, tie) for key in (recency, frequency, monetary)), keys_only=True)
    r, f, m = tile_columns(orders, tiles)
    score = F.col("RFM_Total")
    champion, loyal, potential = cuts
    segment = first_match(
        [
            (score <= champion, CHAMPION),
            (score <= loyal, LOYAL),
            (at_risk_rule(at_risk), AT_RISK),
            (score <= potential, POTENTIAL),
        ],
        OTHERS,
    )
    return (
        base.withColumns({"R_Score": r, "F_Score": f, "M_Score": m})
        .withColumn("RFM_Total", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))
        .withColumn("CustomerSegment", segment)
    )


def rfm_segments(
    retail: Retail,
    tiles: int = 5,
    cuts: tuple[int, int, int] = RFM_CUTS,
    at_risk: str = "reference",
) -> DataFrame:
    """Recency, frequency and monetary scores per customer and the segment they give."""
    base = retail.customer_base().filter("Known")
    latest = total(retail.orders(), F.max("OrderDate"))
    # days since the last order ascending is the last order descending
    scored = rfm(
        base,
        Key("LastOrder", desc=True),
        Key("Orders", desc=True),
        Key("Revenue", desc=True),
        "CustomerID",
        tiles,
        cuts,
        at_risk,
    )
    return scored.select(
        "CustomerID",
        "CompanyName",
        "Country",
        F.datediff(latest, "LastOrder").cast("bigint").alias("DaysSinceLastOrder"),
        F.col("Orders").alias("Frequency"),
        F.col("Revenue").cast("double").alias("Monetary"),
        "R_Score",
        "F_Score",
        "M_Score",
        "RFM_Total",
        "CustomerSegment",
    ).orderBy("RFM_Total", "CustomerID")


def country_quality(retail: Retail, against_mean: bool = False) -> DataFrame:
    """Customers, orders and revenue per country, ranked by revenue and by revenue per customer.

    The windows run over one row per country. ``against_mean`` adds the revenue per customer of all countries together, and
    the country's in percent of it.
    """
    customers = (
        retail.order_book("inner")
        .groupBy("CustomerID")
        .agg(F.count("*").alias("Orders"), F.sum("NetU").alias("NetU"))
        .join(retail.customers(), "CustomerID")
    )
    countries = customers.groupBy("Country").agg(
        F.count("*").alias("Customers"),
        F.sum("Orders").alias("Orders"),
        dec_round(money(F.sum("NetU")), 2).alias("Revenue"),
    )
    per_customer = ratio(F.col("Revenue"), F.col("Customers"))
    everything = W.partitionBy()
    mean = ratio(F.sum("Revenue").over(everything), F.sum("Customers").over(everything))
    compared = [
        rounded(F.col("Mean"), 2).alias("OverallRevenuePerCustomer"),
        safe_pct(F.col("Quality"), F.col("Mean"), 1).alias("PctOfOverall"),
    ]
    running = (
        W.partitionBy()
        .orderBy(F.desc("Revenue"), "Country")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        countries.withColumns(
            {
                "Quality": per_customer,
                "All": F.sum("Revenue").over(everything),
                "Mean": mean,
                "Running": F.sum("Revenue").over(running),
                "RevenueRank": F.rank().over(W.orderBy(F.desc("Revenue"))),
            }
        )
        .withColumn("QualityRank", F.rank().over(W.orderBy(F.desc("Quality"))))
        .orderBy("RevenueRank", "Country")
        .select(
            "Country",
            "Customers",
            "Orders",
            F.col("Revenue").cast("double").alias("Revenue"),
            rounded(F.col("Quality"), 2).alias("RevenuePerCustomer"),
            rounded(ratio(F.col("Revenue"), F.col("Orders")), 2).alias("RevenuePerOrder"),
            F.col("RevenueRank").cast("bigint").alias("RevenueRank"),
            F.col("QualityRank").cast("bigint").alias("QualityRank"),
            safe_pct(F.col("Revenue"), F.col("All"), 1).alias("PctOfTotal"),
            safe_pct(F.col("Running"), F.col("All"), 1).alias("CumulativePct"),
            *(compared if against_mean else []),
        )
    )
