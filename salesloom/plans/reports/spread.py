"""How figures are spread: quantiles per group, and how few bring most of the revenue. Nothing is sorted as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dec_round, money, rounded, safe_pct
from salesloom.operators.materialize import materialize
from salesloom.operators.selection import _met, group_quantiles, nth_smallest, weighted_cuts
from salesloom.plans.retail import Retail

QUARTILES = {"LowerQuartile": 0.25, "MedianOrderValue": 0.5, "UpperQuartile": 0.75}


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def order_value_quantiles(retail: Retail, fractions: dict[str, float] = QUARTILES) -> DataFrame:
    """Exact quantiles of the order value per customer country and year: a column for each of ``fractions``. Orders without a priced line
    are left out; an order without a date is in the year null."""
    orders = (
        retail.order_book("inner")
        .join(retail.customers().select("CustomerID", "Country"), "CustomerID")
        .select(
            "Country",
            F.year("OrderDate").cast("bigint").alias("OrderYear"),
            _cents(dec_round(money(F.col("NetU")), 2)).alias("Cents"),
        )
    )
    found = group_quantiles(orders, ["Country", "OrderYear"], "Cents", list(fractions.values()))
    return found.select(
        "Country",
        "OrderYear",
        F.col("rows").alias("Orders"),
        *(rounded(F.col("quantiles")[i] / 100, 2).alias(name) for i, name in enumerate(fractions)),
    ).orderBy("Country", "OrderYear")


def _earners(base: DataFrame, entity: str, key: str) -> DataFrame:
    earning = base.where(F.col("Known") & (F.col("Revenue") > 0))
    return earning.select(F.lit(entity).alias("Entity"), F.col(key).alias("id"), (-_cents(F.col("Revenue"))).alias("key"), F.col("Revenue").alias("weight"))


def pareto_cut(retail: Retail, targets: Sequence[float] = (50, 80, 95)) -> DataFrame:
    """The fewest products, and the fewest customers, whose revenue together reaches each target (per cent of the revenue of all lines).

    Best first, equal revenue in order of the key: ``LastKey`` is the last one needed. A target that all together do not reach
    has null figures. Only those who earned something count.
    """
    parts = []
    for entity, key, base in (("Product", "ProductID", retail.product_base()), ("Customer", "CustomerID", retail.customer_base())):
        earners = materialize(_earners(base, entity, key))
        all_lines = base.agg(F.sum("NetU").alias("NetU")).select(money(F.col("NetU")).alias("Total"))
        asked = F.array(*(F.struct(F.lit(i).alias("spot"), F.lit(float(t)).cast("decimal(9,4)").alias("TargetPct")) for i, t in enumerate(targets)))
        wanted = all_lines.select(F.lit(entity).alias("Entity"), "Total", F.inline(asked))
        # the least amount in whole millionths that is the target's share or more
        share = F.ceil(F.col("Total") * F.col("TargetPct") * F.lit(10_000)).cast("decimal(38,6)") / F.lit(1_000_000)
        wanted = materialize(wanted.withColumn("amount", share.cast("decimal(38,6)")))
        cuts = weighted_cuts(earners.select("Entity", "key", "weight"), ["Entity"], wanted.select("Entity", "spot", "amount"))
        met = _met(wanted, cuts, ["Entity", "spot"])
        each = (-F.col("key") / 100).cast("decimal(28,2)")
        ties = F.ceil((F.col("amount") - F.col("below")) / each).cast("bigint")
        met = materialize(met.withColumns({"each": each, "ties": ties}))
        peers = _met(earners.select("Entity", "key", "id"), F.broadcast(met.select("Entity", "key", "spot")), ["Entity", "key"])  # a row a target
        grouped = peers.select(F.concat_ws(" ", "Entity", "spot").alias("of"), "id")
        last = nth_smallest(materialize(grouped), ["of"], met.select(F.concat_ws(" ", "Entity", "spot").alias("of"), "spot", F.col("ties").alias("amount")))
        counts = earners.groupBy("Entity").agg(F.count("*").alias("AllMembers"))
        full = wanted.select("Entity", "spot", "TargetPct", "Total").join(met.select("Entity", "spot", "below", "rows_below", "each", "ties"), ["Entity", "spot"], "left")
        full = full.join(counts, "Entity").join(last.select("spot", F.col("id").cast("string").alias("LastKey")), "spot", "left")
        members, revenue = F.col("rows_below") + F.col("ties"), F.col("below") + F.col("ties") * F.col("each")
        parts.append(
            full.select(
                "Entity",
                F.col("TargetPct").cast("double").alias("TargetPct"),
                members.alias("Members"),
                "AllMembers",
                safe_pct(members, F.col("AllMembers"), 1).alias("MembersPct"),
                rounded(revenue, 2).alias("Revenue"),
                safe_pct(revenue, F.col("Total"), 1).alias("SharePct"),
                F.col("each").cast("double").alias("SmallestRevenue"),
                "LastKey",
            )
        )
    return parts[0].unionByName(parts[1]).orderBy("Entity", "TargetPct")
