"""Report names, and each report over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from salesloom.plans.audit import reference_audit
from salesloom.plans.reimport import import_outcomes
from salesloom.plans.reports import customers, employees, insights, kpi, revenue, shipping, sketched, spread, supply
from salesloom.plans.retail import Retail, StarRetail
from salesloom.plans.stored import stored_trend

REPORTS: dict[str, Callable[..., DataFrame]] = {
    "kpi_snapshot": kpi.kpi_snapshot,
    "q1_category_yoy": revenue.category_yoy,
    "q2_product_pareto": revenue.product_pareto,
    "q3_discount_depth": revenue.discount_depth,
    "q4_quarterly_trend": revenue.quarterly_trend,
    "q5_agent_scorecard": employees.agent_scorecard,
    "q6_territory_coverage": employees.territory_coverage,
    "q7_region_founder": employees.region_founder,
    "q8_customer_pareto": customers.customer_pareto,
    "q9_rfm_segments": customers.rfm_segments,
    "q10_country_quality": customers.country_quality,
    "q11_stock_risk": supply.stock_risk,
    "q12_supplier_portfolio": supply.supplier_portfolio,
    "q13_carrier_sla": shipping.carrier_sla,
    "q14_order_size_delivery": shipping.order_size_delivery,
    "x1_month_agent_pivot": insights.monthly_pivot,
    "x1_monthly_sales": insights.monthly_sales,
    "x2_median_order_value": insights.median_order_value,
    "x3_dense_rank_lead": insights.category_quarters,
    "x3_product_dense_rank": insights.product_dense_rank,
    "x4_top_n_share": insights.top_n_share,
    "x5_reorder_gap": insights.reorder_gap,
    "x6_one_time_customers": insights.one_time_customers,
    "x7_monthly_run_rate": insights.monthly_run_rate,
    "x8_recent_demand": insights.recent_demand,
    "x9_late_rate_by_size": insights.late_rate_by_size,
    "x10_revenue_per_territory": insights.revenue_per_territory,
    "x11_discounted_lines": insights.discounted_lines,
    "x12_discount_revenue": insights.discount_revenue_correlation,
    "x13_group_quantiles": spread.order_value_quantiles,
    "x14_pareto_cut": spread.pareto_cut,
    "x15_customer_quarters": revenue.customer_quarters,
    "x15_filled_category_years": partial(revenue.category_yoy, fill=True),
    "x16_period_sketches": sketched.period_sketches,
    "x17_refreshed_trend": revenue.refreshed_trend,
    "x18_reference_audit": reference_audit,
    "x19_import_outcomes": import_outcomes,
    "x20_pivot_blocks": insights.monthly_pivot_blocks,
    "x21_tenure_revenue": employees.tenure_revenue,
    "x22_tenure_correlation": insights.tenure_correlation,
    "x23_country_against_mean": partial(customers.country_quality, against_mean=True),
    "x24_stored_trend": stored_trend,
}


def run(name: str, retail: Retail, **options: object) -> DataFrame:
    return REPORTS[name](retail, **options)


def _star(name: str, spark: SparkSession, folder: str, **options: object) -> DataFrame:
    retail = StarRetail.open(spark, folder)
    if name == "q5_agent_scorecard":
        # mean discounts lie near 5 % in these tables; the default cut of 6 % would flag nobody
        options.setdefault("high_discount", 5.0)
    if name == "x1_month_agent_pivot":
        # employees grow with the data here, titles do not
        options.setdefault("column", "Title")
        options.setdefault("values", retail.titles())
    return run(name, retail, **options)


def star_queries() -> dict[str, Callable[..., DataFrame]]:
    """name -> (spark, folder, **options) -> DataFrame."""
    return {name: partial(_star, name) for name in REPORTS}
