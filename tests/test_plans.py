"""Plans: what is scanned, joined and gathered."""

import re

import pytest

from salesloom.operators import materialize as materialize_module
from salesloom.operators import ordering
from salesloom.plans import retail as retail_module
from salesloom.plans.reports import employees, insights, shipping, supply
from salesloom.catalog import star_queries

FOLDER = "/root/testdata/sf0.001"

# windows over one row per class, quarter, year, country or shipper, or over a top-k
BOUNDED = {
    "q3_discount_depth",
    "q4_quarterly_trend",
    "q10_country_quality",
    "x23_country_against_mean",
    "q13_carrier_sla",
    "x4_top_n_share",
    "x7_monthly_run_rate",
    "x11_discounted_lines",
    "x24_stored_trend",
}
GATHERED = re.compile(r"Window[^\n]*\n(?:[^\n]*Sort [^\n]*\n)?[^\n]*Exchange SinglePartition")


@pytest.fixture(scope="module")
def plans(spark):
    """Every plan of every report: what it writes on the way, and its result."""
    seen: list[str] = []
    plain = materialize_module.materialize

    def plan_of(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    def spy(frame):
        seen.append(plan_of(frame))
        return plain(frame)

    out = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordering, "MIN_BUCKETS", 2)  # small tables are one bucket, and the plans are to be those of large ones
        for module in (retail_module, employees, insights, shipping, supply):
            patch.setattr(module, "materialize", spy)
        for name, query in star_queries().items():
            seen.clear()
            result = plan_of(query(spark, FOLDER))
            out[name] = [*seen, result]
    return out


@pytest.mark.parametrize("name", list(star_queries()))
def test_no_cross_join_and_no_gathered_entities(plans, name):
    for plan in plans[name]:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "SortAggregate" not in plan
        assert "Python" not in plan
        if name not in BOUNDED:
            assert not GATHERED.search(plan)


def _scans(plans, name, table):
    return sum(len(re.findall(rf"{table}\.parquet", plan)) for plan in plans[name])


@pytest.mark.parametrize(
    "name, times",
    [
        ("kpi_snapshot", 1),
        ("q1_category_yoy", 1),
        ("q2_product_pareto", 1),
        ("q3_discount_depth", 1),
        ("q4_quarterly_trend", 1),
        ("q8_customer_pareto", 1),
        ("q9_rfm_segments", 1),
        ("q10_country_quality", 1),
        ("q13_carrier_sla", 1),
        ("x2_median_order_value", 1),
        ("x9_late_rate_by_size", 1),
        ("q5_agent_scorecard", 1),
        ("q14_order_size_delivery", 1),
        ("x4_top_n_share", 2),
        ("x8_recent_demand", 1),
        ("x11_discounted_lines", 1),
        ("x12_discount_revenue", 1),
        ("x20_pivot_blocks", 1),
        ("x23_country_against_mean", 1),
    ],
)
def test_line_scans(plans, name, times):
    assert _scans(plans, name, "lineitem") == times


def test_kpis_read_each_table_once(plans):
    for table in ("orders", "part", "supplier"):
        assert _scans(plans, "kpi_snapshot", table) == 1


def test_date_bound_reaches_the_scan(plans):
    result = plans["x8_recent_demand"][-1]
    assert "GreaterThanOrEqual(o_orderdate," in result
    assert _scans(plans, "x8_recent_demand", "orders") == 1


def test_only_needed_columns_and_rows_are_read(plans):
    (plan,) = plans["q3_discount_depth"]
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert "Not(EqualTo(p_type,PROMO))" in plans["q11_stock_risk"][0]


@pytest.mark.parametrize("name", ["q8_customer_pareto", "q11_stock_risk", "q14_order_size_delivery"])
def test_ranked_result_needs_one_shuffle(plans, name):
    result = plans[name][-1]
    assert result.count("shufflepartitionidpassthrough") == 1
    assert "rangepartitioning" not in result and "hashpartitioning" not in result
    assert len(re.findall(r"- Sort \[", result)) == 1


@pytest.mark.parametrize(
    "name, key",
    [
        ("q2_product_pareto", "GlobalRank"),
        ("q5_agent_scorecard", "RevenueRank"),
        ("q6_territory_coverage", "TerritoryRank"),
        ("q8_customer_pareto", "RevenueRank"),
        ("q12_supplier_portfolio", "PortfolioSizeRank"),
        ("q11_stock_risk", "UnitsInStock"),
    ],
)
def test_results_come_sorted(spark, name, key):
    values = [r[key] for r in star_queries()[name](spark, FOLDER).collect()]
    assert values == sorted(values)
