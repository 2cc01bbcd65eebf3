"""Facts stored by order: no shuffle below totals and joins by order, and the same figures."""

import pytest

from salesloom.catalog import run
from salesloom.operators.materialize import fresh_path
from salesloom.plans.retail import StarRetail
from salesloom.plans.stored import open_stored, store

FOLDER = "/root/testdata/sf0.001"


def _rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def plain(spark):
    return StarRetail.open(spark, FOLDER)


@pytest.fixture(scope="module")
def stored(spark, plain):
    folder = fresh_path(spark)
    store(plain, folder)
    # as a session finds it that has not written it
    for name in ("orders", "lines"):
        for table in spark.catalog.listTables():
            if table.name.endswith(f"_{name}") and table.name.startswith("by_order_"):
                spark.sql(f"DROP TABLE {table.name}")
    return open_stored(plain, folder)


@pytest.mark.parametrize("products", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_orders_meet_their_lines_without_an_exchange(spark, plain, stored, how, products):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.order_book(how, products)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount" in plan
        usual = plain.order_book(how, products)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("name", ["q4_quarterly_trend", "q8_customer_pareto", "q13_carrier_sla", "q14_order_size_delivery"])
def test_reports_are_the_same(plain, stored, name):
    assert _rows(run(name, stored)) == _rows(run(name, plain))


def test_crowded_orders_lie_beside_the_buckets(spark, plain):
    folder = fresh_path(spark)
    store(plain, folder, buckets=4, most_lines=5)
    crowded = spark.read.parquet(f"{folder}/crowded")
    lines = plain.tables["lineitem"]
    large = lines.groupBy("l_orderkey").count().where("count > 5")
    assert crowded.count() == lines.join(large, "l_orderkey", "left_semi").count() > 0
    again = open_stored(plain, folder)
    for products in (False, True):
        assert _rows(again.order_totals(products)) == _rows(plain.order_totals(products))
    assert _rows(again.tables["lineitem"].select(*lines.columns)) == _rows(lines)
    assert _rows(run("q4_quarterly_trend", again)) == _rows(run("q4_quarterly_trend", plain))
