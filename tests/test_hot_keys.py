"""One order, customer, product, supplier and nation hold a third of their rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_reports_oracle import DATA, TABLES, _sorted
from salesloom.catalog import star_queries
from salesloom.oracles import ORACLES


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    source = DATA / "sf0.001"
    if not source.exists():
        pytest.skip("no test tables")
    folder = str(tmp_path_factory.mktemp("hot"))
    keys = {
        "lineitem": {"l_orderkey": 7, "l_partkey": 11, "l_suppkey": 3},
        "orders": {"o_custkey": 5},
        "customer": {"c_nationkey": 2},
        "supplier": {"s_nationkey": 2},
        "part": {"p_type": "SMALL", "p_size": 9},
    }
    db = duckdb.connect()
    for name in TABLES:
        frame = spark.read.parquet(f"{source}/{name}.parquet")
        for i, (column, value) in enumerate(keys.get(name, {}).items()):
            hot_row = F.pmod(F.xxhash64(F.lit(i), *frame.columns), F.lit(3)) == 0
            frame = frame.withColumn(
                column, F.when(hot_row, F.lit(value)).otherwise(F.col(column)).cast(
                    frame.schema[column].dataType
                )
            )
        frame.repartition(8 if name in ("lineitem", "orders") else 1).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, db


@pytest.mark.parametrize("name", list(ORACLES))
def test_report_equals_sql_on_hot_keys(spark, hot, name):
    folder, db = hot
    got = star_queries()[name](spark, folder)
    want = db.sql(ORACLES[name])
    cols = sorted(got.columns)
    want_rows = _sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    got_rows = _sorted(tuple(r) for r in got.select(*cols).collect())
    assert len(got_rows) == len(want_rows)
    assert [(g, w) for g, w in zip(got_rows, want_rows) if g != w] == []


@pytest.mark.parametrize("name", ["q1_category_yoy", "q14_order_size_delivery"])
def test_skewed_join_is_split(spark, hot, name):
    """The joins that meet a hot key row by row keep a shape Spark can split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "64m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        if name == "q1_category_yoy":
            frame = star_queries()[name](spark, hot[0])
        else:
            frame = _orders_with_customers(spark, hot[0])
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _orders_with_customers(spark, folder):
    """The part of the order report that is written before it is ranked."""
    from salesloom.plans.reports.shipping import sized_orders
    from salesloom.plans.retail import StarRetail

    retail = StarRetail.open(spark, folder)
    return sized_orders(retail, products=True).join(retail.customers(), "CustomerID")
