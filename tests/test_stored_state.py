"""Figures kept between runs: sketches by day, ledgers by batch; and the audit of a load."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from salesloom.operators.increments import Ledger
from salesloom.operators.materialize import scratch_dir
from salesloom.plans.audit import CSV_CHECKS, Keys, Reference, audit
from salesloom.plans.reports import revenue, sketched
from salesloom.plans.retail import StarRetail


def folder(spark):
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_sketches_are_close_at_every_size(spark, size):
    shop = StarRetail.open(spark, f"/root/testdata/{size}")
    path = folder(spark)
    sketched.store(sketched.daily_sketches(shop), path)
    days = sketched.stored(spark, path)
    near = {r["Country"]: r for r in sketched.merged(days, "Country").drop("OrderValues").collect()}
    exact = {r["Country"]: r for r in sketched.exact(shop, "Country").collect()}
    assert set(near) == set(exact)
    for country, row in exact.items():
        assert near[country]["Orders"] == row["Orders"]
        assert abs(near[country]["Customers"] - row["Customers"]) <= sketched.CUSTOMERS_OFF * row["Customers"]
        assert near[country]["LowerQuartile"] < row["MedianOrderValue"] < near[country]["UpperQuartile"]
    whole = sketched.merged(days).first()
    assert abs(whole["Customers"] - sum(r["Customers"] for r in exact.values())) <= sketched.CUSTOMERS_OFF * whole["Customers"]


def test_a_period_reads_its_months_and_a_month_is_replaced(spark):
    shop = StarRetail.open(spark, "/root/testdata/sf0.001")
    path = folder(spark)
    sketches = sketched.daily_sketches(shop)
    sketched.store(sketches, path)
    first, last = dt.date(1995, 2, 10), dt.date(1995, 3, 5)
    days = sketched.stored(spark, path, first, last)
    want = sketches.where(F.col("OrderDate").between(F.lit(first), F.lit(last)))
    assert days.agg(F.sum("Orders")).first()[0] == want.agg(F.sum("Orders")).first()[0]
    assert "PartitionFilters: [isnotnull(Month" in days._jdf.queryExecution().executedPlan().toString()
    sketched.store(sketches.where("OrderDate >= '1995-02-01' AND OrderDate < '1995-03-01'"), path)
    assert sketched.stored(spark, path).agg(F.sum("Orders")).first()[0] == sketches.agg(F.sum("Orders")).first()[0]


def test_ledger_takes_each_batch_once(spark):
    ledger = Ledger(spark, folder(spark), ["k"], ["v"])
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, sign int").withColumn("v", F.col("v").cast("decimal(10,2)"))
    assert ledger.state() is None and ledger.version() == 0
    assert ledger.apply("one", rows(("a", 5, 1), ("a", 7, 1), (None, 1, 1), ("b", None, 1))) == 1
    assert ledger.apply("one", rows(("a", 99, 1))) == 1
    assert ledger.apply("two", rows(("a", 5, -1), ("b", None, -1), ("c", 3, 1))) == 2
    held = lambda version=None: {r["k"]: (r["v"], r["rows"]) for r in ledger.state(version).collect()}
    assert held() == {"a": (7, 1), None: (1, 1), "c": (3, 1)}
    assert held(1) == {"a": (12, 2), None: (1, 1), "b": (0, 1)}
    assert ledger.apply("none", rows()) == 3 and held() == held(2)
    # a run that was broken off before its log entry leaves the old version in force
    spark.range(3).write.parquet(ledger._folder(4, 17))
    assert ledger.version() == 3 and held() == held(2)
    assert ledger.apply("after", rows(("c", 1, 1))) == 4 and held()["c"] == (4, 2)


def test_state_after_batches_is_that_of_the_whole_run(spark):
    shop = StarRetail.open(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, revenue.quarterly_trend(shop).collect()))
    assert sorted(map(tuple, revenue.refreshed_trend(shop, batches=3).collect())) == want
    ledger = Ledger(spark, folder(spark), revenue.DAY_KEYS, revenue.DAY_SUMS)
    ledger.apply("all", revenue.order_changes(shop))
    got = {r["CustomerID"]: r for r in revenue.customers_of_days(ledger.state()).collect()}
    base = {r["CustomerID"]: r for r in shop.customer_base().collect()}
    assert set(got) == set(base)
    for key, row in base.items():
        assert all(got[key][c] == row[c] for c in ("Orders", "NetU", "FirstOrder", "LastOrder"))
    ledger.apply("none left", revenue.order_changes(shop, sign=-1))
    assert ledger.state().count() == 0


def test_audit_finds_each_planted_fault(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, name string")
    child = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 9, "x"), (2, 9, "y"), (3, None, "x"), (4, 2, None)], "n int, parent int, part string")
    checks = [Keys("parent", ("id",)), Keys("child", ("n", "part")), Reference("child", ("parent",), "parent"), Keys("none", ("id",))]
    found = audit({"parent": parent, "child": child, "none": parent.limit(0)}, checks).collect()
    assert [tuple(r) for r in found] == [
        ("key", "parent(id)", 4, 1, 2, 1),
        ("key", "child(n, part)", 6, 1, 0, 0),
        ("reference", "child(parent) -> parent", 6, 1, 2, 1),
        ("key", "none(id)", 0, 0, 0, 0),
    ]
    again = audit({"parent": parent, "child": child.union(child.limit(1)), "none": parent.limit(0)}, checks).collect()
    assert again[1][2:] == (7, 1, 2, 1)


def test_audit_parts_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("1:a", "")], "a string, b string")
    assert audit({"t": rows}, [Keys("t", ("a", "b"))]).first()[4:] == (0, 0)


def test_audit_shuffles_the_keys_once(spark):
    rows = spark.createDataFrame([(1, 1)], "a int, b int")
    plan = audit({"t": rows, "u": rows}, [Keys("t", ("a",)), Reference("u", ("b",), "t")])
    text = plan._jdf.queryExecution().sparkPlan().toString() + plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(domain") == 1


def test_csv_checks_name_every_table():
    assert len({c.table for c in CSV_CHECKS}) == 11
