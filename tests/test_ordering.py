"""Global windows against Spark's own single-task windows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.operators.ordering import Key, Spec, measure, quantiles, tile_columns

SCHEMA = "id bigint, name string, g string, v decimal(18,2)"


def _rows(kind, n=3000):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        if kind == "ties":
            v = Decimal(rnd.randrange(50))
        elif kind == "nulls":
            v = None if i % 7 == 0 else Decimal(rnd.randrange(10**6)) / 100
        elif kind == "hot":
            v = Decimal(7) if i % 5 < 3 else Decimal(rnd.randrange(10**6)) / 100
        elif kind == "one_value":
            v = Decimal(3)
        else:
            v = Decimal(rnd.randrange(10**9)) / 100
        g = None if i % 97 == 0 else ("big" if i % 2 else f"g{i % 13}")
        out.append((i, f"é,\"{rnd.randrange(10**6)}-{i}", g, v))
    rnd.shuffle(out)
    return out


CASES = {
    "plain": _rows("plain"),
    "ties": _rows("ties"),
    "nulls": _rows("nulls"),
    "hot": _rows("hot"),
    "one_value": _rows("one_value"),
    "three": _rows("plain", 3),
    "one": _rows("plain", 1),
    "none": [],
}


# an order in nine buckets, and in one, as small frames have it
BUCKETS = [*((case, 9) for case in CASES), ("nulls", 1), ("hot", 1), ("none", 1)]


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("tie", ["id", "name"])
@pytest.mark.parametrize("case, buckets", BUCKETS)
def test_matches_builtin_windows(spark, case, buckets, tie, desc):
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    spec = Spec(Key("v", desc), (Key(tie),), sums=("v",), dense=True)
    (order,) = measure(frame, spec, buckets=buckets)
    got = order.arrange().withColumns(
        {
            "rank": order.rank(),
            "dense": order.dense_rank(),
            "rn": order.row_number(),
            "running": order.running_sum("v"),
            "cume": order.cume_dist(),
            "pct": order.percent_rank(),
            "tile2": tile_columns([order], 5)[0],
        }
    )
    got = got.withColumns(
        {
            "tile": order.ntile(5, F.col("rn")),
            "back": order.ntile(4, F.col("rn"), reverse=True),
        }
    )
    by = F.col("v").desc() if desc else F.col("v").asc()
    w, total = W.orderBy(by), W.orderBy(by, tie)
    turned = W.orderBy(F.col("v").asc_nulls_first() if desc else F.col("v").desc_nulls_last(), F.desc(tie))
    want = frame.withColumns(
        {
            "rank": F.rank().over(w),
            "dense": F.dense_rank().over(w),
            "rn": F.row_number().over(total),
            "running": F.coalesce(F.sum("v").over(total.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)),
            "tile": F.ntile(5).over(total),
            "back": F.ntile(4).over(turned),
            "cume": F.cume_dist().over(w),
            "pct": F.percent_rank().over(w),
            "tile2": F.ntile(5).over(total),
        }
    )
    cols = ["id", "rank", "dense", "rn", "running", "tile", "back", "cume", "pct", "tile2"]
    rows = got.select(cols).collect()
    assert [r["rn"] for r in rows] == list(range(1, len(rows) + 1))  # sorted output
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("case, buckets", BUCKETS)
def test_within_groups(spark, case, buckets, desc):
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    spec = Spec(Key("v", desc), (Key("id"),), within=("g",), sums=("v",), dense=True)
    (order,) = measure(frame, spec, buckets=buckets)
    got = order.arrange().withColumns(
        {
            "rank": order.rank(),
            "dense": order.dense_rank(),
            "rn": order.row_number(),
            "running": order.running_sum("v"),
        }
    )
    by = F.col("v").desc() if desc else F.col("v").asc()
    w, total = W.partitionBy("g").orderBy(by), W.partitionBy("g").orderBy(by, "id")
    want = frame.withColumns(
        {
            "rank": F.rank().over(w),
            "dense": F.dense_rank().over(w),
            "rn": F.row_number().over(total),
            "running": F.coalesce(F.sum("v").over(total.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)),
        }
    )
    cols = ["id", "rank", "dense", "rn", "running"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        map(tuple, want.select(cols).collect())
    )


@pytest.mark.parametrize("case", ["hot", "one_value", "ties"])
def test_frequent_value_is_spread(spark, case):
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    (order,) = measure(frame, Spec(Key("v", True), (Key("id"),)), buckets=10)
    sizes = order.arrange().groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.25 * 3000


@pytest.mark.parametrize("case", ["plain", "hot"])
def test_many_buckets(spark, case):
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    (order,) = measure(frame, Spec(Key("v"), (Key("id"),)), buckets=150)
    got = order.arrange().withColumn("rn", order.row_number()).select("id", "rn").collect()
    want = frame.select("id", F.row_number().over(W.orderBy("v", "id")).alias("rn")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_arranged_plan_has_one_exchange_and_no_single_partition(spark, capsys):
    frame = spark.createDataFrame(CASES["plain"], SCHEMA)
    (order,) = measure(frame, Spec(Key("v", True), (Key("id"),), sums=("v",)), buckets=2)
    out = order.arrange().withColumns(
        {"rank": order.rank(), "rn": order.row_number(), "run": order.running_sum("v")}
    )
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1  # the narrow table of offsets is broadcast
    assert "SinglePartition" not in plan
    assert plan.count("Sort [") == 1


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("case", ["plain", "ties", "hot", "three", "one", "none"])
def test_quantiles(spark, case, desc):
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    (order,) = measure(frame, Spec(Key("v", desc), (Key("id"),)), buckets=9)
    want = frame.agg(F.percentile("v", [0.0, 0.25, 0.5, 0.9, 1.0]).alias("q")).first()["q"]
    got = quantiles(order, [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got == (pytest.approx(want) if want else [None] * 5)


@pytest.mark.parametrize("case", ["nulls", "hot"])
def test_as_many_buckets_as_rows_ask_for(spark, case):
    """The plan does not grow with the buckets."""
    frame = spark.createDataFrame(CASES[case], SCHEMA)
    plans = []
    for buckets in (20, 200):
        (order,) = measure(frame, Spec(Key("v", True), (Key("id"),)), buckets=buckets)
        arranged = order.arrange().withColumns({"rank": order.rank(), "rn": order.row_number()})
        plans.append(arranged._jdf.queryExecution().executedPlan().toString())
    assert "from_json" not in plans[1] and len(plans[1]) < 1.05 * len(plans[0])
    got = arranged.select("id", "rank", "rn").collect()
    by = F.col("v").desc()
    want = frame.select(
        "id", F.rank().over(W.orderBy(by)).alias("rank"), F.row_number().over(W.orderBy(by, "id")).alias("rn")
    ).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_frequent_value_is_spread_without_ties(spark):
    frame = spark.createDataFrame(CASES["one_value"], SCHEMA)
    (order,) = measure(frame, Spec(Key("v")), buckets=10)
    sizes = order.arrange().groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.25 * 3000


KEYS = {
    "timestamp": "timestamp_micros(1700000000000000 + id % 250)",
    "timestamp_ntz": "cast(timestamp_micros(1700000000000000 + id % 250) AS timestamp_ntz)",
    "double": "CASE id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D ELSE id % 90 / 7.0D END",
    "text": "concat('é\"', char(92), chr(39), cast(id % 200 AS string))",
    "date": "date_add(DATE'1999-12-20', cast(id % 300 AS int))",
    "boolean": "id % 3 = 0",
    "binary": "cast(cast(id % 100 AS string) AS binary)",
    "long": "9007199254740993 + id % 300",
}


@pytest.mark.parametrize("kind, desc", [(kind, i % 2 == 0) for i, kind in enumerate(KEYS)])
def test_keys_and_groups_of_every_type(spark, kind, desc):
    frame = spark.range(1000).selectExpr("id", f"IF(id % 11 = 0, NULL, {KEYS[kind]}) AS k", "id * 7 % 13 AS v")
    by = F.col("k").desc() if desc else F.col("k").asc()
    first, second = measure(
        frame, Spec(Key("k", desc), (Key("id"),), dense=True), Spec(Key("v", desc), (Key("id"),), within=("k",)), buckets=9
    )
    got = first.arrange().select(
        "id", first.rank().alias("rank"), first.dense_rank().alias("dense"), first.row_number().alias("rn")
    )
    got = got.join(frame.select("id", first.tile_column(7).alias("tile")), "id")
    got = got.join(second.arrange().select("id", second.rank().alias("inside")), "id")
    v = F.col("v").desc() if desc else F.col("v").asc()
    want = frame.select(
        "id",
        F.rank().over(W.orderBy(by)).alias("rank"),
        F.dense_rank().over(W.orderBy(by)).alias("dense"),
        F.row_number().over(W.orderBy(by, "id")).alias("rn"),
        F.ntile(7).over(W.orderBy(by, "id")).alias("tile"),
        F.rank().over(W.partitionBy("k").orderBy(v)).alias("inside"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
