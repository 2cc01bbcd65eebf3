"""One-call forms, and random frames against Spark's own windows."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.operators import windows as G
from salesloom.operators.growth import growth
from salesloom.operators.materialize import materialize, scratch_dir
from salesloom.operators.ordering import Key, Spec, measure

SCHEMA = "id bigint, g string, v decimal(18,2)"
ROWS = [(i, f"g{i % 3}", Decimal((i * 37) % 11)) for i in range(200)]


def _pairs(frame, col):
    return sorted((r["id"], r[col]) for r in frame.select("id", col).collect())


@pytest.mark.parametrize(
    "call, builtin",
    [
        (lambda f: G.global_rank(f, "v"), lambda: F.rank().over(W.orderBy(F.desc("v")))),
        (lambda f: G.global_rank(f, "v", ties=["id"]), lambda: F.rank().over(W.orderBy(F.desc("v")))),
        (
            lambda f: G.global_rank(f, "v", dense=True, out="rank"),
            lambda: F.dense_rank().over(W.orderBy(F.desc("v"))),
        ),
        (
            lambda f: G.global_rank(f, "v", within=["g"]),
            lambda: F.rank().over(W.partitionBy("g").orderBy(F.desc("v"))),
        ),
        (
            lambda f: G.global_row_number(f, "v", ["id"], out="rank"),
            lambda: F.row_number().over(W.orderBy("v", "id")),
        ),
        (lambda f: G.global_ntile(f, "v", 7, ["id"], out="rank"), lambda: F.ntile(7).over(W.orderBy("v", "id"))),
        (lambda f: G.global_cume_dist(f, "v", out="rank"), lambda: F.cume_dist().over(W.orderBy("v"))),
        (
            lambda f: G.global_percent_rank(f, "v", ties=["id"], out="rank"),
            lambda: F.percent_rank().over(W.orderBy("v")),
        ),
    ],
)
def test_one_call_forms(spark, call, builtin):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = call(frame)
    assert got.columns == ["id", "g", "v", "rank"]
    assert _pairs(got, "rank") == _pairs(frame.withColumn("rank", builtin()), "rank")


def test_running_share_ends_at_100(spark):
    rows = G.running_share(spark.createDataFrame(ROWS, SCHEMA), "v", ["id"]).collect()
    shares = [r["running_share"] for r in rows]
    assert shares == sorted(shares) and shares[-1] == 100.0


def test_strings_and_dates_descend(spark):
    frame = spark.sql(
        "SELECT id, date_add(DATE'1996-01-01', cast(id % 17 AS int)) AS d, concat('é', id % 5) AS s FROM range(300)"
    )
    for col in ("d", "s"):
        got = G.global_ntile(frame, col, 4, ["id"], desc=True, out="t")
        want = frame.withColumn("t", F.ntile(4).over(W.orderBy(F.desc(col), "id")))
        assert _pairs(got, "t") == _pairs(want, "t")


values = st.one_of(st.none(), st.integers(-3, 3), st.integers(-(10**9), 10**9))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(vs=st.lists(values, max_size=60), desc=st.booleans(), buckets=st.integers(1, 12))
def test_random_frames(spark, vs, desc, buckets):
    frame = spark.createDataFrame(
        [(i, None if v is None else Decimal(v)) for i, v in enumerate(vs)], "id bigint, v decimal(18,2)"
    ).coalesce(1)
    (order,) = measure(frame, Spec(Key("v", desc), (Key("id"),)), buckets=buckets)
    by = F.col("v").desc() if desc else F.col("v").asc()
    got = order.arrange().withColumns({"a": order.rank(), "b": order.row_number()})
    want = frame.withColumns(
        {"a": F.rank().over(W.orderBy(by)), "b": F.row_number().over(W.orderBy(by, "id"))}
    )
    assert _pairs(got, "a") == _pairs(want, "a")
    assert _pairs(got, "b") == _pairs(want, "b")


def test_growth_takes_the_previous_row(spark):
    frame = spark.createDataFrame([(1996, 100.0), (1998, 150.0), (1999, 0.0), (2000, 5.0)], "y int, v double")
    prev, change = growth("v", ["y"])
    rows = frame.select("y", prev.alias("p"), change.alias("c")).orderBy("y").collect()
    assert [(r["p"], r["c"]) for r in rows] == [(None, None), (100.0, 50.0), (150.0, -100.0), (0.0, None)]


def test_written_tables_lie_in_the_shared_folder(spark):
    folder = scratch_dir(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    table = materialize(spark.range(3).toDF("x"))
    assert all(folder in f for f in table.inputFiles())
    assert table.count() == 3


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        scratch_dir(Session())
