"""Average ranks and Spearman's coefficient, with ties over bucket borders."""

import random

import pandas as pd
import pytest

from salesloom.operators.ordering import Key, Spec, measure
from salesloom.plans.reports import insights


def test_average_rank_over_borders(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([1, 2, 2, 2, 2, 2, 3, None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, v int")
    for buckets in (1, 7):
        (order,) = measure(frame, Spec(Key("v"), (Key("id"),)), buckets=buckets)
        got = {r["id"]: r["a"] for r in order.arrange().select("id", order.average_rank().alias("a")).collect()}
        want = pd.Series([-1 if v is None else v for _, v in rows]).rank()
        assert [got[i] for i in range(400)] == want.tolist()


@pytest.mark.parametrize("values", [4, 1000])
def test_rank_correlation(spark, values):
    draw = random.Random(values)
    rows = [(i, draw.randrange(values), draw.randrange(values)) for i in range(300)] + [(400, None, 3), (401, 5, None)]
    found = insights.rank_correlation(spark.createDataFrame(rows, "k int, a int, b int"), "k", "a", "b").collect()
    frame = pd.DataFrame(rows, columns=["k", "a", "b"]).dropna()
    assert found[0][0] == round(frame.a.rank().corr(frame.b.rank()), 3)


def test_constant_columns_correlate_with_nothing(spark):
    frame = spark.createDataFrame([(1, 5, 1), (2, 5, 2)], "k int, a int, b int")
    assert insights.rank_correlation(frame, "k", "a", "b").collect() == [(None,)]
    amounts = frame.agg(insights._correlation(frame["a"].cast("double"), frame["b"].cast("double")))
    assert amounts.collect() == [(None,)]
