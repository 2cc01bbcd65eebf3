"""Selection by intervals against sorting."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesloom.operators import selection
from salesloom.operators.selection import group_quantiles, nth_smallest, weighted_cuts


def test_group_quantiles_equal_sorted_ones(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None, "hot", "hot", "hot"]), draw.choice([2020, None]), draw.choice([None, 7, draw.randrange(-(10**9), 10**12)])) for _ in range(3000)]
    rows += [("one", 1, 5), ("far", 1, 2**61 - 1), ("far", 1, -(2**61) + 1), ("void", 1, None)]
    frame = spark.createDataFrame(rows, "g string, y int, v long")
    fractions = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["g"], r["y"]): (r["rows"], r["quantiles"]) for r in group_quantiles(frame, ["g", "y"], "v", fractions).collect()}
    held = {}
    for g, y, v in rows:
        if v is not None:
            held.setdefault((g, y), []).append(v)
    assert set(got) == set(held)
    for group, values in held.items():
        assert got[group][0] == len(values)
        assert got[group][1] == pytest.approx(np.quantile(np.array(values, float), fractions).tolist(), rel=1e-12)


def test_quantiles_without_groups_and_rows(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert [tuple(r) for r in group_quantiles(frame, [], "v", [0.5]).collect()] == [(2, [1.5])]
    assert group_quantiles(frame.limit(0), [], "v", [0.5]).collect() == []


def test_a_hot_group_is_summed_before_it_is_dealt(spark):
    """A group with nearly all rows reaches the shuffle as a few cells of each task."""
    frame = spark.range(0, 200_000, numPartitions=8).selectExpr("IF(id % 100 = 0, id % 7, 99) AS g", "id * 7919 % 100003 AS v")
    got = group_quantiles(frame, ["g"], "v", [0.5]).where("g = 99").first()
    assert got["quantiles"][0] == pytest.approx(np.quantile([i * 7919 % 100003 for i in range(200_000) if i % 100], 0.5))
    plan = group_quantiles(frame, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_cuts_by_weight(spark):
    draw = random.Random(3)
    rows = [(g, draw.randrange(50), draw.randrange(0, 4)) for g in ("x", None) for _ in range(300)]
    frame = spark.createDataFrame(rows, "g string, key long, weight long")
    table = pd.DataFrame(rows, columns=["g", "key", "weight"]).fillna("null")
    amounts = [-1, 0, 1, 100, 250, 10_000]
    wanted = spark.createDataFrame([(g, i, a) for g in ("x", None) for i, a in enumerate(amounts)], "g string, spot int, amount long")
    got = {(r["g"] or "null", r["spot"]): (r["key"], int(r["below"]), r["rows_below"]) for r in weighted_cuts(frame, ["g"], wanted).collect()}
    want = {}
    for g, part in table.groupby("g"):
        sums = part.groupby("key")["weight"].agg(["sum", "count"]).sort_index()
        for i, amount in enumerate(amounts):
            reached = sums.index[(sums["sum"].cumsum() >= amount)]
            if amount > 0 and len(reached):
                less = sums[sums.index < reached[0]]
                want[g, i] = (reached[0], less["sum"].sum(), less["count"].sum())
    assert got == want
    with pytest.raises(ValueError, match="bits"):
        weighted_cuts(frame.withColumn("key", F.lit(2**62)), ["g"], wanted)


def test_nth_text(spark):
    draw = random.Random(4)
    texts = ["", "a", "a\0", "abcdef", "abcdefg", "ä", "日本", "Z" * 20] + ["".join(draw.choice("abé") for _ in range(draw.randint(0, 9))) for _ in range(200)]
    frame = spark.createDataFrame([("g", t) for t in texts], "of string, id string")
    wanted = spark.createDataFrame([("g", i, i + 1) for i in range(0, len(texts), 23)], "of string, spot int, amount int")
    got = {r["spot"]: r["id"] for r in nth_smallest(frame, ["of"], wanted).collect()}
    order = sorted(texts, key=str.encode)
    assert got == {i: order[i] for i in range(0, len(texts), 23)}
    assert selection._CHUNK * 9 <= selection.KEY_BITS  # a letter is below 2**9
