"""Series without gaps."""

from datetime import date

import pytest

from salesloom.operators.calendar import filled


def test_gaps_are_filled_between_a_groups_own_ends(spark):
    rows = [("a", date(2020, 1, 1), 5, 1, "x"), ("a", date(2020, 10, 1), 7, None, "y"), (None, date(2021, 4, 1), 1, 4, "z"), ("b", None, 9, 9, "w")]
    frame = spark.createDataFrame(rows, "g string, q date, n int, c int, t string")
    got = filled(frame, "q", "quarter", ["g"], zero=["n"], carried=["c"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            ("a", date(2020, 1, 1), 5, 1, "x"),
            ("a", date(2020, 4, 1), 0, 1, None),
            ("a", date(2020, 7, 1), 0, 1, None),
            ("a", date(2020, 10, 1), 7, None, "y"),
            (None, date(2021, 4, 1), 1, 4, "z"),
            ("b", None, 9, 9, "w"),
        ],
        key=str,
    )


@pytest.mark.parametrize("step, rows", [("day", 367), ("month", 13), ("year", 2), ("quarter", 5)])
def test_steps_without_groups(spark, step, rows):
    frame = spark.createDataFrame([(date(2020, 1, 1), 1), (date(2021, 1, 1), 2)], "d date, n int")
    assert filled(frame, "d", step, zero=["n"]).count() == rows
    assert filled(frame.limit(0), "d", step).count() == 0
    with pytest.raises(ValueError, match="step"):
        filled(frame, "d", "fortnight")
