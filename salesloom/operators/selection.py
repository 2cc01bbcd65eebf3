"""Where a running weight reaches an amount, without sorting: selection by shrinking value intervals.

Keys are whole numbers. A pass counts, for each group and sought amount, the rows and weight of each of 2**BITS equal parts of the interval
that is left, finds the part in which the running weight reaches the amount, and goes on inside it. Rows are summed in tasks
before they are dealt, so a group with a third of all rows costs no task more than 2**BITS cells; there is no sort and no
range exchange. The interval shrinks by BITS a pass, so a few passes settle any key.

With a weight of one the amount is a position: exact quantiles of any number of groups at once. With the value itself as the weight it
is the cut that the largest values reach first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

BITS = 10
KEY_BITS = 61  # keys lie within +- 2**61
_WEIGHT = "decimal(38,6)"
_CHUNK = 6  # letters of a text in one key


def _met(one: DataFrame, two: DataFrame, names: Sequence[str]) -> DataFrame:
    """``one`` with the other columns of ``two``, joined on ``names`` with nulls as values."""
    renamed = two.select(*(F.col(c).alias(f"__{c}" if c in names else c) for c in two.columns))
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names))
    return one.join(renamed, on).drop(*(f"__{n}" for n in names))


def weighted_cuts(rows: DataFrame, groups: Sequence[str], wanted: DataFrame) -> DataFrame:
    """For each row of ``wanted`` (groups, spot, amount): key, the smallest one up to which the weight of the group's rows
    reaches the amount, with ``below`` and ``rows_below``, the weight and the number of rows with smaller keys.

    ``rows`` has the groups, key (bigint, not null) and weight (not negative); it should be a written table, it is read once
    a pass. An amount that is not positive or beyond the group's weight has no row. Groups may be null.
    """
    none, cell = F.lit(0).cast("bigint"), [*groups, "prefix"]
    facts = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high = facts["low"] or 0, facts["high"] or 0
    if max(abs(low), abs(high)) >> KEY_BITS:
        raise ValueError(f"keys must lie within {KEY_BITS} bits")
    place = F.col("key") - F.lit(low).cast("bigint")
    passes = max(1, -(-(high - low).bit_length() // BITS))
    sought = wanted.where("amount > 0").select(
        *groups,
        "spot",
        F.col("amount").cast(_WEIGHT).alias("amount"),
        none.alias("prefix"),
        F.lit(0).cast(_WEIGHT).alias("below"),
        none.alias("rows_below"),
    )
    inside = rows.withColumn("prefix", none)
    for shift in range(BITS * (passes - 1), -1, -BITS):
        part = F.shiftright(place, shift).alias("part")
        cells = inside.groupBy(*cell, part).agg(F.sum("weight").cast(_WEIGHT).alias("weight"), F.count("*").alias("n"))
        before = W.partitionBy(*cell).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumns(
            {
                "ahead": F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(_WEIGHT),
                "rows_ahead": F.coalesce(F.sum("n").over(before), none),
            }
        )
        found = _met(sought, cells, cell).where(
            (F.col("amount") > F.col("ahead")) & (F.col("amount") <= F.col("ahead") + F.col("weight"))
        )
        sought = materialize(
            found.select(
                *groups,
                "spot",
                (F.col("amount") - F.col("ahead")).cast(_WEIGHT).alias("amount"),
                F.col("part").alias("prefix"),
                (F.col("below") + F.col("ahead")).cast(_WEIGHT).alias("below"),
                (F.col("rows_below") + F.col("rows_ahead")).alias("rows_below"),
            )
        )
        if shift:
            # the rows of the parts that are left; one row for each group and amount says which
            few = sought.select(*cell).distinct()
            inside = _met(rows.withColumn("prefix", F.shiftright(place, shift)), broadcast_up_to(few, sought.count()), cell)
    key = (F.col("prefix") + F.lit(low).cast("bigint")).alias("key")
    return sought.select(*groups, "spot", key, "below", "rows_below")


def group_quantiles(frame: DataFrame, groups: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """groups, rows and quantiles (array<double>, one for each fraction, linear between neighbours) of a whole-number column.

    Exact for groups of any size and number. Null values take no part, a group without others has no row; a null in a group column is a
    value. Without groups there is one row, none for an empty frame.
    """
    named = list(groups) or ["__all"]
    shaped = frame if groups else frame.withColumn("__all", F.lit(0))
    values = shaped.where(F.col(value).isNotNull())
    narrow = materialize(values.select(*named, F.col(value).cast("bigint").alias("key"), F.lit(1).alias("weight")))
    counts = materialize(narrow.groupBy(*named).agg(F.count("*").alias("rows")))
    at = [F.col("rows").cast("double").__sub__(1) * F.lit(float(f)) for f in fractions]
    spots = [
        F.struct(F.lit(2 * i + side).alias("spot"), (edge(a).cast("bigint") + 1).alias("amount"))
        for i, a in enumerate(at)
        for side, edge in enumerate((F.floor, F.ceil))
    ]
    wanted = counts.select(*named, F.inline(F.array(*spots)))
    cuts = weighted_cuts(narrow, named, wanted)
    keys = cuts.groupBy(*named).agg(
        *(F.max(F.when(F.col("spot") == j, F.col("key"))).cast("double").alias(f"k{j}") for j in range(2 * len(fractions)))
    )
    between = [
        F.col(f"k{2 * i}") + (F.col(f"k{2 * i + 1}") - F.col(f"k{2 * i}")) * (a - F.floor(a)) for i, a in enumerate(at)
    ]
    return _met(keys, counts, named).select(*groups, "rows", F.array(*between).alias("quantiles"))


def nth_smallest(rows: DataFrame, groups: Sequence[str], wanted: DataFrame) -> DataFrame:
    """groups, spot and id: for each row of ``wanted`` (groups, spot, amount) the amount-th smallest id of its group. Ids are whole numbers,
    or texts, which are ordered by their UTF-8 bytes and settled a few letters at a time. Rows that repeat an id count as often."""
    groups = list(groups)
    if dict(rows.dtypes)["id"] != "string":
        narrow = rows.select(*groups, F.col("id").cast("bigint").alias("key"), F.lit(1).alias("weight"))
        return weighted_cuts(narrow, groups, wanted).select(*groups, "spot", F.col("key").alias("id"))
    longest = rows.agg(F.max(F.octet_length("id"))).first()[0] or 0
    # each amount is a group of its own: its rows thin out as letters settle
    cell = [*groups, "nth"]
    wanted = wanted.select(*groups, F.col("spot").alias("nth"), F.lit(0).alias("spot"), "amount")
    left = _met(rows.select(*groups, "id"), wanted.select(*cell), groups)

    def letter(i: int) -> Column:
        """One more than the byte at ``i``, 0 beyond the end: a text sorts before all that go on."""
        byte = F.conv(F.hex(F.substring(F.col("id").cast("binary"), i + 1, 1)), 16, 10).cast("bigint")
        return F.when(F.octet_length("id") > i, byte + 1).otherwise(F.lit(0))

    for start in range(0, max(1, longest), _CHUNK):
        chunk = sum((letter(start + i) * 257 ** (_CHUNK - 1 - i) for i in range(_CHUNK)), F.lit(0).cast("bigint"))
        left = materialize(left.select(*cell, "id", chunk.alias("key"), F.lit(1).alias("weight")))
        cuts = weighted_cuts(left, cell, wanted)
        after = _met(wanted, cuts.select(*cell, "rows_below"), cell)
        wanted = materialize(after.select(*cell, "spot", (F.col("amount") - F.col("rows_below")).alias("amount")))
        chosen = cuts.select(*cell, F.col("key").alias("chosen"))
        left = _met(left, chosen, cell).where("key = chosen").select(*cell, "id")
    return left.groupBy(*cell).agg(F.min("id").alias("id")).withColumnRenamed("nth", "spot")
