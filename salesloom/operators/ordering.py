"""Rank, number, tile and accumulate over one order of a whole frame.

A Spark window without PARTITION BY gathers every row in one task. Here the
frame is laid out once in contiguous buckets of its sort order instead:

1. the rows are range-partitioned on all sort keys, sorted, and written with a
   number that holds their bucket and their place in it. Spark samples the
   ranges; they can make buckets uneven but never a result wrong, and once
   written they stay as they are, whatever is computed again;
2. sums per bucket are combined into what lies before each bucket: one row per
   bucket, kept as a table with the types of the keys;
3. a window inside the bucket plus what lies before it gives the global figure.

The range partitioning includes the tie-break keys, so no value, however frequent,
ends up in one task; figures of a value that crosses a border are carried over it. An order
without tie-breaks gets the row's number as one. ``within`` numbers each group separately
without making the group the unit of work: a group may span any number of buckets.

The number of buckets follows the rows: up to 20,000 rows are one bucket, sorted by one task, with nothing before it to measure. The layout is written when it is first asked for, and what lies before its
buckets only for figures that need it: tiles and quantiles do with the rows in each bucket. Nothing but the row count and, for quantiles, the
sought rows reaches the driver, and no plan holds cut points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

# a bucket holds 500,000 rows; fewer, down to 10,000, if that keeps all cores busy
ROWS_PER_BUCKET = 500_000
SMALL_BUCKET = 10_000
MIN_BUCKETS = 1
# one row per bucket, some 100 bytes each; with more buckets the join is left to Spark
BROADCAST_BUCKETS = 500_000

_SUM_TYPE = "decimal(38,6)"
_PLACE_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition
_ids = itertools.count()


@dataclass(frozen=True)
class Key:
    """A sort key; nulls come first ascending and last descending, as in Spark."""

    name: str
    desc: bool = False

    @property
    def column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    def sort(self) -> Column:
        return self.column.desc() if self.desc else self.column.asc()

    def after(self, cut: Column) -> Column:
        """Whether the row's key sorts strictly after ``cut``; never null."""
        if self.desc:
            return F.coalesce(self.column < cut, self.column.isNull() & cut.isNotNull())
        return F.coalesce(self.column > cut, self.column.isNotNull() & cut.isNull())


@dataclass(frozen=True)
class Spec:
    """An order: ``by`` decides rank, ``ties`` make it total, ``within`` restarts it."""

    by: Key
    ties: tuple[Key, ...] = ()
    within: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    dense: bool = False

    @property
    def groups(self) -> tuple[Key, ...]:
        return tuple(Key(name) for name in self.within)

    @property
    def keys(self) -> tuple[Key, ...]:
        return (*self.groups, self.by, *self.ties)


def _reached(keys: Sequence[Key], cut: Column) -> Column:
    """Whether a row sorts at or after the row ``cut`` (a struct k0, k1, ...)."""
    out = F.lit(True)
    for i, key in reversed(list(enumerate(keys))):
        at = cut.getField(f"k{i}")
        out = key.after(at) | (key.column.eqNullSafe(at) & out)
    return out


class GlobalOrder:
    """One measured order. Make it with ``measure``.

    ``arrange`` gives the measured rows in the order, globally sorted; the figures
    below it may then be added with ``withColumns``. ``tile_columns`` and
    ``quantiles`` need no arranged frame.
    """

    def __init__(self, frame: DataFrame, spec: Spec, rows: int, buckets: int):
        number = next(_ids)
        self._at, self._bucket, self._before = (f"__{n}{number}" for n in ("at", "bucket", "before"))
        self._named_ties = bool(spec.ties)
        if not spec.ties:
            tie = f"__tie{number}"
            # written before it decides where a row goes
            frame = materialize(frame.withColumn(tie, F.monotonically_increasing_id()))
            spec = replace(spec, ties=(Key(tie),))
        self.spec, self.rows, self._buckets, self._frame = spec, rows, buckets, frame

    @cached_property
    def _table(self) -> DataFrame:
        """The rows as laid out, written."""
        keys = [key.sort() for key in self.spec.keys]
        laid = self._frame.repartitionByRange(self._buckets, *keys).sortWithinPartitions(*keys)
        return materialize(laid.withColumn(self._at, F.monotonically_increasing_id()))

    @cached_property
    def _offsets(self) -> DataFrame:
        return materialize(self._carried(self._measured()))

    @cached_property
    def _held(self) -> DataFrame:
        """Per bucket the rows before it (``before``) and in it: enough to find a position."""
        bucket = F.shiftright(self._at, _PLACE_BITS).cast("int").alias("bucket")
        held = self._table.groupBy(bucket).agg(F.count("*").alias("held"))
        before = F.sum("held").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        return held.withColumn("before", F.coalesce(before, F.lit(0).cast("bigint")))

    # -- what lies before each bucket

    def _small(self, frame: DataFrame) -> DataFrame:
        return broadcast_up_to(frame, self._buckets, BROADCAST_BUCKETS)

    def _measured(self) -> DataFrame:
        """Per bucket its rows, first and last row, and figures of its last group."""
        spec, at = self.spec, F.col(self._at)
        groups = [k.column.alias(f"g{i}") for i, k in enumerate(spec.groups)]
        sums = [F.coalesce(Key(name).column, F.lit(0)).cast(_SUM_TYPE).alias(f"s{i}") for i, name in enumerate(spec.sums)]
        rows = self._table.select(
            F.shiftright(at, _PLACE_BITS).cast("int").alias("bucket"),
            at.alias("at"),
            *groups,
            spec.by.column.alias("value"),
            *sums,
        )
        # column by column, so that numbers and dates are kept in a hash aggregate
        names = [f"g{i}" for i in range(len(groups))]
        ends = rows.groupBy("bucket").agg(
            F.min("at").alias("low"),
            F.max("at").alias("high"),
            *(F.min_by(c, "at").alias(f"first_{c}") for c in (*names, "value")),
            *(F.max_by(c, "at").alias(f"last_{c}") for c in (*names, "value")),
        )

        def group(prefix: str) -> Column:
            return F.struct(*(F.col(prefix + c).alias(c) for c in names)) if names else F.lit(0)

        edges = materialize(
            ends.select(
                "*", group("first_").alias("first_group"), group("last_").alias("last_group")
            ).drop(*(end + c for c in names for end in ("first_", "last_")))
        )
        rows = rows.withColumn("group", group(""))
        met = rows.join(self._small(edges), "bucket")
        in_first = F.col("group").eqNullSafe(F.col("first_group"))
        in_last = F.col("group").eqNullSafe(F.col("last_group"))
        first_peer = in_first & F.col("value").eqNullSafe(F.col("first_value"))
        last_peer = in_last & F.col("value").eqNullSafe(F.col("last_value"))
        figures = met.groupBy("bucket").agg(
            F.count_if(in_last).alias("last_rows"),
            F.count_if(first_peer).alias("first_peers"),
            F.count_if(last_peer).alias("last_peers"),
            *(F.sum(F.when(in_last, F.col(f"s{i}"))).cast(_SUM_TYPE).alias(f"s{i}") for i in range(len(sums))),
        )
        out = edges.join(figures, "bucket")
        if spec.dense:
            values = met.where(in_last).groupBy("bucket", "value").agg(F.count("*").alias("n"))
            out = out.join(values.groupBy("bucket").agg(F.count("*").alias("last_values")), "bucket")
        else:
            out = out.withColumn("last_values", F.lit(0).cast("bigint"))
        return out.withColumn("rows", F.col("high") - F.col("low") + 1)

    def _carried(self, buckets: DataFrame) -> DataFrame:
        """Per bucket what lies before its first group's rows there.

        ``rows``, ``distinct`` and ``sums``: of that group in earlier buckets. ``start``: rows before the value
        that crosses the lower border, else null; ``end``: rows up to the end of the value that crosses the upper one. The
        windows run over one row per bucket.
        """
        line = W.orderBy("bucket")
        upto = line.rowsBetween(W.unboundedPreceding, W.currentRow)
        onwards = line.rowsBetween(W.currentRow, W.unboundedFollowing)
        same_group = W.partitionBy("last_group").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        zero = F.lit(0).cast("bigint")
        inherits = (F.lag(F.lit(1), 1, 0).over(line) == 1) & F.lag("last_group").over(line).eqNullSafe(F.col("first_group"))
        out = buckets.withColumns(
            {
                "inherits": inherits,
                "crossed": inherits & F.lag("last_value").over(line).eqNullSafe(F.col("first_value")),
                "one_group": F.col("first_group").eqNullSafe(F.col("last_group")),
            }
        ).withColumns(
            {
                "crosses": F.lead("crossed", 1, False).over(line),
                "one_value": F.col("one_group") & F.col("first_value").eqNullSafe(F.col("last_value")),
                "upto_rows": F.sum("last_rows").over(same_group),
                "upto_values": F.sum(
                    F.col("last_values") - (F.col("one_group") & F.col("crossed")).cast("bigint")
                ).over(same_group),
                **{f"upto_s{i}": F.sum(f"s{i}").over(same_group) for i in range(len(self.spec.sums))},
            }
        )

        def inherited(name: str, otherwise: Column) -> Column:
            return F.when(F.col("inherits"), F.lag(name).over(line)).otherwise(otherwise)

        out = out.withColumn("rows_before", inherited("upto_rows", zero))
        in_group = F.when(F.col("one_group"), F.col("rows_before")).otherwise(zero)
        own_start = F.when(~(F.col("one_value") & F.col("crossed")), in_group + F.col("last_rows") - F.col("last_peers"))
        own_end = F.when(~(F.col("one_value") & F.col("crosses")), F.col("rows_before") + F.col("first_peers"))
        out = out.withColumns({"own_start": own_start, "own_end": own_end}).withColumns(
            {
                "last_start": F.last("own_start", ignorenulls=True).over(upto),
                "first_end": F.first("own_end", ignorenulls=True).over(onwards),
            }
        )
        none = F.lit(0).cast(_SUM_TYPE)
        sums = F.array(*(inherited(f"upto_s{i}", none).cast(_SUM_TYPE) for i in range(len(self.spec.sums))))
        return out.select(
            F.col("bucket").alias(self._bucket),
            F.struct(
                F.col("first_group").alias("group"),
                F.col("rows").alias("held"),
                F.col("rows_before").alias("rows"),
                (inherited("upto_values", zero) - F.col("crossed").cast("bigint")).alias("distinct"),
                F.when(F.col("crossed"), F.lag("last_start").over(line)).alias("start"),
                F.when(F.col("crosses"), F.lead("first_end").over(line)).alias("end"),
                sums.cast(f"array<{_SUM_TYPE}>").alias("sums"),
            ).alias(self._before),
        )

    def _nothing_before(self) -> Column:
        """What ``_carried`` gives the only bucket of an order."""
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        sums = F.array(*(F.lit(0) for _ in self.spec.sums)).cast(f"array<{_SUM_TYPE}>")
        held = F.lit(self.rows).cast("bigint")
        figures = {"held": held, "rows": zero, "distinct": zero, "start": none, "end": none, "sums": sums}
        return F.struct(*(figure.alias(name) for name, figure in figures.items()))

    # -- layout

    def arrange(self) -> DataFrame:
        """The measured rows in this order, one bucket per partition."""
        if self._buckets == 1:
            known = self._table.withColumns({self._bucket: F.lit(0), self._before: self._nothing_before()})
        else:
            bucket = F.shiftright(self._at, _PLACE_BITS).cast("int")
            known = self._table.withColumn(self._bucket, bucket).join(self._small(self._offsets), self._bucket)
        return known.repartitionById(self._buckets, F.col(self._bucket)).sortWithinPartitions(
            F.col(self._bucket), *(key.sort() for key in self.spec.keys)
        )

    # -- figures on an arranged frame

    def _carry(self, name: str) -> Column:
        return F.col(f"{self._before}.{name}")

    def _inherits(self) -> Column:
        if not self.spec.within or self._buckets == 1:
            return F.lit(True)
        group = F.struct(*(k.column.alias(f"g{i}") for i, k in enumerate(self.spec.groups)))
        return group.eqNullSafe(self._carry("group"))

    def _window(self, total: bool) -> Any:
        keys = [self.spec.by, *(self.spec.ties if total else ())]
        groups = (key.column for key in self.spec.groups)
        return W.partitionBy(self._bucket, *groups).orderBy(*(k.sort() for k in keys))

    def _added(self, local: Column, before: Column) -> Column:
        return local + F.when(self._inherits(), before).otherwise(F.lit(0))

    def rank(self) -> Column:
        local = F.rank().over(self._window(total=False))
        crossed = self._inherits() & (local == 1) & self._carry("start").isNotNull()
        return F.when(crossed, self._carry("start") + 1).otherwise(self._added(local, self._carry("rows")))

    def dense_rank(self) -> Column:
        if not self.spec.dense:
            raise ValueError("measure the order with dense=True")
        return self._added(F.dense_rank().over(self._window(total=False)), self._carry("distinct"))

    def row_number(self) -> Column:
        return self._added(F.row_number().over(self._window(total=True)), self._carry("rows"))

    def running_sum(self, name: str) -> Column:
        at = self.spec.sums.index(name)
        window = self._window(total=True).rowsBetween(W.unboundedPreceding, W.currentRow)
        local = F.coalesce(F.sum(Key(name).column).over(window), F.lit(0))
        return self._added(local, self._carry("sums")[at])

    def last_peer(self) -> Column:
        """The position of the last row with the same sort value; ``rank`` is that of the first."""
        self._whole("the last peer")
        local = F.count("*").over(self._window(total=False))
        crosses = (local == self._carry("held")) & self._carry("end").isNotNull()
        return F.when(crosses, self._carry("end")).otherwise(self._carry("rows") + local)

    def average_rank(self) -> Column:
        """The mean position of all rows with the same sort value."""
        return (self.rank() + self.last_peer()).cast("double") / 2

    def cume_dist(self) -> Column:
        self._whole("cume_dist")
        return self.last_peer().cast("double") / F.lit(float(max(self.rows, 1)))

    def percent_rank(self) -> Column:
        self._whole("percent_rank")
        return (self.rank() - 1).cast("double") / F.lit(float(max(self.rows - 1, 1)))

    def ntile(self, tiles: int, number: Column, reverse: bool = False) -> Column:
        """NTILE from the ``row_number`` column already added to the arranged frame.

        ``reverse`` numbers the tiles as if the whole order were turned round.
        """
        self._whole("ntile")
        if reverse:
            number = F.lit(self.rows + 1) - number
        small, extra = divmod(self.rows, tiles)
        place, larger = number - 1, extra * (small + 1)
        in_larger = F.floor(place / F.lit(small + 1)) + 1
        in_small = F.floor((place - larger) / F.lit(max(small, 1))) + 1 + extra
        return F.when(place < larger, in_larger).otherwise(in_small).cast("bigint")

    def _whole(self, what: str) -> None:
        if self.spec.within:
            raise ValueError(f"{what} is defined over the whole frame only")

    # -- single rows of the order

    def _places(self, positions: Iterable[int]) -> dict[int, int]:
        """The number a row was written with, for each 1-based position."""
        self._whole("a position")
        low, high = F.col("before"), F.col("before") + F.col("held")
        wanted = F.array(*(F.lit(p).cast("bigint") for p in sorted(set(positions))))
        inside = F.filter(wanted, lambda p: (p > low) & (p <= high))
        at = F.shiftleft(F.col("bucket").cast("bigint"), _PLACE_BITS) + F.col("position") - F.col("before") - 1
        found = self._held.select("bucket", "before", F.explode(inside).alias("position"))
        return {r["position"]: r["at"] for r in found.select("position", at.alias("at")).collect()}

    def _rows_at(self, places: Iterable[int]) -> DataFrame:
        """Rows by the number they were written with: only the files that hold them are read."""
        return self._table.where(F.col(self._at).isin(list(places)))

    def _tile_starts(self, tiles: int) -> list[int]:
        small, extra = divmod(self.rows, tiles)
        sizes = [small + 1] * extra + [small] * (tiles - extra)
        starts = itertools.accumulate(sizes, initial=1)
        return [s for s in list(starts)[1:tiles] if s <= self.rows]

    def tile_column(self, tiles: int) -> Column:
        """NTILE without moving the frame: the number of tiles that start at or before a row. The rows they start with are
        looked up exactly and stay in Spark, with the types they have."""
        if not self._named_ties:
            raise ValueError("tiles need tie-break keys that the frame has")
        starts = self._tile_starts(tiles)
        if not starts:
            return F.lit(1).cast("bigint")
        places = self._places(starts).values()
        keys = F.struct(*(k.column.alias(f"k{i}") for i, k in enumerate(self.spec.keys)))
        cuts = self._rows_at(places).agg(F.collect_list(keys).alias("cuts")).scalar()
        reached = (_reached(self.spec.keys, F.get(cuts, F.lit(i))).cast("bigint") for i in range(len(places)))
        return sum(reached, F.lit(1).cast("bigint"))


def measure(
    frame: DataFrame, *specs: Spec, buckets: int | None = None, rows: int | None = None, keys_only: bool = False
) -> list[GlobalOrder]:
    """Lay ``frame`` out in every order. ``rows`` is its row count if known; with ``keys_only`` nothing but the
    sort keys and sums is written, enough for tiles and quantiles."""
    rows = frame.count() if rows is None else rows
    cores = frame.sparkSession.sparkContext.defaultParallelism
    spread = min(cores, max(MIN_BUCKETS, rows // SMALL_BUCKET))
    n = buckets or max(spread, rows // ROWS_PER_BUCKET)
    orders = []
    for spec in specs:
        names = dict.fromkeys([*(key.name for key in spec.keys), *spec.sums])
        narrow = frame.select(*(Key(name).column for name in names)) if keys_only else frame
        orders.append(GlobalOrder(narrow, spec, rows, n))
    return orders


def tile_columns(orders: Sequence[GlobalOrder], tiles: int) -> list[Column]:
    """NTILE of several orders, for the measured frame or any other with the same keys."""
    return [order.tile_column(tiles) for order in orders]


def quantiles(order: GlobalOrder, fractions: Sequence[float]) -> list[float | None]:
    """Exact quantiles of the sort value, linear between neighbours. No nulls, either direction."""
    if not order.rows:
        return [None for _ in fractions]
    spots = [f * (order.rows - 1) for f in fractions]
    positions = [[math.floor(s) + 1, math.ceil(s) + 1] for s in spots]
    if order.spec.by.desc:
        positions = [[order.rows + 1 - p for p in pair] for pair in positions]
    places = order._places(itertools.chain.from_iterable(positions))
    rows = order._rows_at(places.values()).select(order._at, order.spec.by.column.cast("double").alias("value"))
    values = {r[order._at]: r["value"] for r in rows.collect()}
    out = []
    for spot, (low, high) in zip(spots, positions):
        a, b = values[places[low]], values[places[high]]
        out.append(a + (b - a) * (spot - math.floor(spot)))
    return out
