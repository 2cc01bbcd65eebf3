"""One-call global window functions: the frame with one more column, in sort order.

Each call writes ``frame`` first unless ``written`` says it is a written table
already. To add several figures of one order, use ``ordering.measure`` once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import safe_pct
from salesloom.operators.lookups import total
from salesloom.operators.materialize import materialize
from salesloom.operators.ordering import GlobalOrder, Key, Spec, measure


def _arranged(frame: DataFrame, spec: Spec, written: bool) -> tuple[DataFrame, GlobalOrder]:
    table = frame if written else materialize(frame)
    (order,) = measure(table, spec)
    return order.arrange(), order


def _only(frame: DataFrame, before: DataFrame, out: str) -> DataFrame:
    return frame.select(*before.columns, out)


def _ties(ties: Sequence[str]) -> tuple[Key, ...]:
    return tuple(Key(t) for t in ties)


def global_rank(
    frame: DataFrame,
    by: str,
    desc: bool = True,
    dense: bool = False,
    ties: Sequence[str] = (),
    within: Sequence[str] = (),
    out: str = "rank",
    written: bool = False,
) -> DataFrame:
    """RANK or DENSE_RANK. ``ties`` do not change it; without them rows of one value are spread by their number."""
    spec = Spec(Key(by, desc), _ties(ties), within=tuple(within), dense=dense)
    arranged, order = _arranged(frame, spec, written)
    figure = order.dense_rank() if dense else order.rank()
    return _only(arranged.withColumn(out, figure), frame, out)


def global_row_number(
    frame: DataFrame,
    by: str,
    ties: Sequence[str],
    desc: bool = False,
    out: str = "row_number",
    written: bool = False,
) -> DataFrame:
    arranged, order = _arranged(frame, Spec(Key(by, desc), _ties(ties)), written)
    return _only(arranged.withColumn(out, order.row_number()), frame, out)


def global_ntile(
    frame: DataFrame,
    by: str,
    tiles: int,
    ties: Sequence[str],
    desc: bool = False,
    out: str = "ntile",
    written: bool = False,
) -> DataFrame:
    arranged, order = _arranged(frame, Spec(Key(by, desc), _ties(ties)), written)
    numbered = arranged.withColumn(out, order.row_number())
    return _only(numbered.withColumn(out, order.ntile(tiles, F.col(out))), frame, out)


def global_cume_dist(
    frame: DataFrame,
    by: str,
    desc: bool = False,
    ties: Sequence[str] = (),
    out: str = "cume_dist",
    written: bool = False,
) -> DataFrame:
    arranged, order = _arranged(frame, Spec(Key(by, desc), _ties(ties)), written)
    return _only(arranged.withColumn(out, order.cume_dist()), frame, out)


def global_percent_rank(
    frame: DataFrame,
    by: str,
    desc: bool = False,
    ties: Sequence[str] = (),
    out: str = "percent_rank",
    written: bool = False,
) -> DataFrame:
    arranged, order = _arranged(frame, Spec(Key(by, desc), _ties(ties)), written)
    return _only(arranged.withColumn(out, order.percent_rank()), frame, out)


def running_share(
    frame: DataFrame,
    value: str,
    ties: Sequence[str],
    places: int = 1,
    out: str = "running_share",
    written: bool = False,
) -> DataFrame:
    """Share of the total held by a row and all larger ones, in per cent."""
    table = frame if written else materialize(frame)
    spec = Spec(Key(value, desc=True), _ties(ties), sums=(value,))
    arranged, order = _arranged(table, spec, written=True)
    share = safe_pct(F.col(out), total(table, F.sum(value)), places)
    running = arranged.withColumn(out, order.running_sum(value))
    return _only(running.withColumn(out, share), frame, out)
