"""Packing of tokenised documents into sequences of a fixed length: best two fit.

Only lengths matter to the plan, and there are at most ``capacity`` of them; so the plan is made
from a histogram on the driver, whatever the number of documents. A sequence is filled greedily, longest
fitting piece first; then its shortest piece is replaced by the two unpacked pieces that fill the gap it leaves
more tightly, if there are any. As long as the lengths used last, the next sequence comes out the same, so
a pattern is repeated at once as often as the histogram allows.

Pieces find their place by a number among those of equal length, made without a task that holds a length: rows are
numbered in slices of a length, and a slice starts where the ones before it end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.arrow import Collector, map_arrow, small_slices
from salesloom.llm.bpe import read_ranks
from salesloom.operators.materialize import materialize

CAPACITY = 2048
END_OF_DOCUMENT = 0
SLICE_ROWS = 100_000


@dataclass
class Plan:
    """Where the n-th piece of a length goes: one entry per use of a length in a repeated pattern.

    Pieces number ``first`` .. of ``length`` go, ``each`` to a sequence, to sequences ``base``, ``base`` + 1, ...,
    side by side from ``offset``.
    """

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best two fit over ``counts`` (length -> pieces), lengths 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit a sequence of {capacity}")
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    lengths = np.arange(capacity + 1)
    out = Plan()
    while left.any():
        # at[v]: the longest length up to v of which a piece is left
        at = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        pattern, gap = {}, capacity
        while (length := int(at[min(gap, (length - 1) if pattern else gap)])) > 0:
            n = min(int(left[length]), gap // length)
            pattern[length] = n
            gap -= n * length
        _swap_smallest(pattern, gap, left, at)
        times = min(int(left[length]) // n for length, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            for column, value in (
                (out.length, length),
                (out.first, int(used[length])),
                (out.each, n),
                (out.base, out.sequences),
                (out.offset, offset),
            ):
                column.append(value)
            offset += n * length
            left[length] -= n * times
            used[length] += n * times
        out.sequences += times
    return out


def _swap_smallest(pattern: dict[int, int], gap: int, left: np.ndarray, at: np.ndarray) -> None:
    """Replace the shortest piece by two unpacked ones that fill its place and the gap better; longest first on a tie."""
    if gap == 0 or sum(pattern.values()) < 2:
        return
    small = min(pattern)
    room = gap + small
    free = left.copy()
    for length, n in pattern.items():
        free[length] -= n
    longest = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    one = np.flatnonzero(free[: room + 1] > 0)
    if not len(one):
        return
    two = longest[np.minimum(one, room - one)]
    alone = (two == one) & (free[one] < 2)
    two = np.where(alone, longest[np.maximum(one - 1, 0)], two)
    two = np.where(one + two <= room, two, 0)
    filled = np.where(two > 0, one + two, 0)
    best = len(filled) - 1 - int(np.argmax(filled[::-1]))
    if filled[best] <= small:
        return
    pattern[small] -= 1
    if not pattern[small]:
        del pattern[small]
    for length in (int(one[best]), int(two[best])):
        pattern[length] = pattern.get(length, 0) + 1


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's json file, text -> id: those that are found in a text before anything else."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError(f"{path}: an added token takes in what is around it")
    return {t["content"]: t["id"] for t in found}


def pieces(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, added: Mapping[str, int] = {}
) -> DataFrame:
    """Tokenised pieces of every row: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Texts are cut at the tokens of ``added`` first, which get their own ids; without them these are text like any other.
    A document is the ids of its whole text (null: none) and the end mark 0. If it is longer than
    ``capacity`` it is cut into full pieces, the first of which takes what is left over. Rows that repeat and
    null ids give pieces row by row. Columns besides doc_id and text are ignored.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, dict(added)))  # as large as the vocabulary
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, splitter, own = shared.value
        codec = tiktoken.Encoding("ranks", pat_str=splitter, mergeable_ranks=table, special_tokens=own)
        out = Collector(schema)
        for part in small_slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                ids = np.array([*codec.encode(text or "", allowed_special="all"), END_OF_DOCUMENT], "<u4")
                start, end, nth = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    cut = ids[start:end]
                    if out.add((doc_id, nth, start, len(cut), cut.tobytes()), 4 * len(cut) + 32):
                        yield out.take()
                    start, end, nth = end, end + capacity, nth + 1
        yield out.take()

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, piece int, start long, length long, ids binary",
    )


def packed(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``items`` with sequence_id and offset: every row in one sequence, gapless from 0, none over ``capacity``.

    ``items`` has ``length`` (1 to ``capacity``) and is read more than once, so it should be a written table. ``keys``
    order pieces of one length; rows with equal keys are placed in any order. An empty table gives no rows.
    The driver sees one row per length and slice; the plan sent to the tasks has a few entries per length.
    """
    spark = items.sparkSession
    slices = items.count() // SLICE_ROWS + 16
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    sizes = materialize(sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    made = plan(counts, capacity)
    order = np.lexsort((made.first, made.length))
    columns = {c: np.array(getattr(made, c), np.int64)[order] for c in ("length", "first", "each", "base", "offset")}
    shared = spark.sparkContext.broadcast(columns)

    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_slice").orderBy(*keys)
    numbered = sliced.withColumn("_nth", F.row_number().over(inside) - 1).join(starts, ["length", "_slice"])
    numbered = numbered.withColumn("_nth", F.col("_nth") + F.col("_start")).select(*items.columns, "_nth")
    out_schema = f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes)}, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        low = entries["length"] << 44 | entries["first"]
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            nth = batch["_nth"].to_numpy(zero_copy_only=False)
            entry = np.searchsorted(low, length << 44 | nth, side="right") - 1
            nth = nth - entries["first"][entry]
            each = entries["each"][entry]
            sequence = pa.array(entries["base"][entry] + nth // each)
            offset = pa.array(entries["offset"][entry] + nth % each * length)
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sequence, offset], names=names)

    return map_arrow(numbered, place, out_schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of each sequence, from rows of `packed` that carry ``ids``: at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        parts, F.lit("").cast("binary"), lambda whole, part: F.concat(whole, part["ids"])
    )
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
