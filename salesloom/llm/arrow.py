"""Rows through Arrow without large batches on the Python side."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

OUT_BYTES = 8 << 20
IN_ROWS = 256


def map_arrow(
    frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``, with workers that look for this package where the driver has it, too.

    On a cluster ship the package with ``--py-files``; a path that a machine lacks does no harm.
    """
    root, workers = str(Path(__file__).resolve().parents[2]), frame.sparkSession.sparkContext.environment
    known = workers.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        workers["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return frame.mapInArrow(run, schema)


def small_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, IN_ROWS at a time at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, IN_ROWS):
            yield batch.slice(start, IN_ROWS)


def sized_slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Like `small_slices`, and no slice of several rows has more than ``most`` bytes in ``column``."""
    for part in small_slices(batches):
        sizes = pc.fill_null(pc.binary_length(part[column]), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield part.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield part.slice(start)


class Collector:
    """Gathers rows and says when a batch is full."""

    def __init__(self, schema: pa.Schema):
        self._schema, self._columns, self._bytes = schema, [[] for _ in schema], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        for column, value in zip(self._columns, row):
            column.append(value)
        self._bytes += size
        return self._bytes >= OUT_BYTES

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(column, f.type) for column, f in zip(self._columns, self._schema)]
        self._columns, self._bytes = [[] for _ in self._schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self._schema)
