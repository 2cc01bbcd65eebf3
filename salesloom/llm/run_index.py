"""Removal of long byte strings that occur more than once, over run-compressed suffix indexes.

The corpus is cut so that equal strings meet. In every window of LENGTH bytes the least GRAM-byte gram by hash is its
anchor; two equal windows choose the same one. So all windows fall to regions, one per anchor and stretch of windows that chose it,
and equal windows lie in regions of equal anchors. Regions are dealt to blocks by their anchor's hash; the distinct regions
of a block are indexed together.

The index of a block is the run-length Burrows-Wheeler transform of its regions: suffixes are sorted by prefix
doubling, and only the ends of runs keep a sampled position. Matching statistics are streamed from those samples: where a run
begins, the length a suffix shares with the one before it is compared; elsewhere it is one less than the value before it
in the text. The same holds for the suffix after it and the ends of runs. A window is repeated if
one of the two reaches LENGTH, or if its whole region occurs again.

The regions of an anchor whose regions hold more than BLOCK_BYTES are not indexed: each of their windows is counted by its digest,
so their number under one anchor bounds no task.

Anchors that occur once cannot bear a repeat. They are recognised with a bitmap of fixed greatest size; a chance hit costs
work and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.arrow import Collector, map_arrow, sized_slices, small_slices
from salesloom.llm.tables import bulky
from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

LENGTH = 200
GRAM = 50
BITMAP_BITS = (20, 28)  # least and greatest: at most 32 MB
_BITMAP_PIECES = 32
BLOCK_BYTES = 2 << 20  # of an anchor that are still indexed
INDEX_BYTES = 128 << 10  # that a block is filled to: its arrays then stay in the processor's cache
SLICE_BYTES = 128 << 10  # of text that anchors are chosen in at once; numpy holds some hundred bytes for each
COMBINE_BYTES = 48 << 20  # that a task holds of different regions, with what Python needs for each
_HELD_BYTES = 400

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_LETTERS = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _KNOWN_POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, _U)
        steps[0] = 1
        known = _KNOWN_POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: of twice as many each time, the last two overlap."""
    n, reach = len(x) - width + 1, 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach : width - reach + n])


def regions(data: np.ndarray, borders: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Regions of texts laid end to end: (anchor hash, text number, first window, number of windows).

    Windows do not cross ``borders``. The anchor of a window is the leftmost of its grams with the least hash.
    """
    n = len(data) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty.astype(_U), empty, empty, empty
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS.take(data) * _powers(_BASE, len(data)), out=sums[1:])
    grams = len(data) - gram + 1
    hashes = _mix((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, grams))
    # place in the low bits: the leftmost wins a tie, and the winner can be read off. Always as many bits, as equal windows of
    # other slices must choose alike
    low = _U(32)
    ranked = (hashes >> low << low) | np.arange(grams, dtype=_U)
    least = _sliding_least(ranked, length - gram + 1)
    # a region starts with a text or where the winner changes, and ends with the last window inside its text
    edge = np.append(True, least[1:] != least[:-1])
    edge[borders[:-1][borders[:-1] < n]] = True
    first = np.flatnonzero(edge)
    text = np.searchsorted(borders, first, side="right") - 1
    windows = np.minimum(np.append(first[1:], n), borders[text + 1] - (length - 1)) - first
    inside = windows > 0
    first = first[inside]
    return hashes[(least[first] & ((_U(1) << low) - _U(1))).astype(np.int64)], text[inside], first, windows[inside]


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice of texts end to end, and their borders."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start, stop = int(borders[0]), int(borders[-1])
    if start == stop:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[start:stop], borders - start


def _anchors(rows: DataFrame) -> DataFrame:
    """anchor: hashes that occur in two regions or more."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_slices(batches, "text", SLICE_BYTES):
            found, times = np.unique(regions(*_laid_out(part["text"]))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], schema=schema)

    each = map_arrow(rows.select("text"), find, "anchor long, n long")
    return each.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


class Bitmap:
    """Which hashes may be in a set."""

    def __init__(self, bits: int, words: np.ndarray):
        self._shift, self._words = _U(64 - bits), words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (_mix(hashes) >> self._shift).astype(np.int64)
        return (self._words[at >> 3] >> (at & 7)) & 1 == 1


def _bitmap(anchors: DataFrame) -> Bitmap:
    """Built in pieces by tasks, 64 bits for each anchor within BITMAP_BITS; the driver gets the finished pieces."""
    written = materialize(anchors)
    bits = min(max((64 * max(1, written.count()) - 1).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    piece_bits = bits - _BITMAP_PIECES.bit_length() + 1
    piece_bytes = 1 << (piece_bits - 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (_mix(batch["anchor"].to_numpy(zero_copy_only=False).view(_U)) >> _U(64 - bits)).astype(np.int64)
            for piece in np.unique(at >> piece_bits).tolist():
                inside = at[at >> piece_bits == piece] & ((1 << piece_bits) - 1)
                words = made.setdefault(piece, np.zeros(piece_bytes, np.uint8))
                np.bitwise_or.at(words, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for piece, words in made.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["piece", "words"]
            )

    # tasks may each hold a part of a piece; there are few tasks and their parts are or-ed here
    parts = map_arrow(written.coalesce(4), place, "piece int, words binary").collect()
    whole = np.zeros((_BITMAP_PIECES, piece_bytes), np.uint8)
    for r in parts:
        whole[r["piece"]] |= np.frombuffer(r["words"], np.uint8)
    return Bitmap(bits, whole.ravel())


def _occurrences(rows: DataFrame, bitmap: Bitmap) -> DataFrame:
    """key, first, windows, anchor, bytes: the regions whose anchor may occur again."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # of bounded size
    schema = pa.schema(
        [("key", pa.binary()), ("first", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()), ("bytes", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        for part in sized_slices(batches, "text", SLICE_BYTES):
            data, borders = _laid_out(part["text"])
            anchor, text, first, windows = regions(data, borders)
            near = shared.value.holds(anchor)
            raw, keys = data.tobytes(), part["key"].to_pylist()
            found = (anchor[near].view(np.int64), text[near], first[near], windows[near])
            for a, t, f, w in zip(*(x.tolist() for x in found)):
                body = raw[f : f + w + LENGTH - 1]
                if out.add((keys[t], f - int(borders[t]), w, a, body), len(body) + 64):
                    yield out.take()
        yield out.take()

    return map_arrow(
        rows.select("key", "text"), cut, "key binary, first long, windows int, anchor long, bytes binary"
    )


def suffix_order(data: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, by prefix doubling. ``owner`` numbers the region of each byte; a suffix ends
    where its region does, and equal ends are ordered by region."""
    n = len(data)
    bits = n.bit_length()
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    room = (np.repeat(last + 1, np.diff(last, prepend=-1)) - np.arange(n)).astype(np.int32)
    # first key: as many letters of the region as fit, numbered from 1 among those of the block, then 0 from the end on
    code = np.cumsum(np.bincount(data, minlength=256) > 0)
    base, most, step = int(code[-1]) + 1, 1 << (64 - _place_bits(bits)), 1
    while base ** (step + 1) <= most and step < n:
        step += 1
    letters = np.zeros(n + step, _U)
    letters[:n] = code[data]
    key = letters[:n].copy()
    for j in range(1, step):
        key *= _U(base)
        key += letters[j : j + n]
    short = np.flatnonzero(room < step)
    key[short] = 0
    for j in range(step):
        key[short] = key[short] * _U(base) + letters[short + j] * (room[short] > j)
    key, order = _sorted_keys(key, np.arange(n), bits)
    # suffixes that end within the first key are in their place: ties go by position, so by region
    head = np.append(True, key[1:] != key[:-1]) | (room < step)[order]
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        # only suffixes that share their rank are looked at again, in the order of the text: most reads are neighbours
        open_at = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_at):
            return order
        part = np.sort(order[open_at])
        # a suffix that ends here comes before all that go on; shorter ones are in their place
        second = np.where(room[part] > step, rank[part + step] + 1, 0)
        key = rank[part].astype(_U) << _U(bits) | second.astype(_U)
        key, part = _sorted_keys(key, part, bits)
        order[open_at] = part
        new_head = np.append(True, key[1:] != key[:-1]) | (key & _U((1 << bits) - 1) == 0)
        head[open_at] = new_head
        rank[part] = np.maximum.accumulate(np.where(new_head, open_at, 0))
        step *= 2


def _place_bits(bits: int) -> int:
    """Low bits of a key that take its position, if two ranks and a position of ``bits`` bits fit in 64."""
    return bits if 3 * bits <= 64 else 0


def _sorted_keys(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the positions ``at`` (ascending) in theirs; equal keys by position. Plain words sort several times faster
    than an index to them."""
    low = _U(_place_bits(bits))
    if low:
        both = np.sort(key << low | at.astype(_U))
        return both >> low, (both & _U((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], at[order]


def shared_with_neighbours(data: np.ndarray, owner: np.ndarray, limit: int) -> np.ndarray:
    """For every position the longest string from it, inside its region, that occurs elsewhere in the block, exact up to
    ``limit`` and at least ``limit`` beyond.

    ``order`` gives the Burrows-Wheeler transform; its runs are found, positions are sampled at their ends, and lengths are
    compared at the samples only.
    """
    n = len(data)
    order = suffix_order(data, owner)
    begins = np.append(True, owner[1:] != owner[:-1])
    # the letter before a suffix; the first of a region differs from all
    transform, first = np.append(data[:1], data[:-1])[order], begins[order]
    # a run ends at border, the next begins after it
    border = np.flatnonzero((transform[1:] != transform[:-1]) | first[1:] | first[:-1])
    ends = (np.flatnonzero(np.append(begins[1:], True)) + 1)[owner]
    above, below = order[border], order[border + 1]
    common = _compared(data, ends, above, below)
    # the run's end meets the suffix after it, the next run's start the one before it
    reach = np.zeros(n, np.int64)
    reach[above] = common + above
    reach[below] = np.maximum(reach[below], common + below)
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def _compared(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of suffixes ``a`` and ``b``, eight bytes at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()
    room = np.minimum(ends[a] - a, ends[b] - b)
    common = np.zeros(len(a), np.int64)
    going = np.flatnonzero(room > 0)
    while len(going):
        differs = eight[a[going] + common[going]] ^ eight[b[going] + common[going]]
        # bits below the first that differs; all 64 if none does
        same = np.bitwise_count((differs & (~differs + _U(1))) - _U(1)) >> 3
        common[going] += same
        going = going[(same == 8) & (common[going] < room[going])]
    return np.minimum(common, room)


def repeated_windows(parts: list[bytes], counts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of distinct regions occur again: in another place of these regions, or with the whole region.

    (number, first, end) for each stretch of such windows, in order.
    """
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner, stop = np.repeat(np.arange(len(parts)), sizes), np.cumsum(sizes)
    found = shared_with_neighbours(data, owner, length) >= length
    found |= (np.array(counts) > 1)[owner]
    found &= stop[owner] - np.arange(len(data)) >= length  # no window crosses a region's end, so no stretch does
    edges = np.diff(found.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    number = owner[first]
    start = (stop - sizes)[number]
    return number, first - start, end - start


def _combined(found: DataFrame) -> DataFrame:
    """anchor, crowded, region, bytes, n: the regions of ``found``, each once for every COMBINE_BYTES of different ones that a task
    reads."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("crowded", pa.bool_()), ("region", pa.binary()), ("bytes", pa.binary()), ("n", pa.int64())]
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            out = Collector(schema)
            while held:  # what is handed on is no longer held
                region, (anchor, crowded, body, n) = held.popitem()
                if out.add((anchor, crowded, region, body, n), len(body) + _HELD_BYTES):
                    yield out.take()
            yield out.take()

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("anchor", "crowded", "region", "bytes"))
            for anchor, crowded, region, body in zip(*columns):
                known = held.get(region)
                if known:
                    known[3] += 1
                    continue
                held[region] = [anchor, crowded, body, 1]
                size += len(body) + _HELD_BYTES
            if size >= COMBINE_BYTES:
                yield from flushed()
                size = 0
        yield from flushed()

    kinds = "anchor long, crowded boolean, region binary, bytes binary, n long"
    return map_arrow(found.select("anchor", "crowded", "region", "bytes"), combine, kinds)


def _crowded(found: DataFrame, block_bytes: int) -> DataFrame:
    """anchor: those whose regions, copies counted, hold more than ``block_bytes``; written."""
    held = found.groupBy("anchor").agg(F.sum(F.col("windows").cast("long") + (LENGTH - 1)).alias("bytes"))
    return materialize(held.where(F.col("bytes") > block_bytes).select("anchor"))


def _counted(windows: DataFrame) -> DataFrame:
    """region, stretches: the windows (region, at, window, n) whose digest occurs again, summed in tasks before they are dealt."""
    again = windows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
    places = windows.join(again, "window").groupBy("region").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # neighbouring places as one [first, end) pair
    edge = lambda k: F.filter("at", lambda x: ~F.array_contains("at", x + k))
    pairs = F.zip_with(edge(-1), edge(1), lambda a, b: F.array(a, b + 1))
    return places.select("region", F.flatten(pairs).alias("stretches"))


def _marked(distinct: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """region and stretches, the repeated windows of the regions that have any; or, for a region of a crowded anchor, a row for each window
    (at, window: its 128-bit digest, n). ``distinct`` is dealt by anchor, crowded ones by region, and sorted
    by anchor and region; rows of one region are counted together as they stream by."""
    schema = pa.schema(
        [("region", pa.binary()), ("stretches", pa.list_(pa.int32())), ("at", pa.int32()), ("window", pa.binary()), ("n", pa.int64())]
    )

    def index(parts: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        number, first, end = repeated_windows([p[1] for p in parts], [p[2] for p in parts])
        which, at = np.unique(number, return_index=True)
        pairs = pa.array(np.column_stack([first, end]).ravel(), pa.int32())
        stretches = pa.ListArray.from_arrays(pa.array(np.append(at, len(number)) * 2, pa.int32()), pairs)
        columns = [pa.array([parts[i][0] for i in which.tolist()], pa.binary()), stretches]
        columns += [pa.nulls(len(which), f.type) for f in list(schema)[2:]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # regions of one anchor stay in one index
        held, size, last, out = [], 0, None, Collector(schema)
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("region", "bytes", "n", "anchor", "crowded"))
            for region, body, n, anchor, crowded in zip(*columns):
                if crowded:
                    for at in range(len(body) - LENGTH + 1):
                        if out.add((region, None, at, hashlib.md5(body[at : at + LENGTH]).digest(), n)):
                            yield out.take()
                    continue
                if held and held[-1][0] == region:
                    held[-1] = (region, body, held[-1][2] + n)
                    continue
                if size >= min(block_bytes, INDEX_BYTES) and anchor != last:
                    yield index(held)
                    held, size = [], 0
                held.append((region, body, n))
                size += len(body)
                last = anchor
        if held:
            yield index(held)
        yield out.take()

    kinds = "region binary, stretches array<int>, at int, window binary, n long"
    return map_arrow(distinct, run, kinds)


def _keyed(docs: DataFrame, carry: list[Column] | None = None) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"), *(carry or []))


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, stretches: per different text with repeated windows their starts, as sorted [first, end) pairs, flat.

    ``docs`` has doc_id and text and is read twice. Equal rows count as separate places of their strings.
    """
    rows = _keyed(docs)
    bitmap = _bitmap(_anchors(rows))
    found = _occurrences(rows, bitmap).withColumn("region", F.unhex(F.md5("bytes")))
    found = bulky(found)
    crowded = _crowded(found, block_bytes)
    n_crowded = crowded.count()
    few = broadcast_up_to(crowded, n_crowded)
    flagged = found.join(few.withColumn("crowded", F.lit(True)), "anchor", "left") if n_crowded else found.withColumn("crowded", F.lit(False))
    # the regions of an anchor come to one task, those of a crowded one to any
    dealt = F.when(F.col("crowded"), F.xxhash64("region")).otherwise(F.col("anchor"))
    blocks = _combined(flagged).repartition(dealt).sortWithinPartitions("anchor", "region")
    made = materialize(_marked(blocks, block_bytes))
    marks = made.where("stretches IS NOT NULL").select("region", "stretches")
    if n_crowded:
        marks = marks.unionByName(_counted(made.where("window IS NOT NULL")))
    places = found.select("key", "first", "region").distinct()
    moved = places.join(marks, "region").select(
        "key", F.transform("stretches", lambda at: at + F.col("first")).alias("stretches")
    )
    return moved.groupBy("key").agg(F.array_sort(F.collect_list("stretches")).alias("stretches"))


def removed(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, text (what is left as a string, without characters that lost a byte), kept (binary: the text's bytes without the repeated ones), spans (removed [first, end) byte ranges, flat and in
    order) and n_bytes, for every row of ``docs`` (doc_id, text); and the columns ``carry``.

    A byte goes if a LENGTH-byte string that covers it also starts anywhere else in any row, as the texts were
    given. A null text is empty. Equal rows remove each other's bytes (all of a text of LENGTH bytes or more).
    Shorter texts stay whole. An empty table gives no rows.
    """
    rows = _keyed(docs, [F.col(c) for c in carry])
    marked = rows.join(repeats(docs), "key", "left").select("doc_id", "text", "stretches", *carry)
    kinds = dict(docs.dtypes)
    schema = ", ".join(
        ["doc_id long", *(f"`{c}` {kinds[c]}" for c in carry), "n_bytes long", "spans array<bigint>", "kept binary", "text string"]
    )
    names = ["doc_id", *carry, "n_bytes", "spans", "kept", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            sizes, spans, kept = [], [], []
            for text, stretches in zip(part["text"].to_pylist(), part["stretches"].to_pylist()):
                raw = text.encode()
                cuts = _covered(stretches or [])
                ends = [0, *cuts, len(raw)]
                sizes.append(len(raw))
                spans.append(cuts)
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
            columns = [part["doc_id"], *(part[c] for c in carry), pa.array(sizes, pa.int64())]
            columns += [pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(marked.withColumn("doc_id", F.col("doc_id").cast("long")), cut, schema)


def _covered(stretches: list[list[int]]) -> list[int]:
    """Bytes covered by the windows that start in the stretches, as maximal ranges, flat."""
    out: list[int] = []
    pairs = sorted((s[i], s[i + 1]) for s in stretches for i in range(0, len(s), 2))
    for first, end in pairs:
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end + LENGTH - 1)
        else:
            out += [first, end + LENGTH - 1]
    return out
