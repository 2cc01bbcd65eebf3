"""Near-duplicate classes: consistent weighted sampling over TF-IDF word shingles, banded and verified.

1. Shingles of five words are hashed in numpy, a slice of rows at a time. How many documents hold a shingle is kept in a
   Count-Min sketch over all documents: its size is fixed and its error is a fixed share of the corpus,
   so weights behave alike at every size. A weight is tf x idf, idf = 1 + IDF_SPAN ln(N / df) / ln(1 + N): a shingle
   of one document weighs up to half as much again as one of all, so large groups of copies keep their likeness.
2. Signatures are improved consistent weighted samples (Ioffe): a sample for each slot over all shingles, however many. A hash
   of 16 bits first says between which bounds the draws of a shingle lie; only where these let it be the least of its text are the draws
   themselves made. A slot whose least draw is not below what was passed over is drawn again over all shingles, so nothing is left out.
3. Signatures are cut into bands. Texts that share a band form a bucket; pairs are never listed. In CENTRE_ROUNDS rounds every
   text meets the centres of each of its buckets, unless they are in one class already. Eight bits of each sample tell
   how alike the two can be (a pair at the limit is let through unless off by several standard deviations); for those that
   remain the weighted Jaccard similarity of both whole texts is worked out, and links merge classes.
4. The rounds only save work. Then the texts of every bucket that still holds several classes are dealt into cells of
   bounded size, so that any two of different classes meet in one cell of the first band they share. A cell compares
   its pairs by their samples, verifies the likeliest of each two classes first, merges what links, and gives at most one
   link for each of its texts. Texts are sent to cells only if a pass over the samples found them a partner.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.arrow import Collector, map_arrow, small_slices
from salesloom.llm.tables import Appended, Workspace
from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
SKETCH_ROWS, SKETCH_BITS = 4, 18
IDF_SPAN = 0.5
_BLOCKS = 16  # pieces that sketches are summed in
BROADCAST_KEYS = 200_000  # narrow rows of texts that share a band
CENTRE_ROUNDS = 2  # rounds of centres before all pairs that are still apart are looked at
CELL_ROWS = 512  # texts of a bucket that are compared with as many others in one cell
CELL_BYTES = 4 << 20  # of these texts
_ROUNDING = 1e-9  # a similarity that is the limit but for rounding reaches it
LEAST_AGREEMENT = 0.6  # of the samples, below which a pair is not looked at: 0.8 less four deviations

_U = np.uint64
_HASH_BITS = 56
_LOW = _U((1 << _HASH_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seeds(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(salt))


_LETTERS = _seeds(256, 11)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACES = _seeds(WORDS, 22) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


@dataclass
class Shingles:
    """Distinct shingles of a slice of documents, by document and hash: row, hash (56 bits), times."""

    rows: int
    row: np.ndarray
    hash: np.ndarray
    times: np.ndarray


def shingles(texts: pa.Array) -> Shingles:
    """Of up to 256 texts. Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of one to
    four words has one shingle, of them all; nulls and texts without words have none."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start, stop = int(borders[0]), int(borders[-1])
    if stop == start:
        empty = np.empty(0, _U)
        return Shingles(len(texts), empty.astype(np.int64), empty, empty.astype(np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[start:stop]
    borders = borders - start
    inside = ~_IS_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = borders[(borders > 0) & (borders < len(data))]
    before[edge] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    last = np.flatnonzero(inside & ~after) + 1
    # polynomial over the letters of a word, from prefix sums
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS[data] * _powers(_BASE, len(data)), out=sums[1:])
    words = _mix((sums[last] - sums[first]) * _powers(_INVERSE, len(data))[first])
    row = np.searchsorted(borders, first, side="right") - 1
    n = np.bincount(row, minlength=len(texts))
    starts = np.cumsum(n) - n
    # the j-th word of a shingle, 0 past the end of its document
    place = np.arange(len(words)) - starts[row]
    whole = (place + WORDS <= n[row]) | (place == 0)
    at = np.flatnonzero(whole)
    made = np.zeros(len(at), _U)
    room = n[row[at]] - place[at]
    for j in range(WORDS):
        made += np.where(room > j, words[np.minimum(at + j, len(words) - 1)] * _PLACES[j], _U(0))
    keys = np.sort((_mix(made) >> _U(64 - _HASH_BITS)) | (row[at].astype(_U) << _U(_HASH_BITS)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return Shingles(len(texts), (keys >> _U(_HASH_BITS)).astype(np.int64), keys & _LOW, times)


_SKETCH_SEEDS = _seeds(SKETCH_ROWS, 33) | _U(1)


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The counter of each hash in every row of the sketch."""
    rows = [(_mix(hashes * seed) >> _U(64 - SKETCH_BITS)).astype(np.int64) for seed in _SKETCH_SEEDS]
    return np.stack(rows)


@dataclass
class Frequencies:
    """Document counts of all shingles, as a Count-Min sketch, and the number of documents."""

    documents: int
    counts: np.ndarray

    def weights(self, found: Shingles) -> np.ndarray:
        held = np.minimum.reduce([row[cell] for row, cell in zip(self.counts, _cells(found.hash))])
        idf = 1 + IDF_SPAN * np.log(self.documents / np.clip(held, 1, self.documents)) / np.log1p(self.documents)
        return found.times * idf


def frequencies(texts: DataFrame) -> Frequencies:
    """Counted over every row of ``texts`` (text). Each task sends one sketch, in blocks that are then summed as they stream
    by; the driver gets one sketch, of fixed size."""
    size = 1 << SKETCH_BITS
    width = SKETCH_ROWS * size // _BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros((SKETCH_ROWS, size), np.int64), 0
        for part in small_slices(batches):
            found = shingles(part["text"])
            documents += found.rows
            for row, cells in zip(total, _cells(found.hash)):
                row += np.bincount(cells, minlength=size)
        blocks = total.reshape(_BLOCKS, width)
        if documents:
            yield from _blocks(((b, documents if b == 0 else 0, blocks[b]) for b in range(_BLOCKS)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        documents: dict[int, int] = {}
        for batch in batches:
            for block, n, counts in zip(*(batch[c].to_pylist() for c in ("block", "documents", "counts"))):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
                documents[block] = documents.get(block, 0) + n
        yield from _blocks((b, documents[b], sums[b]) for b in sorted(sums))

    schema = "block int, documents long, counts binary"
    parts = map_arrow(texts.select("text"), count, schema)
    summed = map_arrow(parts.repartition(_BLOCKS, "block"), add, schema)
    whole, documents = np.zeros((_BLOCKS, width), np.int64), 0
    for r in summed.collect():  # _BLOCKS rows
        whole[r["block"]] += np.frombuffer(r["counts"], np.int64)
        documents += r["documents"]
    return Frequencies(documents, whole.reshape(SKETCH_ROWS, size))


def _blocks(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int32()), ("documents", pa.int64()), ("counts", pa.binary())])
    for block, documents, counts in rows:
        columns = [pa.array([block], pa.int32()), pa.array([documents], pa.int64()), pa.array([counts.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


_GRID = 256  # equal parts of a draw's distribution that 8 bits of a hash tell apart
_PASSED = 5.0  # the least draw of a text lies above _PASSED / (sum of its weights) in 0.7 % of its slots
_LANES = 4  # slots that one hash serves
_POINTS = np.concatenate([[0.0], np.geomspace(1e-6, 60, 16_384)])
_SHARES = -np.expm1(np.log1p(_POINTS) - _POINTS)  # of the distribution Gamma(2, 1) up to each point


def _gamma(share: np.ndarray) -> np.ndarray:
    """The quantile of Gamma(2, 1), by linear interpolation."""
    return np.interp(share, _SHARES, _POINTS)


def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of the draws r and c, in order of the least c e^-r there: their parts, and that least."""
    edges = np.append(_gamma(np.arange(_GRID) / _GRID), np.inf)
    floor = (np.exp(-edges[1:])[:, None] * edges[None, :-1]).ravel()
    order = np.argsort(floor, kind="stable")
    return order // _GRID, order % _GRID, floor[order]


_CELL_R, _CELL_C, _FLOOR = _grid()
_COARSE_SEEDS, _FINE_SEEDS = _seeds(SLOTS // _LANES, 44), _seeds(SLOTS, 55)


def _identity(hashes: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _mix(hashes ^ (t.astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93)))


def _drawn(hashes: np.ndarray, log_weight: np.ndarray, seeds: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: for each shingle and slot the logarithm of ``a`` (the least one wins) and the step t.
    ``cell`` holds the first bits of r and c."""
    bits = _mix(hashes * _U(_BASE) + seeds)
    fine = [((bits >> _U(shift)) & _U((1 << 21) - 1)).astype(np.float64) + 0.5 for shift in (43, 22, 1)]
    r, c = (_gamma((part[cell] + f / (1 << 21)) / _GRID) for part, f in ((_CELL_R, fine[0]), (_CELL_C, fine[1])))
    beta = fine[2] / (1 << 21)
    t = np.floor(log_weight / r + beta)
    return np.log(c) - r * (t - beta) - r, t


def _samples(found: Shingles, weights: np.ndarray) -> np.ndarray:
    """A sample per slot over all shingles of each document; rows without shingles hold zeros.

    ``a`` is at least c e^-r / weight. So shingles whose cell has a floor above weight times the
    bound of their document need no draw, if the least draw then found lies below that bound.
    """
    out = np.zeros((found.rows, SLOTS), _U)
    if not len(found.row):
        return out
    log_weight, n = np.log(weights), np.bincount(found.row, minlength=found.rows)
    total = np.bincount(found.row, weights, minlength=found.rows)
    bound = _PASSED / np.where(n > 0, total, 1)
    highest = (np.searchsorted(_FLOOR, weights * bound[found.row], side="right") - 1).astype(np.uint16)[:, None]
    start = np.cumsum(n) - n
    for group, seed in enumerate(_COARSE_SEEDS):
        cells = _mix(found.hash * _U(_BASE) + seed).view(np.uint16).reshape(-1, _LANES)
        least = np.full(found.rows * _LANES, np.inf)
        chosen = np.zeros(found.rows * _LANES, _U)

        def draw(at: np.ndarray, lane: np.ndarray) -> None:
            slot = found.row[at] * _LANES + lane
            log_a, t = _drawn(found.hash[at], log_weight[at], _FINE_SEEDS[group * _LANES + lane], cells[at, lane])
            np.minimum.at(least, slot, log_a)
            hit = np.flatnonzero(log_a == least[slot])
            chosen[slot[hit]] = _identity(found.hash[at[hit]], t[hit])

        likely = np.flatnonzero(cells <= highest)
        draw(likely // _LANES, likely % _LANES)
        open_ = np.flatnonzero((least >= np.repeat(np.log(bound), _LANES)) & np.repeat(n > 0, _LANES))
        for some in np.array_split(open_, max(1, len(open_) // 64)):
            held = n[some // _LANES]
            nth = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            draw(np.repeat(start[some // _LANES], held) + nth, np.repeat(some % _LANES, held))
        out[:, group * _LANES : (group + 1) * _LANES] = chosen.reshape(-1, _LANES)
    return out


def _bands(slots: np.ndarray, salt: int) -> np.ndarray:
    parts = slots.reshape(len(slots), BANDS, ROWS)
    seeds = _seeds(BANDS * ROWS, salt).reshape(BANDS, ROWS) | _U(1)
    return _mix((parts * seeds).sum(axis=2, dtype=_U) + _seeds(BANDS, salt + 1)).view(np.int64)


def signed(found: Shingles, weights: np.ndarray) -> tuple[list[list[int]], list[bytes | None]]:
    """Of each document the band hashes and the low byte of every sample; none and null without words."""
    slots, worded = _samples(found, weights), np.bincount(found.row, minlength=found.rows) > 0
    low = slots.astype(np.uint8)
    bands = [band if has else [] for band, has in zip(_bands(slots, 77).tolist(), worded)]
    return bands, [low[i].tobytes() if has else None for i, has in enumerate(worded)]


def _keyed(docs: DataFrame, *carry: str) -> DataFrame:
    """Rows with their text (null: empty) and its 128-bit digest as ``key``: copies share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"), *carry)


def _signatures(rows: DataFrame, df: Frequencies, held: Workspace) -> DataFrame:
    """key, bands and samples (their low bytes) of every different text with words; written."""
    shared = rows.sparkSession.sparkContext.broadcast(df)  # of fixed size
    schema = pa.schema([("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("samples", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = shared.value, Collector(schema)
        for part in small_slices(batches):
            found = shingles(part["text"])
            bands, samples = signed(found, known.weights(found))
            for row in zip(part["key"].to_pylist(), bands, samples):
                if row[1] and out.add(row, 8 * len(row[1]) + 96):
                    yield out.take()
        yield out.take()

    made = map_arrow(rows.select("key", "text"), sign, "key binary, bands array<bigint>, samples binary")
    return held.table(made.dropDuplicates(["key"]))


def _buckets(signatures: DataFrame) -> DataFrame:
    """band, key: bands that at least two different texts share."""
    each = signatures.select("key", F.explode("bands").alias("band"))
    shared_bands = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return each.join(shared_bands, "band")


def _agreement(offers: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``alike`` to the pairs (key, centre, ...): the share of samples that agree; pairs below LEAST_AGREEMENT go."""
    kept = offers.columns
    ours = marks.select("key", "samples")
    theirs = marks.select(F.col("key").alias("centre"), F.col("samples").alias("samples_"))
    met = offers.join(theirs, "centre").join(ours, "key").select(*kept, "samples", "samples_")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("samples", "samples_")
            )
            agree = (a == b).mean(axis=1)
            near = pa.array(agree >= LEAST_AGREEMENT)
            out = [batch[c].filter(near) for c in kept] + [pa.array(agree).filter(near)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "alike"])

    types = dict(offers.dtypes)
    return map_arrow(met, compare, ", ".join(f"{c} {types[c]}" for c in kept) + ", alike double")


def _dealt(buckets: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """band, one, two, block and the columns of ``texts`` (key, size, ...): the texts of buckets with several classes, in cells.

    The members of a bucket's largest class need not meet each other: they and the others are dealt into blocks, and each block of
    others meets itself, its like and the blocks of the largest class.
    """
    placed = buckets.join(classes, "key").join(texts.select("key", "size"), "key")
    by_class = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    total = by_class.groupBy("band").agg(
        F.count("*").alias("classes"),
        F.sum("n").alias("n"),
        F.sum("size").alias("size"),
        F.max(F.struct("n", "size", "root")).alias("most"),
    )
    blocks = lambda n, size: F.greatest(F.ceil(n / CELL_ROWS), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    mixed = total.where("classes > 1").select(
        "band",
        F.col("most.root").alias("largest"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("others"),
        blocks(F.col("most.n"), F.col("most.size")).alias("inside"),
    )
    own = F.col("root") == F.col("largest")
    dealt = placed.drop("size").join(mixed, "band").withColumn(
        "block",
        F.when(own, F.col("others") + F.pmod(F.xxhash64("key"), F.col("inside"))).otherwise(F.pmod(F.xxhash64("key"), F.col("others"))).cast("int"),
    )
    meets = F.sequence(F.lit(0), F.when(own, F.col("others") - 1).otherwise(F.col("others") + F.col("inside") - 1))
    each = dealt.withColumn("other", F.explode(meets)).select(
        "band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "key", "root"
    )
    return each.join(texts, "key")


class _Cell:
    """The texts of one cell: which pairs may be alike, and which are."""

    def __init__(self, band: int, one: int, two: int, rows: list[dict]):
        self._one, self._two, self.rows = one, two, rows
        number = {r: i for i, r in enumerate({row["root"] for row in rows})}
        self.classes = np.array([number[row["root"]] for row in rows])
        self._block = np.array([row["block"] for row in rows])
        self._marks = np.frombuffer(b"".join(row["samples"] for row in rows), np.uint8).reshape(-1, SLOTS)
        self._bands = np.array([row["bands"] for row in rows])
        self._here = self._bands == band

    def partners(self, i: int) -> np.ndarray:
        """Texts of other classes that may be as alike to ``i`` as asked, likeliest first: those whose first common band is this one."""
        if self._block[i] != self._one:
            return np.empty(0, np.int64)
        apart = self._block == self._two
        if self._one == self._two:
            apart[: i + 1] = False
        at = np.flatnonzero(apart & (self.classes != self.classes[i]))
        if not len(at):
            return at
        agree = (self._marks[at] == self._marks[i]).mean(axis=1)
        first = (self._bands[at] == self._bands[i]).argmax(axis=1)
        kept = (agree >= LEAST_AGREEMENT) & self._here[at, first]
        return at[kept][np.argsort(-agree[kept], kind="stable")]

    def joined(self, i: int, j: int) -> None:
        self.classes[self.classes == self.classes[j]] = self.classes[i]


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[_Cell]:
    rows = (row for batch in batches for row in batch.to_pylist())
    for (band, one, two), members in itertools.groupby(rows, key=lambda row: (row["band"], row["one"], row["two"])):
        yield _Cell(band, one, two, list(members))  # bounded by CELL_ROWS and CELL_BYTES


def _in_cells(cells: DataFrame) -> DataFrame:
    names = ["band", "one", "two"]
    return cells.repartition(*names).sortWithinPartitions(*names)


def _with_partners(cells: DataFrame) -> DataFrame:
    """key: the texts that have a partner in a cell."""
    schema = pa.schema([("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        for cell in _each_cell(batches):
            found = np.zeros(len(cell.rows), bool)
            for i in range(len(cell.rows)):
                partners = cell.partners(i)
                found[partners] = True
                found[i] |= len(partners) > 0
            for i in np.flatnonzero(found).tolist():
                if out.add((cell.rows[i]["key"],)):
                    yield out.take()
        yield out.take()

    return map_arrow(_in_cells(cells), run, "key binary").distinct()


def _links_in_cells(cells: DataFrame, df: Frequencies, similarity: float) -> DataFrame:
    """a, b: verified links, at most one for each text of a cell: they join the classes that all links of the cell join."""
    shared = cells.sparkSession.sparkContext.broadcast(df)  # of fixed size
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = Collector(schema), shared.value
        for cell in _each_cell(batches):
            vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in vectors:
                    found = shingles(pa.array([cell.rows[i]["text"]], pa.string()))
                    vectors[i] = (found.hash, known.weights(found))
                return vectors[i]

            for i in range(len(cell.rows)):
                at = cell.partners(i)
                while len(at):
                    # the likeliest of each other class; the rest of a class only if that one was not alike
                    nearest = np.sort(np.unique(cell.classes[at], return_index=True)[1])
                    for j in at[nearest].tolist():
                        if cell.classes[i] != cell.classes[j] and _alike(vector(i), vector(j)) >= similarity - _ROUNDING:
                            cell.joined(i, j)
                            if out.add((cell.rows[i]["key"], cell.rows[j]["key"])):
                                yield out.take()
                    at = np.delete(at, nearest)
                    at = at[cell.classes[at] != cell.classes[i]]
        yield out.take()

    return map_arrow(_in_cells(cells), run, "a binary, b binary")


def _alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two vectors of distinct hashes, in order, and weights."""
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(one[1][a], two[1][b]).sum())
    return common / max(float(one[1].sum() + two[1].sum()) - common, 1e-300)


def similarities(a: pa.Array, b: pa.Array, df: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; of two texts without words, 0."""
    one, two = shingles(a), shingles(b)
    weight = [df.weights(one), df.weights(two)]
    keys = [(f.row.astype(_U) << _U(_HASH_BITS)) | f.hash for f in (one, two)]
    totals = sum(np.bincount(f.row, w, minlength=len(a)) for f, w in zip((one, two), weight))
    at = np.searchsorted(keys[1], keys[0])
    at = np.minimum(at, max(0, len(keys[1]) - 1))
    both = keys[1][at] == keys[0] if len(keys[1]) else np.zeros(len(keys[0]), bool)
    least = np.minimum(weight[0][both], weight[1][at[both]]) if both.any() else np.empty(0)
    common = np.bincount(one.row[both], least, minlength=len(a))
    return common / np.maximum(totals - common, 1e-300)


def _verified(pairs: DataFrame, texts: DataFrame, df: Frequencies, similarity: float) -> DataFrame:
    """The pairs (key, centre, ...) whose similarity is at least ``similarity``."""
    shared = pairs.sparkSession.sparkContext.broadcast(df)
    kept = [c for c in pairs.columns]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            alike = similarities(part["text"], part["centre_text"], shared.value) >= similarity - _ROUNDING
            yield part.select(kept).filter(pa.array(alike))

    # narrow pairs meet the centres first: a centre may be sought by many, a key appears once
    centres = texts.select(F.col("key").alias("centre"), F.col("text").alias("centre_text"))
    met = pairs.join(centres, "centre").join(texts, "key").select(*kept, "text", "centre_text")
    return map_arrow(met, test, ", ".join(f"{c} binary" for c in kept))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of ``edges`` (a, b). Labels fall to the least neighbour's, then
    to their label's label, until nothing changes; every step is a written table, and the one before it is dropped."""
    spark = edges.sparkSession
    held = Workspace(spark)
    both = held.table(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    last = Workspace(spark)
    labels = last.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        jumped = lower.join(up, "next", "left").select(
            "node", (F.coalesce("further", "next")).alias("new"), F.col("root").alias("old")
        )
        following = Workspace(spark)
        step = following.table(jumped)
        last.drop()
        last = following
        changed = not step.where("new <> old").isEmpty()
        labels = step.select("node", F.col("new").alias("root"))
        if not changed:
            held.drop()
            return labels


def text_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, root: the class of every text that is linked to a different one; a text without a link has no row.

    ``docs`` has doc_id and text and is read several times.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)
    df = frequencies(rows)
    held = Workspace(spark)
    signatures = _signatures(rows, df, held)
    buckets = held.table(_buckets(signatures))
    keys = held.table(buckets.select("key").distinct())
    n_keys = keys.count()
    few = broadcast_up_to(keys, n_keys, BROADCAST_KEYS)
    texts = held.table(rows.select("key", "text").join(few, "key", "left_semi").dropDuplicates(["key"]))
    signed_texts = held.table(signatures.join(few, "key", "left_semi"))
    marks = broadcast_up_to(signed_texts.drop("bands"), n_keys, BROADCAST_KEYS)
    classes = held.table(keys.select("key", F.col("key").alias("root")))
    found = Appended(spark, "a binary, b binary")
    for turn in range(CENTRE_ROUNDS):
        passing = Workspace(spark)
        placed = buckets.join(broadcast_up_to(classes, n_keys, BROADCAST_KEYS), "key").withColumn("order", F.xxhash64(F.lit(turn), "key"))
        one = F.struct("order", "key", "root")
        ends = placed.groupBy("band").agg(F.min(one).alias("low"), F.max(one).alias("high"))
        # at first every text is a class of its own, and a large group would offer itself many times over
        centres = ends.select("band", F.explode(F.array("low", "high") if turn else F.array("low")).alias("c"))
        apart = placed.join(centres, "band").where(F.col("root") != F.col("c.root"))
        offers = apart.select("key", F.col("c.key").alias("centre"), "root", F.col("c.root").alias("to")).distinct()
        near = _agreement(offers, marks)
        # of each text the likeliest centre: others of its classes are left to the next round and the cells
        best = near.groupBy("key").agg(F.max(F.struct("alike", "centre", "root", "to")).alias("c"))
        pairs = passing.table(best.select("key", "c.centre", "c.root", "c.to"))
        links = passing.table(_verified(pairs, texts, df, similarity))
        done = links.isEmpty()
        if not done:
            found.add(links.select(F.col("key").alias("a"), F.col("centre").alias("b")))
            classes = held.table(_hooked(classes, links))
        passing.drop()
        if done:
            break
    # all pairs that are still in two classes
    classes = broadcast_up_to(classes, n_keys, BROADCAST_KEYS)
    narrow = signed_texts.withColumn("size", F.lit(0).cast("long"))
    partnered = held.table(_with_partners(_dealt(buckets, classes, narrow)))
    few = broadcast_up_to(partnered, n_keys, BROADCAST_KEYS)
    whole = signed_texts.join(few, "key", "left_semi").join(texts, "key").withColumn("size", F.octet_length("text").cast("long"))
    rest = buckets.join(few, "key", "left_semi")
    found.add(_links_in_cells(_dealt(rest, classes, held.table(whole)), df, similarity))
    # the labels of the rounds only save tests; the classes are those of all links
    result = components(found.rows()).select(F.col("node").alias("key"), "root")
    held.drop()
    return result


def _hooked(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after one step of merging: each class takes the least label it is linked to, and that one's."""
    low, high = F.least("root", "to"), F.greatest("root", "to")
    hook = links.groupBy(high.alias("high")).agg(F.min(low).alias("low"))
    further = hook.select(F.col("high").alias("low"), F.col("low").alias("lowest"))
    hook = hook.join(further, "low", "left").select(F.col("high").alias("root"), F.coalesce("lowest", "low").alias("top"))
    return classes.join(hook, "root", "left").select("key", F.coalesce("top", "root").alias("root"))


def classed(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key and root (the class, as a text digest) of every row of ``docs``."""
    classes = text_classes(docs, similarity)
    return _keyed(docs).drop("text").join(classes, "key", "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("root")
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row of ``docs`` (doc_id, text).

    Rows with equal texts are in one class, as are texts linked by a chain of verified pairs. A null text is an
    empty one; texts without words are alike only if equal. A class whose ids are all null has a null class_id.
    Repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(classed(docs, similarity))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "root").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id (null ids count last),
    and one of rows that repeat it. All columns stay."""
    rows = materialize(classed(docs, similarity))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    # names that no column of the rows has
    key, id_ = f"_key{uuid.uuid4().hex}", f"_id{uuid.uuid4().hex}"
    kept = first.select(F.col("first.key").alias(key), F.col("first.doc_id").alias(id_))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, F.unhex(F.md5(text.cast("binary"))))
    chosen = keyed.join(kept, key).where(F.col("doc_id").eqNullSafe(F.col(id_)))
    return chosen.dropDuplicates([key]).select(*docs.columns)
