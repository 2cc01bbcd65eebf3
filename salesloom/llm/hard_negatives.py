"""Hard negatives by threshold joins with an inverted index, in the manner of L2AP.

Rows are packed into blocks. A round sends a bounded number of anchors, each with a threshold, to every block, which
finds the rows whose inner product with an anchor reaches it:

1. Dimensions are taken in groups. A row's first groups are left out of the index as long as the norm of what is
   left out, times the largest norm of an anchor in them, stays below the least threshold: such a part alone cannot
   reach it.
2. Scores are added up from the last group to the first over the rows each group's list holds. A pair goes once its sum and the product of
   the norms of both remainders stay below the anchor's threshold; few pairs are listed, many stay a matrix.
3. What is left is finished with the dimensions that were left out of the index. All scores are exact integers.

Only an anchor whose window is not yet full comes again, with a lower threshold; the last one lets every row in, or ends at the
window's own border. Positives are found first, negatives between 80 % and 100 % of each positive's score after them.

Anchors are a fixed share of the rows, so the work is rows times anchors before pruning. No vector is shuffled: anchors come
to the blocks, and each task gives at most a window for each anchor and positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.arrow import map_arrow
from salesloom.llm.tables import bulky
from salesloom.operators.materialize import materialize

WINDOW = 5
BLOCK_VALUES = 1 << 19  # components of the rows of a block: 4 MB
ANCHOR_VALUES = 1 << 20  # components of the anchors that are sent to all blocks at once: 8 MB
PAIR_VALUES = 1 << 18  # scores that are worked on at once
GROUPS = 8  # that the dimensions are taken in
LEVELS = (0.8, 0.55, 0.4, 0.25)  # thresholds of the rounds as shares of the greatest possible score; then none
_EXACT, _EXACT_SINGLE = 2.0**53, 2.0**24  # below which sums of whole numbers are exact
_ROOM = 1 + 1e-5  # for the rounding of norms
_SPARSE = 16  # pairs are listed once this many times fewer are left
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label (long) and vec (array<double>) of the rows that take part: no null id, label or vector, no null or
    non-finite component. Where vec_id is divisible by ``shift_every`` the label is the next one of ``labels``. Rows that repeat all three count once."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vec.alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    shifted = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.withColumn("label", shifted).dropDuplicates(["vec_id", "label", "vec"])


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python integers where doubles could not hold a product's sum."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if scaled.size == 0 or np.abs(scaled).max() < 2.0**20:
        return scaled
    exact = [math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def blocks(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """ids, labels, vectors (rows laid end to end, each padded with zeros to ``width``): blocks of a bounded size; written."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64()))])
    most = max(1, BLOCK_VALUES // max(1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            ids, labels, vectors = zip(*held)
            flat = np.concatenate([_padded(v, width) for v in vectors])
            columns = [pa.array([x], f.type) for x, f in zip((ids, labels, flat), schema)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("vec_id", "label", "vec"))):
                held.append(row)
                if len(held) == most:
                    yield packed()
        if held:
            yield packed()

    return bulky(map_arrow(rows.select("vec_id", "label", "vec"), pack, "ids array<bigint>, labels array<bigint>, vectors array<double>"))


def _padded(vector: list[float], width: int) -> np.ndarray:
    out = np.zeros(width)
    out[: len(vector)] = vector
    return out


class Index:
    """Inverted lists of a block's rows for thresholds that are not below ``least``. ``reach`` holds the largest norm of an
    anchor in the first k groups of dimensions, for every k. Rows are ordered by how many groups are left out, so
    that a group's list is a slice."""

    def __init__(self, vectors: np.ndarray, least: float, reach: np.ndarray, edges: np.ndarray):
        norms = _prefix_norms(vectors, edges)
        covered = norms * reach * _ROOM < least
        left_out = np.cumprod(covered, axis=1).sum(axis=1)  # the run of covered groups from the first
        self.rows = np.argsort(left_out, kind="stable")
        self.vectors, self.norms, self.left_out = vectors[self.rows], norms[self.rows], left_out[self.rows]
        self.edges, self.groups = edges, len(edges) - 1
        self.listed = [int((left_out <= g).sum()) for g in range(self.groups)]

    def pairs(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that reach their anchor's threshold."""
        norms, part = _prefix_norms(anchors, self.edges), lambda g: slice(self.edges[g], self.edges[g + 1])
        sums = np.zeros((len(anchors), len(self.vectors)), anchors.dtype)
        group = self.groups
        # whole matrices, until few pairs are left
        while group:
            group -= 1
            n = self.listed[group]
            sums[:, :n] += anchors[:, part(group)] @ self.vectors[:n, part(group)].T
            if group % 2 and group < self.groups - 1:
                continue
            kept = sums + self._ahead(norms, group) >= thresholds[:, None]
            if np.count_nonzero(kept) * _SPARSE <= kept.size:
                break
        else:
            kept = sums + self._ahead(norms, 0) >= thresholds[:, None]
        a, b = np.nonzero(kept)
        score = sums[a, b]
        while group:
            group -= 1
            on = np.flatnonzero(b < self.listed[group])
            score[on] += _products(anchors, a[on], self.vectors, b[on], part(group))
            ahead = np.maximum(self.left_out[b], group) - 1
            rest = np.where(ahead >= 0, norms[a, ahead] * self.norms[b, ahead], 0) * _ROOM
            kept = score + rest >= thresholds[a]
            a, b, score = a[kept], b[kept], score[kept]
        # what the index left out
        for g in range(self.groups):
            on = np.flatnonzero(self.left_out[b] > g)
            if not len(on):
                break
            score[on] += _products(anchors, a[on], self.vectors, b[on], part(g))
        kept = score >= thresholds[a]
        return a[kept], self.rows[b[kept]], score[kept]

    def _ahead(self, norms: np.ndarray, group: int) -> np.ndarray:
        """Bound of what pairs may still gain: the groups before this one, and those the index left out."""
        out = np.zeros((len(norms), len(self.vectors)), norms.dtype)
        ahead = np.maximum(self.left_out, group) - 1  # ascending, like the rows
        for last in np.unique(ahead[ahead >= 0]).tolist():
            rows = slice(*np.searchsorted(ahead, [last, last + 1]).tolist())
            np.multiply(norms[:, last, None] * norms.dtype.type(_ROOM), self.norms[None, rows, last], out=out[:, rows])
        return out


def _prefix_norms(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Norms over the first k + 1 groups of dimensions."""
    squares = np.add.reduceat(vectors.astype(np.float64) ** 2, edges[:-1], axis=1)
    return np.sqrt(np.cumsum(squares, axis=1)).astype(vectors.dtype)


def _products(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, part: slice) -> np.ndarray:
    return np.einsum("ij,ij->i", one[a, part], two[b, part])


def first_of_each(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores of each anchor, ties to the smaller id."""
    order = np.lexsort((ids, -score, a))
    starts = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else np.empty(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[nth < k]


def _exact_pairs(anchors: np.ndarray, vectors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same with Python integers, for numbers too large for doubles; scores are held to the range of a long."""
    found = []
    for i, anchor in enumerate(anchors.tolist()):
        for j, vector in enumerate(vectors.tolist()):
            score = max(-_LONG, min(_LONG, sum(int(x) * int(y) for x, y in zip(anchor, vector))))
            if score >= thresholds[i]:
                found.append((i, j, score))
    a, b, score = zip(*found) if found else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(score, np.int64)


def _in_block(known: dict, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, same: bool):
    """(anchor, row, score) of the pairs of a block from each anchor's ``low`` on: with rows of its own label (``same``) or of others."""
    own_labels = np.unique(known["labels"]).tolist() if same else [None]
    for label in own_labels:
        mine = np.flatnonzero(known["labels"] == label) if same else np.arange(len(points))
        theirs = np.flatnonzero(labels == label) if same else np.arange(len(ids))
        if not len(mine) or not len(theirs):
            continue
        one, two, low = points[mine], rows[theirs], known["low"][mine]
        width, greatest = one.shape[1], 0.0
        if one.dtype == object or two.dtype == object:
            greatest = np.inf
        elif width:
            greatest = float(np.abs(one).max() * np.abs(two).max() * width)
        index = None
        if greatest < _EXACT and width:
            kind = np.float32 if greatest < _EXACT_SINGLE else np.float64
            one, two, low = one.astype(kind), two.astype(kind), low.astype(np.float64)
            edges = np.unique(np.linspace(0, width, GROUPS + 1).astype(np.int64))
            index = Index(two, float(low.min()), _prefix_norms(one, edges).max(axis=0), edges)
        step = max(1, PAIR_VALUES // len(two))
        for start in range(0, len(one), step):
            part = slice(start, start + step)
            a, b, score = index.pairs(one[part], low[part]) if index else _exact_pairs(one[part], two, low[part])
            a, b = mine[a + start], theirs[b]
            right = known["ids"][a] != ids[b] if same else known["labels"][a] != labels[b]
            yield a[right], b[right], score[right].astype(np.int64)


def _search(packed: DataFrame, anchors: dict[str, np.ndarray], scale: int, same_label: bool) -> DataFrame:
    """anchor, place, vec_id, score: of each block, for each wanted window (anchor, place) its best rows. Wanted are scores from
    ``low`` to ``high`` of rows with the anchor's label (``same_label``) or with another one."""
    shared = packed.sparkSession.sparkContext.broadcast(anchors)  # at most ANCHOR_VALUES components
    schema = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        points = whole_numbers(known["vectors"], scale)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, flat = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels", "vectors"))
                rows = whole_numbers(flat.reshape(len(ids), -1), scale)
                for a, b, score in _in_block(known, points, ids, labels, rows, same_label):
                    for place in range(known["high"].shape[1]):
                        under = np.flatnonzero(score <= known["high"][a, place])
                        best = under[first_of_each(a[under], ids[b[under]], score[under], WINDOW)]
                        if len(best):
                            columns = (known["numbers"][a[best]], np.full(len(best), place), ids[b[best]], score[best])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                            )

    return map_arrow(packed, find, "anchor long, place int, vec_id long, score long")


def _first(found: DataFrame, *keys: str) -> DataFrame:
    """The first rows of each window, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WINDOW)


def mine(vectors: DataFrame, every: int = 100, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of every anchor (a row whose vec_id is
    divisible by ``every``) and each of its five best other rows of the same label: the five best rows of other labels that score
    between 80 % and 100 % of that positive.

    ``vectors`` has vec_id, embedding and label; other columns are ignored. A component x counts as floor(scale * x), a
    score is the integer inner product (held to the range of a long), a shorter vector counts as padded with zeros.
    Ties go to the smaller vec_id. `usable` says which rows take part; rows that share an id but not the vector or label
    are rows of their own, except that none is the positive of an anchor of its id. An anchor without positives, or a positive without negatives, has no row. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, shift_every, labels))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    width = facts["width"] or 0
    packed = blocks(rows, width, scale)
    at_once = max(1, ANCHOR_VALUES // max(1, width))
    chosen = rows.where(F.col("vec_id") % every == 0)
    groups = -(-chosen.count() // at_once) or 1
    number = F.row_number().over(Window.partitionBy("part").orderBy("vec_id", "label", "vec"))
    dealt = chosen.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(groups)))
    dealt = materialize(dealt.withColumn("anchor", number * F.lit(groups) + F.col("part")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)) * scale
    greatest = rows.agg(F.max(norm).alias("greatest")).first()["greatest"] or 0.0
    results = []
    for part in range(groups):
        # a part holds about ANCHOR_VALUES components: anchors are dealt by their hash
        anchors = dealt.where(F.col("part") == part).collect()
        if anchors:
            results.append(_mined(spark, packed, anchors, width, greatest, scale))
    if not results:
        return spark.createDataFrame([], _RESULT)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(spark, packed: DataFrame, anchors: list, width: int, greatest: float, scale: int) -> DataFrame:
    vectors = np.stack([_padded(r["vec"], width) for r in anchors]) if width else np.zeros((len(anchors), 0))
    known = {
        "numbers": np.array([r["anchor"] for r in anchors]),
        "ids": np.array([r["vec_id"] for r in anchors]),
        "labels": np.array([r["label"] for r in anchors]),
        "vectors": vectors,
    }
    with np.errstate(over="ignore"):
        most = np.sqrt((vectors**2).sum(axis=1)) * scale * greatest

    def wanted(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[which] for k, v in known.items()} | {"low": low, "high": high}

    # positives: thresholds fall until an anchor has all it can get
    open_anchors = np.arange(len(anchors))
    positives: dict[int, list[tuple[int, int]]] = {}
    for level in (*LEVELS, None):
        if not len(open_anchors):
            break
        with np.errstate(invalid="ignore"):
            low = np.full(len(open_anchors), -np.inf) if level is None else most[open_anchors] * level
        low = np.where(np.isfinite(low), low, -np.inf)
        search = wanted(open_anchors, low, np.full((len(open_anchors), 1), np.inf))
        found = _first(_search(packed, search, scale, True), "anchor")
        listed = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
        got = {r["anchor"]: [(b["vec_id"], b["score"]) for b in r["best"]] for r in listed.collect()}  # WINDOW for each
        full = np.array([len(got.get(int(n), ())) >= WINDOW or level is None for n in known["numbers"][open_anchors]])
        positives |= {int(i): got.get(int(known["numbers"][i]), []) for i in open_anchors[full]}
        open_anchors = open_anchors[~full]

    # negatives: from the border down to 80 % of each positive
    held = [i for i, found in positives.items() if found and found[0][1] >= 0]
    missing = -1  # a place without a positive
    high = np.full((len(anchors), WINDOW), missing, object)
    for i in held:
        for place, (_, score) in enumerate(positives[i]):
            high[i, place] = score
    lowest = np.array([min((-(-80 * int(s) // 100) for s in high[i] if s >= 0), default=0) for i in range(len(anchors))], object)
    results, open_anchors = [], np.array(held, np.int64)
    for share in (0.95, 0.8):
        if not len(open_anchors):
            break
        tops = np.array([min(int(s) for s in high[i] if s >= 0) for i in open_anchors], object)
        low = np.array([max(int(l), -(-int(t) * int(share * 100) // 100)) for l, t in zip(lowest[open_anchors], tops)], object)
        exact = all(abs(int(x)) < _EXACT for x in (*low, *high[open_anchors].ravel()))
        kind = np.float64 if exact else object
        search = wanted(open_anchors, low.astype(kind), high[open_anchors].astype(kind))
        found = materialize(_first(_search(packed, search, scale, False), "anchor", "place"))
        if share > 0.8:
            counts = found.groupBy("anchor", "place").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            filled = {(r["anchor"], r["place"]) for r in counts.collect() if r["n"] >= WINDOW}  # WINDOW for each anchor
            numbers = known["numbers"][open_anchors].tolist()
            full = np.array(
                [
                    int(l) <= int(lowest[i]) or all((n, p) in filled for p in range(WINDOW) if high[i, p] >= 0)
                    for n, i, l in zip(numbers, open_anchors, low)
                ]
            )
        else:
            full = np.ones(len(open_anchors), bool)
        done = spark.createDataFrame(
            [(int(known["numbers"][i]), int(known["ids"][i]), p, *map(int, positives[int(i)][p])) for i in open_anchors[full] for p in range(len(positives[int(i)]))],
            "anchor long, anchor_id long, place int, positive_id long, positive_score long",
        )
        results.append(found.join(F.broadcast(done), ["anchor", "place"]))  # WINDOW rows for each anchor of the part
        open_anchors = open_anchors[~full]
    if not results:
        return spark.createDataFrame([], _RESULT)
    whole = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    # in whole numbers: 80 * positive <= 100 * negative, without running over
    inside = F.col("score").cast("decimal(20,0)") * 100 >= F.col("positive_score").cast("decimal(20,0)") * 80
    return whole.where(inside).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
