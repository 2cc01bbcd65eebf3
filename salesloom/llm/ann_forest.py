"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits its points by a hyperplane between two random ones. Every
vector is routed to one leaf of each tree. A query walks all trees through one priority queue, which
holds the branches not taken by their distance to the query, and notes leaves until those hold a share of all
vectors. Leaf and query meet in cells of bounded size, where exact distances are worked out and the nearest kept.

Vectors of different dimensions are no neighbours: each dimension has a forest of its own.

Equal vectors are one point of the index that names its lowest ids, so a vector that fills a third of the table costs no
more than another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.arrow import map_arrow
from salesloom.operators.materialize import materialize

TREES = 8
SAMPLE = 16_384  # points that trees are fitted on
LEAF_ROWS = 1024
LEAST_LEAF_SAMPLE = 8
VISITED = 1.3  # rows of visited leaves, over all trees, as a share of all rows
LEAST_VISITED = 4096  # rows that a query visits at least
CELL_ROWS = CELL_QUERIES = 2048


@dataclass
class Forest:
    """Nodes of all trees: a leaf has a negative ``left``; its share is that of the sample that fell into it."""

    roots: list[int]
    normal: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """(points, trees) leaf node of each point."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(points), root)
            going = np.flatnonzero(self.left[at] >= 0)
            while len(going):
                node = at[going]
                side = np.einsum("ij,ij->i", points[going], self.normal[node]) - self.border[node]
                at[going] = np.where(side <= 0, self.left[node], self.right[node])
                going = going[self.left[at[going]] >= 0]
            out[:, tree] = at
        return out

    def visited(self, query: np.ndarray, share: float) -> list[int]:
        """Leaves in the order of the shared queue, until they hold ``share`` of the rows."""
        side = self.normal @ query - self.border
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0.0
        left, right = self.left, self.right
        while queue and held < share:
            apart, node = heapq.heappop(queue)
            while left[node] >= 0:
                near, far = (left[node], right[node]) if side[node] <= 0 else (right[node], left[node])
                heapq.heappush(queue, (max(apart, abs(side[node])), int(far)))
                node = near
            found.append(int(node))
            held += self.share[node]
        return found


def fit(sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = 7) -> Forest:
    """Trees over ``sample`` (points x dimensions) with at most ``leaf`` points in a leaf, unless they cannot be told apart."""
    random = np.random.default_rng(seed)
    normal, border, left, right, share, roots = [], [], [], [], [], []

    def node(points: int) -> int:
        normal.append(np.zeros(sample.shape[1]))
        border.append(0.0)
        left.append(-1)
        right.append(-1)
        share.append(points / max(1, len(sample)))
        return len(left) - 1

    for _ in range(trees):
        root = node(len(sample))
        roots.append(root)
        open_nodes = [(root, np.arange(len(sample)))]
        while open_nodes:
            at, points = open_nodes.pop()
            if len(points) <= leaf:
                continue
            a, b = sample[random.choice(points, 2, replace=False)]
            way = a - b
            size = np.linalg.norm(way)
            if size == 0:
                continue
            way = way / size
            along = sample[points] @ way
            middle = float(np.median(along))
            low = along <= middle
            if low.all():
                low = along < middle
            if low.all() or not low.any():
                continue
            normal[at], border[at] = way, middle
            left[at], right[at] = node(int(low.sum())), node(int((~low).sum()))
            open_nodes += [(left[at], points[low]), (right[at], points[~low])]
    columns = (np.array(left, np.int64), np.array(right, np.int64), np.array(share))
    return Forest(roots, np.array(normal), np.array(border), *columns)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part: a vector without nulls or non-finite components, not zero."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).where(
        "vec_id IS NOT NULL AND vec IS NOT NULL"
    )
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return materialize(rows.where(F.exists("vec", lambda x: x != 0)))


@dataclass
class _Index:
    """What tasks need to know of one dimension."""

    forest: Forest
    visited: float
    row_cells: int


def _index(points: DataFrame, n: int, visited: float) -> _Index:
    """The forest for ``n`` points of one dimension."""
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vec")
    drawn = np.array([r["vec"] for r in sample.collect()], np.float64)  # bounded by SAMPLE
    forest = fit(drawn, max(LEAST_LEAF_SAMPLE, LEAF_ROWS * len(drawn) // n))
    held = LEAF_ROWS * max(1, n * LEAST_LEAF_SAMPLE // (LEAF_ROWS * len(drawn)))
    return _Index(forest, max(visited, LEAST_VISITED / n), held // CELL_ROWS + 1)


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        sizes = pc.list_value_length(batch["vec"])
        for dim in pc.unique(sizes).to_pylist():
            yield dim, batch.filter(pc.equal(sizes, dim))


def _points(rows: DataFrame, k: int) -> DataFrame:
    """point (lowest id), vec, ids (the ``k`` + 1 lowest): the different vectors. A query needs no more of equal ones."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    lowest = rows.withColumn("nth", rank).where(F.col("nth") <= k + 1)
    return lowest.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("point"), "vec", "ids"
    )


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, visited: float = VISITED) -> DataFrame:
    """The ``k`` nearest rows, other than itself, of every row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding (array of numbers); other columns are ignored. Returns query_id, rank (from 1), vec_id, score
    (Euclidean distance in double precision); ties go to the smaller vec_id. Rows that `usable` leaves out are neither
    found nor searched for; vectors of other dimensions than a query's are not near it. Rows that repeat an id and vector are found as often as they occur, up to ``k`` + 1. With
    fewer other rows of its dimension than ``k`` all are found; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    points = materialize(_points(rows, k).withColumn("dim", F.size("vec")))
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one forest per dimension, each bounded by SAMPLE
    shared = spark.sparkContext.broadcast({dim: _index(points.where(F.col("dim") == dim), n, visited) for dim, n in sizes.items()})

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    sought = materialize(queries.groupBy("vec").agg(F.min("vec_id").alias("query")))
    query_cells = sought.count() // CELL_QUERIES + 1

    def leaved(batch: pa.RecordBatch, dim: int, leaves: list[list[int]]) -> pa.RecordBatch:
        cells = pa.array([shared.value[dim].row_cells] * batch.num_rows, pa.int32())
        made = [pa.array([dim] * batch.num_rows, pa.int32()), cells, pa.array(leaves, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "dim", "row_cells", "leaves"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dimension(batches):
            yield leaved(batch, dim, shared.value[dim].forest.leaves(_matrix(batch["vec"])).tolist())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dimension(batches):
            own = shared.value[dim]
            yield leaved(batch, dim, [own.forest.visited(q, own.visited) for q in _matrix(batch["vec"])])

    added = "vec array<double>, dim int, row_cells int, leaves array<bigint>"
    grid = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = map_arrow(points.select("point", "vec"), route, f"point long, {added}")
    index = index.select("*", F.explode("leaves").alias("leaf")).select(
        "dim", "leaf", F.pmod(F.xxhash64("point"), F.col("row_cells")).cast("int").alias("row_cell"), grid(F.lit(query_cells)).alias("query_cell"), "point", "vec"
    )
    tour = map_arrow(sought.select("query", "vec"), walk, f"query long, {added}")
    tour = tour.select("*", F.explode("leaves").alias("leaf")).select(
        "dim", "leaf", grid(F.col("row_cells")).alias("row_cell"), F.pmod(F.xxhash64("query"), F.lit(query_cells)).cast("int").alias("query_cell"), "query", "vec"
    )

    def meet(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = _nearest_in_cell(points, queries, k + 1)
        return pa.table(found, schema=pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())]))

    cell = ["dim", "leaf", "row_cell", "query_cell"]
    met = index.groupBy(*cell).cogroup(tour.groupBy(*cell)).applyInArrow(meet, "query long, point long, score double")
    best = Window.partitionBy("query").orderBy("score", "point")
    near = met.distinct().withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    ids = near.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy("score", "vec_id")
    answers = ids.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    listed = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    known = sought.join(listed, "query").select("vec", "near")
    each = queries.select(F.col("vec_id").alias("query_id"), "vec").join(known, "vec")
    # the row itself is one of the nearest; of rows that repeat its id one goes
    own = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
    others = F.when(own > 0, F.concat(F.slice("near", 1, own - 1), F.slice("near", own + 1, k + 1))).otherwise(F.col("near"))
    return each.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )


def _nearest_in_cell(points: pa.Table, queries: pa.Table, k: int) -> dict[str, np.ndarray]:
    """The ``k`` nearest points of a cell for each of its queries. A product of matrices finds them with room for its
    rounding; their distances are then worked out from differences."""
    if not points.num_rows or not queries.num_rows:
        return {"query": np.empty(0, np.int64), "point": np.empty(0, np.int64), "score": np.empty(0)}
    p, q = (_matrix(t["vec"].combine_chunks()) for t in (points, queries))
    point, query = (t[c].to_numpy() for t, c in ((points, "point"), (queries, "query")))
    rough = (q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (q @ p.T)
    if len(p) > k:
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1, keepdims=True))
        near = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack
    else:
        near = np.ones(rough.shape, bool)
    a, b = np.nonzero(near)
    score = np.sqrt(((q[a] - p[b]) ** 2).sum(axis=1))
    return {"query": query[a], "point": point[b], "score": score}
