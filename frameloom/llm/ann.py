"""Approximate nearest neighbours by few stable projections, a kd-tree and a chi-square test.

Vectors of unit length are projected onto DIMENSIONS Gaussian (2-stable) directions. Over the true
squared distance of two vectors, their squared projected distance follows a chi-square law with
DIMENSIONS degrees of freedom. A query takes the projected neighbours in ever farther leaves of
a kd-tree and verifies those by the true cosine that the test lets through. It stops when the next projected
distance is so large that a vector nearer than the k-th best so far would have come before with
probability CONFIDENCE, that is when it exceeds the k-th distance times the root of that quantile.

The kd-tree has two upper levels, each cut out of a bounded sample of projections: at most SAMPLE rows
give at most MAX_CELLS cells, and a cell with more than 2 x CELL rows is cut again by about
SUB_SAMPLE of its own, so cells grow in number with the rows, not in size. A query first searches its own cell, which
bounds its k-th distance, then all the other cells that the test does not rule out by their
boxes, so it sees at least what one tree over everything would have shown it. Cells are dealt
out in blocks of at most about BLOCK rows and the queries of a cell in parts, so a crowded cell,
or a vector that a third of the rows repeat, is many small tasks. Within a block a vector's repeats
are kept for the k + 1 smallest ids, k rows each, which no answer can go beyond.

How much is pruned depends on the vectors: in clusters few cells come near, but independent Gaussian vectors
of many dimensions are all about equally far, and no index spares most of them. Each query's number
of verified vectors comes with its answer.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
of different lengths never meet, and every length is searched. Ties go to the smaller id; rows that
repeat an id are each candidates, but not for a query of that id, and a query that is repeated is
answered once. An empty table has no answers. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import keep, open_fs, put_bytes, shared_dir, small_batches, table

DIMENSIONS, CONFIDENCE, SEED = 16, 0.95, 11
#: Rows of the sample that shapes the cells, and of each cell's own; rows of a cell, cells at most, rows of a block, queries of a part.
SAMPLE, SUB_SAMPLE, CELL, MAX_CELLS, BLOCK, PART = 20_000, 4096, 4096, 4096, 4096, 2048
LEAF = 256


def chi_square_quantile(p: float, degrees: int) -> float:
    """The quantile for an even number of degrees, by bisection."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


@lru_cache(maxsize=8)
def directions(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, dimensions))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def project(vectors: np.ndarray) -> np.ndarray:
    """Projections of the vectors, brought to unit length; row by row, so equal vectors have equal ones."""
    return np.einsum("ij,jk->ik", unit(vectors), directions(vectors.shape[1]))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows get equal values."""
    vectors, query = vectors / np.abs(vectors).max(axis=1, keepdims=True), query / np.abs(query).max()
    dots = np.einsum("ij,j->i", vectors, query)
    return dots / (np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * math.sqrt(float(np.einsum("j,j->", query, query))))


class Tree:
    """A kd-tree over vectors by their projections; rows are put in the order of the leaves, so a leaf is a slice."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes, self.order = project(vectors), [], []  # nodes: low, high, left, right, from, to
        self.root = self._build(np.arange(len(ids)), leaf, 0) if len(ids) else -1
        order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.points, self.vectors, self.ids = self.points[order], vectors[order], ids[order]
        self.units = unit(self.vectors)

    def _build(self, rows: np.ndarray, leaf: int, start: int) -> int:
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        if len(rows) <= leaf or not (high > low).any():
            self.order.append(rows)
            self.nodes.append((low, high, -1, -1, start, start + len(rows)))
        else:
            axis, half = int(np.argmax(high - low)), len(rows) // 2
            order = rows[np.argpartition(own[:, axis], half)]
            left, right = self._build(order[:half], leaf, start), self._build(order[half:], leaf, start + half)
            self.nodes.append((low, high, left, right, start, start + len(rows)))
        return len(self.nodes) - 1

    def distance(self, node: int, point: np.ndarray) -> float:
        low, high, *_ = self.nodes[node]
        gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
        return float(gap @ gap)

    def nearer(self, point: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Leaves (least squared distance, from, to), nearest first."""
        heap = [(self.distance(self.root, point), self.root)] if self.root >= 0 else []
        while heap:
            d, node = heapq.heappop(heap)
            _, _, left, right, start, end = self.nodes[node]
            if left < 0:
                yield d, start, end
            else:
                for child in (left, right):
                    heapq.heappush(heap, (self.distance(child, point), child))


#: How far a product of unit vectors may be from the cosine that is reported.
ROUNDING = 1e-9


def search(tree: Tree, query: np.ndarray, query_id: int, k: int, worst: float, factor: float) -> tuple[list[tuple[float, int]], int]:
    """(minus cosine, id) of the k nearest that the test lets through, and how many were verified; worst: a known bound of the k-th squared distance."""
    best: list[tuple[float, int]] = []
    verified = 0
    own = query[None, :]
    point, direction = project(own)[0], unit(own)[0]
    for d, start, end in tree.nearer(point):
        if d > factor * worst + 1e-12:
            break
        gap = tree.points[start:end] - point
        rows = np.flatnonzero((np.einsum("ij,ij->i", gap, gap) <= factor * worst + 1e-12) & (tree.ids[start:end] != query_id))
        verified += len(rows)
        if len(rows) > k:
            # Products of unit vectors choose the rows that can matter; their cosines are then taken exactly.
            close = tree.units[start + rows] @ direction
            rows = rows[close >= max(np.partition(close, len(rows) - k)[len(rows) - k], -best[-1][0] if len(best) == k else -2.0) - ROUNDING]
        if not len(rows):
            continue
        scores = cosines(tree.vectors[start + rows], query)
        best = sorted([*best, *zip((-scores).tolist(), tree.ids[start + rows].tolist(), strict=True)])[:k]
        if len(best) == k:
            worst = min(worst, max(0.0, 2 + 2 * best[-1][0]) + 1e-12)
    return best, verified


class Cells:
    """The top of the kd-tree: split planes, and each cell's box in projected space."""

    def __init__(self, points: np.ndarray, cells: int, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, at, left, right; below 0: cell -1 - x
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        edge = np.full(DIMENSIONS, np.inf)
        self.root = self._split(points, max(1, cells), -edge if low is None else low, edge if high is None else high)
        self.low_box, self.high_box = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(1)
        if cells <= 1 or spread.max() <= 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        axis = int(np.argmax(spread))
        at = float(np.median(points[:, axis]))
        if at <= points[:, axis].min():
            at = float(np.nextafter(at, np.inf))  # many rows are equal there; they stay left
        below = points[:, axis] < at
        edge_left, edge_right = high.copy(), low.copy()
        edge_left[axis] = edge_right[axis] = at
        left = self._split(points[below], cells // 2, low, edge_left)
        right = self._split(points[~below], cells - cells // 2, edge_right, high)
        self.splits.append((axis, at, left, right))
        return len(self.splits) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, at, left, right = self.splits[node]
            below = points[rows, axis] < at
            stack += [(left, rows[below]), (right, rows[~below])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        gap = np.maximum(self.low_box - point, 0) + np.maximum(point - self.high_box, 0)
        return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) if len(column) else np.empty((0, length))


FOUND = "query_id long, id long, score double, verified long"


def _few_repeats(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that are enough to answer any query: of equal vectors the k + 1 smallest ids, k rows each."""
    _, same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    group = np.r_[True, np.diff(same[order]) != 0]
    new = group | np.r_[True, np.diff(ids[order]) != 0]
    number, place = np.cumsum(new), np.arange(len(order))
    turn = number - np.maximum.accumulate(np.where(group, number, 0))
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.sort(order[(turn <= k) & (again < k)])


def _search_blocks(k: int, factor: float):
    def run(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and queries.num_rows:
            length = key[0].as_py()
            block = block.sort_by("id")
            ids = block.column("id").to_numpy()
            vectors = np.ascontiguousarray(_matrix(block.column("v").combine_chunks(), length))
            few = _few_repeats(vectors, ids, k)
            tree = Tree(vectors[few], ids[few])
            asked = _matrix(queries.column("v").combine_chunks(), length)
            for q, query, worst in zip(queries.column("query_id").to_pylist(), asked, queries.column("worst").to_pylist(), strict=True):
                best, verified = search(tree, query, q, k, worst, factor)
                found += [(q, i, -s, 0) for s, i in best] + [(q, None, None, verified)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "id", "score", "verified"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.where(F.col("id").isNotNull()).drop("verified").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _projected(n: pa.Array, v: pa.Array) -> pa.Array:
    sizes, out = n.to_numpy(zero_copy_only=False), np.empty((len(n), DIMENSIONS))
    for length in np.unique(sizes):
        own = np.flatnonzero(sizes == length)
        out[own] = project(_matrix(v.take(pa.array(own)), int(length)))
    return pa.array(list(out), pa.list_(pa.float64()))


class Index:
    """The upper levels of the kd-tree: cells by length from the driver, the cells of a crowded cell from the shared folder."""

    def __init__(self, uri: str, top: dict[int, Cells]):
        self.uri, self.top = uri, top

    def below(self, n: int, cell: int) -> Cells:
        return _stored(f"{self.uri}/cells/{n}-{cell}")

    def homes(self, n: int, cell: int | None, points: np.ndarray) -> np.ndarray:
        """The cell of each point, or its cell within one."""
        tree = self.top.get(n) if cell is None else self.below(n, cell)
        return tree.of(points) if tree else np.zeros(len(points), np.int64)


@lru_cache(maxsize=64)
def _stored(uri: str) -> Cells:
    filesystem, path = open_fs(uri)
    with filesystem.open_input_file(path) as source:
        return pickle.loads(source.read())


def _place(index, level: int):
    """A column with the cell (level 1) of rows, or their cell within it (level 2)."""

    def run(n: pa.Array, p: pa.Array, cell: pa.Array, crowded: pa.Array) -> pa.Array:
        points, out = _matrix(p, DIMENSIONS), np.zeros(len(n), np.int64)
        keys = np.stack([n.to_numpy(zero_copy_only=False).astype(np.int64), cell.to_numpy(zero_copy_only=False), crowded.to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
        for length, c, many in np.unique(keys, axis=0) if len(keys) else ():
            if level == 1 or many:
                own = np.flatnonzero((keys == (length, c, many)).all(axis=1))
                out[own] = index.value.homes(int(length), None if level == 1 else int(c), points[own])
        return pa.array(out)

    return F.arrow_udf(run, "long").asNondeterministic()


def _near(index, level: int, factor: float):
    """A column with the cells (or cells within a cell) that the test does not rule out for a query."""

    def run(n: pa.Array, p: pa.Array, worst: pa.Array, cell: pa.Array, crowded: pa.Array) -> pa.Array:
        out = []
        for length, point, bound, c, many in zip(n.to_pylist(), _matrix(p, DIMENSIONS), worst.to_pylist(), cell.to_pylist(), crowded.to_pylist(), strict=True):
            tree = index.value.top.get(length) if level == 1 else index.value.below(length, c) if many else None
            out.append(np.flatnonzero(tree.distances(point) <= factor * bound + 1e-12).tolist() if tree else [0])
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>").asNondeterministic()


def _split_cell(uri: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        n, cell, rows = (k.as_py() for k in key)
        points = _matrix(group.column("p").combine_chunks(), DIMENSIONS)
        put_bytes(f"{uri}/cells/{n}-{cell}", pickle.dumps(Cells(points, min(-(-rows // CELL), max(1, len(points) // 4)))))
        return pa.table([pa.array([n], pa.int32()), pa.array([cell], pa.int64())], names=["n", "cell"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, uri: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """The k nearest rows of vectors for each row of queries: query_id, rank, id, score, and the query's verified rows. Files go to the shared folder uri.

    Of an id that several vectors have, the least one by its components is asked.
    """
    spark, factor = vectors.sparkSession, chi_square_quantile(confidence, DIMENSIONS)
    project_all = F.arrow_udf(_projected, "array<double>").asNondeterministic()

    def valid(df: DataFrame, name: str) -> DataFrame:
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.where(F.col(name).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite).where(F.exists(v, lambda x: x != 0))
        return rows.withColumn("n", F.size("v"))

    once = valid(queries, "query_id").groupBy("query_id").agg(F.min("v").alias("v")).withColumn("n", F.size("v"))
    asked = keep(once.withColumn("p", project_all("n", "v")), f"{uri}/asked")
    rows = valid(vectors, "id").join(asked.select("n").distinct(), "n", "left_semi")
    rows = keep(rows.withColumn("p", project_all("n", "v")), f"{uri}/rows")
    # A row for each length that a query has; a bounded sample of projections.
    totals = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("n", "p").toArrow()
    points, sizes = _matrix(sample.column("p").combine_chunks(), DIMENSIONS), sample.column("n").to_numpy()
    few = {n: min(MAX_CELLS, total // CELL, int((sizes == n).sum()) // 4) for n, total in totals.items()}
    index = spark.sparkContext.broadcast(Index(uri, {n: Cells(points[sizes == n], cells) for n, cells in few.items() if cells > 1}))
    none, no = F.lit(0).cast("long"), F.lit(False)

    cells = keep(rows.withColumn("cell", _place(index, 1)("n", "p", none, no)), f"{uri}/cells_of")
    counts = keep(cells.groupBy("n", "cell").agg(F.count("*").alias("rows")), f"{uri}/counts")
    crowd = counts.where(F.col("rows") > 2 * CELL)
    chosen = cells.join(crowd, ["n", "cell"]).where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) * F.col("rows") < F.lit(float(SUB_SAMPLE)) * (1 << 30))
    split = keep(chosen.groupBy("n", "cell", "rows").applyInArrow(_split_cell(uri), "n int, cell long").withColumn("crowded", F.lit(True)), f"{uri}/split")
    with_split = lambda df: df.join(split, ["n", "cell"], "left").withColumn("crowded", F.coalesce("crowded", no))
    placed = keep(with_split(cells).withColumn("sub", _place(index, 2)("n", "p", "cell", "crowded")).drop("p", "crowded"), f"{uri}/placed")
    keys = ["n", "cell", "sub"]
    sizes_of = keep(placed.groupBy(*keys).agg(F.count("*").alias("rows")), f"{uri}/sizes")

    def visit(visits: DataFrame, name: str) -> DataFrame:
        visits = keep(visits.select("query_id", "v", "worst", *keys), f"{uri}/visits-{name}")
        asks = visits.groupBy(*keys).agg(F.count("*").alias("asks"))
        plan = keep(sizes_of.join(asks, keys).select(*keys, F.ceil(F.col("rows") / BLOCK).alias("blocks"), F.ceil(F.col("asks") / PART).alias("parts")), f"{uri}/plan-{name}")
        every = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
        left = placed.join(plan, keys).select(*keys, F.pmod(F.xxhash64("id"), "blocks").alias("block"), every("parts").alias("part"), "id", "v")
        right = visits.join(plan, keys).select(*keys, every("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), "parts").alias("part"), "query_id", "v", "worst")
        on = [*keys, "block", "part"]
        return keep(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_search_blocks(k, factor), FOUND), f"{uri}/found-{name}")

    asked = with_split(asked.withColumn("cell", _place(index, 1)("n", "p", none, no)))
    asked = keep(asked.withColumn("sub", _place(index, 2)("n", "p", "cell", "crowded")).drop("crowded"), f"{uri}/homes")
    home = visit(asked.withColumn("worst", F.lit(float("inf"))), "home")
    # The k-th squared distance of unit vectors, or no bound where fewer are found.
    best = _best(home, k)
    bound = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.greatest(2 - 2 * F.min("score"), F.lit(0.0)) + 1e-12).alias("bound"))
    bounded = asked.withColumnsRenamed({"cell": "own", "sub": "own_sub"}).join(bound, "query_id", "left").withColumn("worst", F.coalesce("bound", F.lit(float("inf"))))
    others = with_split(bounded.withColumn("cell", F.explode(_near(index, 1, factor)("n", "p", "worst", none, no))))
    others = others.withColumn("sub", F.explode(_near(index, 2, factor)("n", "p", "worst", "cell", "crowded"))).where((F.col("cell") != F.col("own")) | (F.col("sub") != F.col("own_sub")))
    found = home.unionByName(visit(others, "others"))
    verified = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return _best(found, k).join(verified, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score", "verified")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), shared_dir(spark, "nearest"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score", "verified")
