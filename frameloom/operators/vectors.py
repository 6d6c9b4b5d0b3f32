"""Vector operators: cosine, ranking, centroids, whitening, near-duplicates, diverse selection.

Sums over components run in array order, so a score does not depend on where a row is computed.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Asset rows and query rows of a block.
ROWS, QUERIES = 4096, 512
#: Query rows of a block where all of its scores are returned, and rows of a batch of them.
ASKED, BATCH = 4096, 1 << 18
#: Pairs that a task ranks at once.
RANKED = 1 << 24
#: Pivots of a metric index at most, blocks' rows that meet a block in one task, and what bounds leave to rounding.
PIVOTS, PARTS, SLACK = 256, 4, 1e-9
#: Pairs of near rows that are few enough for a fold.
FOLD = 500_000
#: Rows of each group that are settled first, and their near pairs that are written at most.
FIRST, MOST_PAIRS = 1024, 20_000_000
#: Blocks whose state is small enough to be sent to every task.
SMALL_STATE = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; minus infinity for a zero vector, so it ranks last."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(float("-inf")))


def unit_vector(a: Column) -> Column:
    """The vector at unit length; null if empty or zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def parse_vector(text: Column, length: int) -> Column:
    """A vector from its text; null if it can't be read or has another length."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) == length) & F.forall(v, lambda x: x.isNotNull()), v)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _blocks(queries: DataFrame, assets: DataFrame, on: str | None, together: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt out in blocks of about ROWS assets and QUERIES (or so many) queries of one length and key: (assets, queries, their common columns)."""
    keys = [F.size("q").alias("n"), F.col(on).alias("key") if on else F.lit(0).alias("key")]
    asked = queries.where(F.size("q") > 0).select(*keys, *(c for c in queries.columns if c != on))
    rows = assets.where(F.size("v") > 0).select(F.size("v").alias("n"), keys[1], *(c for c in assets.columns if c != on))
    sizes = asked.groupBy("n", "key").agg(F.ceil(F.count("*") / (together or QUERIES)).alias("parts"))
    sizes = sizes.join(rows.groupBy("n", "key").agg(F.ceil(F.count("*") / ROWS).alias("blocks")), ["n", "key"])
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(sizes, ["n", "key"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("part", every("parts"))
    right = asked.join(sizes, ["n", "key"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).withColumn("block", every("blocks"))
    return left.drop("parts", "blocks"), right.drop("parts", "blocks"), ["n", "key", "block", "part"]


def scores(queries: DataFrame, assets: DataFrame, k: int | None = None, least: float | None = None, on: str | None = None, weigh: Callable | None = None, maximum: str | None = None) -> DataFrame:
    """Cosine of every query (query_id, q) with every asset (vec_id, v) of the same length, and of the same ``on``.

    Both sides are dealt out in blocks of at most about ROWS and QUERIES rows, a task a pair of blocks; a task gives the k best of each
    query, or the scores from ``least`` on, or all. With ``maximum`` (query_id or vec_id) it gives only the largest score of each of its
    queries or assets (the other id is null), so what leaves it grows with rows, not with pairs. ``weigh(scores, queries, assets)`` may change
    the scores of a pair of blocks by their other columns; NaN leaves a pair out. A zero vector scores minus infinity. Ties are for the caller.
    """
    left, right, by = _blocks(queries, assets, on)

    def run(key: tuple, block: pa.Table, some: pa.Table) -> pa.Table:
        q_ids, ids, found = some.column("query_id").to_numpy(), block.column("vec_id").to_numpy(), []
        if len(q_ids) and len(ids):
            block = block.take(np.argsort(ids, kind="stable"))
            ids, v, q = block.column("vec_id").to_numpy(), _matrix(block.column("v")), _matrix(some.column("q"))
            size = _norms(q)[:, None] * _norms(v)[None, :]
            score = np.where(size > 0, np.einsum("ik,jk->ij", q, v) / np.where(size > 0, size, 1.0), -np.inf)
            if weigh is not None:
                score = weigh(score, some, block)
            if maximum is not None:
                best = np.fmax.reduce(score, axis=1 if maximum == "query_id" else 0)
                at = np.flatnonzero(~np.isnan(best))
                found = [(q_ids[at], np.zeros(len(at)), best[at]) if maximum == "query_id" else (np.zeros(len(at)), ids[at], best[at])]
            for i, row in enumerate(score if maximum is None else ()):
                at = np.flatnonzero(~np.isnan(row))
                if k is not None and len(at) > k:  # all that tie with the k-th stay
                    at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k] - 1e-12]
                if least is not None:
                    at = at[row[at] >= least]
                found.append((np.full(len(at), q_ids[i]), ids[at], row[at]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        none = lambda name: np.full(len(columns[0]), maximum is not None and maximum != name)
        columns = [pa.array(columns[0].astype(np.int64), mask=none("query_id")), pa.array(columns[1].astype(np.int64), mask=none("vec_id")), pa.array(columns[2], pa.float64())]
        return pa.table([*columns, pa.array([key[1].as_py()] * len(columns[0]), block.schema.field("key").type)], names=["query_id", "vec_id", "score", "key"])

    kind = left.schema["key"].dataType.simpleString()
    out = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id long, vec_id long, score double, key {kind}")
    return out.withColumnRenamed("key", on) if on else out.drop("key")


def _cosines(q: np.ndarray, v: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Cosines of all rows of q and v, whose norms are ``wide``; minus infinity for a zero vector."""
    size = _norms(q)[:, None] * wide[None, :]
    return np.where(size > 0, np.einsum("ik,jk->ij", q, v) / np.where(size > 0, size, 1.0), -np.inf)


def _by_score(score: np.ndarray) -> Iterator[np.ndarray]:
    """The places of a matrix of cosines, flat, by the cosine to six places, in batches; NaN, which leaves a pair out, is left out."""
    keys = np.empty(score.shape, np.int64)
    rows = max(1, BATCH // max(1, score.shape[1]))
    for at in range(0, len(score), rows):
        part = score[at : at + rows]
        # The score to six places, then the pair; NaN goes last.
        places = np.rint(np.where(np.isnan(part), 3.0, np.clip(part, -2.0, 2.0)) * 1e6).astype(np.int64)
        keys[at : at + rows] = (places << 32) | np.arange(at * part.shape[1], at * part.shape[1] + part.size).reshape(part.shape)
    keys = keys.ravel()
    keys.sort()
    for at in range(0, int(np.searchsorted(keys, 3_000_000 << 32)), BATCH):
        yield keys[at : min(at + BATCH, np.searchsorted(keys, 3_000_000 << 32))] & 0xFFFFFFFF


def all_scores(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """Cosine of every query (query_id, q) with every asset (vec_id, v) of the same length: a row a pair, the same scores as ``scores`` has.

    A task has about ASKED queries and ROWS assets, so each vector is sent once for 4096 of the other side. It gives its pairs by their score
    to six places, in batches: files then hold runs of equal scores, which take less space than scores in the order of ids. A task holds
    a score and a sort key for each pair of its block, about 270 MB at any size of the tables.
    """
    left, right, by = _blocks(queries, assets, None, ASKED)
    both = left.select(*by, F.lit(False).alias("asked"), F.col("vec_id").alias("id"), "v").unionByName(right.select(*by, F.lit(True).alias("asked"), F.col("query_id").alias("id"), F.col("q").alias("v")))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        asked, ids = block.column("asked").to_numpy(), block.column("id").combine_chunks().cast(pa.int64())
        flat = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), key[0].as_py()).astype(np.float64)
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        of_query, of_asset = order[asked[order]], order[~asked[order]]
        q_ids, q, ids, v = ids.take(pa.array(of_query)), vectors[of_query], ids.take(pa.array(of_asset)), vectors[of_asset]
        score, wide = np.empty((len(q), len(v))), _norms(v)
        for at in range(0, len(q), QUERIES):
            score[at : at + QUERIES] = _cosines(q[at : at + QUERIES], v, wide)
        for pair in _by_score(score):
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(pair // len(v))), ids.take(pa.array(pair % len(v))), pa.array(score.ravel()[pair])], names=["query_id", "vec_id", "score"])

    # A number keeps small input from being put into one task: its pairs are many.
    number = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(number, *by).groupBy(*by).applyInArrow(run, "query_id long, vec_id long, score double")


def all_ranks(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """All rows of ``all_scores`` with their rank for the query, as ``rank_per_query`` gives it to all of them.

    A task has as many queries as make about RANKED pairs, and every asset of their length, so vectors are sent to it and no pair is: what is
    sent grows with queries times the square of the assets, by RANKED, which is under two bytes a pair up to some 100,000 assets. It holds a
    score, a rank and a sort key for each of its pairs, about 400 MB, beside the assets. Its pairs come by score, as those of ``all_scores``.
    """
    asked = queries.where(F.size("q") > 0).select(F.size("q").alias("n"), F.lit(True).alias("asked"), F.col("query_id").alias("id"), F.col("q").alias("v"))
    rows = assets.where(F.size("v") > 0).select(F.size("v").alias("n"), F.lit(False).alias("asked"), F.col("vec_id").alias("id"), "v")
    sizes = asked.groupBy("n").agg(F.count("*").alias("queries")).join(rows.groupBy("n").agg(F.count("*").alias("assets")), "n")
    parts = F.broadcast(sizes.select("n", F.ceil(F.col("queries") * F.col("assets") / RANKED).alias("parts")))  # a row a length
    # A query's rows meet in one part, also where an id repeats.
    right = asked.join(parts, "n").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    left = rows.join(parts, "n").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = left.drop("parts").unionByName(right.drop("parts"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches)).sort_by("id")  # null ids last
        asked, ids = block.column("asked").to_numpy(), block.column("id").combine_chunks().cast(pa.int64())
        vectors = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), key[0].as_py())
        q_ids, ids = ids.filter(pa.array(asked)), ids.filter(pa.array(~asked))
        q, v = vectors[asked].astype(np.float64), vectors[~asked]
        if not len(q):
            return
        score, rank = np.empty((len(q), len(v))), np.empty((len(q), len(v)), np.int32)
        for at in range(0, len(v), ROWS):
            some = v[at : at + ROWS].astype(np.float64)
            score[:, at : at + ROWS] = _cosines(q, some, _norms(some))
        starts = np.flatnonzero(np.append(True, np.diff(q_ids.fill_null(-1).to_numpy()) != 0))
        for i, end in zip(starts, [*starts[1:], len(q)], strict=True):
            own = score[i:end].T.ravel()  # by id; equal places keep that order
            tied = np.copysign(np.floor(np.abs(np.clip(own, -2.0, 2.0)) * 1e12 + 0.5), own)
            place = np.empty(len(own), np.int32)
            place[np.argsort(-tied, kind="stable")] = np.arange(1, len(own) + 1, dtype=np.int32)
            rank[i:end] = place.reshape(len(v), end - i).T
        del vectors, v, block
        for pair in _by_score(score):
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(pair // len(ids))), ids.take(pa.array(pair % len(ids))), pa.array(score.ravel()[pair]), pa.array(rank.ravel()[pair])], names=["query_id", "vec_id", "score", "rank"])

    number = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(number, "n", "part").groupBy("n", "part").applyInArrow(run, "query_id long, vec_id long, score double, rank int")


def rank_per_query(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Rows with their rank for the query, from 1; scores equal to 12 places tie, and ties go to the smaller id. All of them, or the first k."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def candidates(scored: DataFrame, k: int, most: int) -> DataFrame:
    """Each asset at its first place in query and rank order, the first ``most`` of them."""
    first = Window.partitionBy("vec_id").orderBy("query_id", "rank")
    once = rank_per_query(scored, k).withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    return once.orderBy("query_id", "rank").limit(most)


def centroid(rows: DataFrame, group: str, vector: str = "v") -> DataFrame:
    """The mean of a group's vectors, as rows (group, position, mean)."""
    return rows.select(group, F.posexplode(vector).alias("position", "x")).groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def whiten(rows: DataFrame, group: str, keep_zero: bool = True) -> DataFrame:
    """Rows (group, vec_id, w): vectors less their group's mean, at unit length; zero rows stay zero or go."""
    mean = centroid(rows, group).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias("mean"))
    moved = rows.join(mean, group).select(group, "vec_id", F.zip_with("v", "mean", lambda x, m: x.cast("double") - m).alias("d")).withColumn("n", norm(F.col("d")))
    out = moved.select(group, "vec_id", "n", F.transform("d", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("w"))
    return (out if keep_zero else out.where(F.col("n") > 0)).drop("n")


def pivots_of(rows: DataFrame, most: int, group: str | None = None, reach: float = 0.0) -> np.ndarray:
    """At most so many unit vectors, one for about ROWS rows, to every task: of eight times as many rows, taken by the hash of
    their ids, those that lie farthest from each other, so that clusters have one each. Bounded, whatever the table's size.

    With ``group`` there are fewer, but one for ROWS rows of the largest group, where that many spare nothing: where rows would visit more cells
    within ``reach`` than blocks of ROWS rows without any index have others to meet.
    """
    if group is None:
        n = few = min(most, max(1, rows.count() // ROWS))
    else:
        counted = rows.groupBy(group).count().agg(F.sum("count").alias("all"), F.max("count").alias("largest")).first()
        n, few = (min(most, max(1, (x or 0) // ROWS)) for x in (counted["all"], counted["largest"]))
    some = rows.where(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * n).select("v").collect()
    if not some:
        return np.empty((0, 0))
    length = max(len(r["v"]) for r in some)
    unit = _unit(np.array([r["v"] for r in some if len(r["v"]) == length], np.float64))
    picked = unit[maxmin_order(unit, n)]
    n = len(picked)
    while n > few and _cells_of(unit, picked[:n], reach)[2].sum(axis=1).mean() > 1 + few / 2:
        n = max(few, n // 2)
    return picked[:n]


def _cells_of(unit: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of unit vectors to the pivots, the nearest pivot of each, and the cells that each is in: its home and those later that it visits."""
    far = np.sqrt(np.maximum(2 - 2 * np.einsum("ik,jk->ij", unit, pivots), 0))
    home, every = far.argmin(axis=1), np.arange(len(unit))
    visits = (far <= far[every, home][:, None] + 2 * reach + SLACK) & (np.arange(len(pivots))[None, :] > home[:, None])
    visits[every, home] = True
    return far, home, visits


def metric_cells(rows: DataFrame, group: str, pivots: np.ndarray, reach: float, vectors: bool = True) -> DataFrame:
    """Rows (group, cell, home, far, vec_id, v): each vector in the cell of its nearest pivot, its home, and as a visitor in those later
    cells where a row of that home can lie within ``reach``: not farther from the pivot than its own by more than twice the reach. Distances are
    those of unit vectors; v is as it came, floats in four bytes, or is left out. Without reach (below zero) there are no visitors."""
    pivots = _unit(pivots)
    length = pivots.shape[1]
    kind = rows.schema[group].dataType.simpleString()
    list_kind = "array<float>" if rows.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), length), False)) if length else batch.slice(0, 0)
            v = _flat(batch.column("v"), length)
            at = np.flatnonzero((v != 0).any(axis=1))
            if not len(at):
                continue
            far, home, visits = _cells_of(_unit(v[at]), pivots, reach)
            row, cell = np.nonzero(visits)
            out = batch.take(pa.array(at[row]))
            made = {group: out.column(group), "cell": pa.array(cell), "home": pa.array(cell == home[row]), "far": pa.array(far[row, cell]), "vec_id": out.column("vec_id")}
            yield pa.RecordBatch.from_pydict(made | ({"v": out.column("v")} if vectors else {}))

    asked = rows.select(group, F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(list_kind).alias("v"))
    return asked.mapInArrow(run, f"{group} {kind}, cell long, home boolean, far double, vec_id long" + (f", v {list_kind}" if vectors else ""))


def _flat(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def near_dup_pairs(rows: DataFrame, group: str, least: float, pivots: int = PIVOTS) -> DataFrame:
    """Pairs a < b of a group with a cosine of at least ``least``: exact, each pair computed once, none of two cells too far apart.

    Unit vectors lie within sqrt(2 - 2 least) of each other. A row meets the rows of its own cell, and those of the later cells that
    the triangle inequality leaves: by its distances to the pivots, and by the farthest home row of the cell. Cells are cut into
    blocks of about ROWS rows, and those that meet them into parts of about PARTS times as many, a task a block and a part, so no cell is one
    task. A vector is sent once for each cell and block that it meets, as it came. Zero vectors and those of another length pair with none.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    centres = pivots_of(rows, pivots, group, reach)
    counted = metric_cells(rows, group, centres, reach, vectors=False)
    sizes = counted.groupBy(group, "cell").agg(F.max(F.when(F.col("home"), F.col("far"))).alias("radius"), F.ceil(F.count_if("home") / ROWS).alias("blocks"), F.ceil(F.count("*") / (PARTS * ROWS)).alias("parts"))
    sizes = _cut(sizes.where("blocks > 0"))  # a row a cell
    if sizes.count() <= SMALL_STATE:
        sizes = F.broadcast(sizes)  # else the vectors would be shuffled once more
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    homes = metric_cells(rows, group, centres, -1.0).join(sizes, [group, "cell"]).withColumn("block", own)
    reached = metric_cells(rows, group, centres, reach).join(sizes, [group, "cell"]).where(F.col("home") | (F.col("far") <= F.col("radius") + reach + SLACK))
    # A home row is compared with its block and later ones, a visitor with every block.
    asked = reached.withColumn("own", F.when(F.col("home"), own).otherwise(-1)).withColumn("block", F.explode(F.sequence(F.greatest("own", F.lit(0)), F.col("blocks") - 1)))
    # Both sides' keys must be of one type: an int and a long of the same value are dealt to different tasks.
    left = homes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by = [group, "cell", "block", "part"]
    left = left.select(*by, "vec_id", "v")
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))).select(*(F.col(c).alias(f"other_{c}") for c in (*by, "own", "vec_id", "v")))
    kind, length = rows.schema[group].dataType.simpleString(), centres.shape[1]

    def run(key: tuple, homes: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        x, own = others.column("other_vec_id").to_numpy(), others.column("other_own").to_numpy()
        y = homes.column("vec_id").to_numpy()
        if len(x) and len(y):
            u = _unit(_flat(homes.column("v"), length))
            for at in range(0, len(x), QUERIES):
                score = np.einsum("ik,jk->ij", _unit(_flat(others.column("other_v").slice(at, QUERIES), length)), u)
                same = own[at : at + QUERIES, None] == key[2].as_py()
                i, j = np.nonzero((score >= least) & (~same | (x[at : at + QUERIES, None] < y[None, :])))
                found.append((np.minimum(x[at + i], y[j]), np.maximum(x[at + i], y[j]), score[i, j]))
        a, b, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([pa.array([key[0].as_py()] * len(a), homes.schema.field(group).type), pa.array(a), pa.array(b), pa.array(score)], names=[group, "a", "b", "score"])

    return left.groupBy(*by).cogroup(right.groupBy(*(f"other_{c}" for c in by))).applyInArrow(run, f"{group} {kind}, a long, b long, score double")


def leader_clusters(rows: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """Clusters a group has if a row is new unless it is near an earlier one."""
    followers = pairs.select(group, F.col("b").alias("vec_id")).distinct().withColumn("follows", F.lit(True))
    return rows.join(followers, [group, "vec_id"], "left").groupBy(group).agg(F.count_if(F.col("follows").isNull()).alias("clusters"))


def max_cosine_to(rows: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """Each row's largest cosine to the chosen rows of its group; 0 without any."""
    found = scores(chosen.select(group, F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows.select(group, "vec_id", "v"), on=group, maximum="vec_id")
    best = found.groupBy(group, "vec_id").agg(F.max("score").alias("best"))
    return rows.join(best, [group, "vec_id"], "left").select(group, "vec_id", F.coalesce("best", F.lit(0.0)).alias("max_cosine"))


# ---- greedy picks, round by round ---------------------------------------------------------------------


def _folder(df: DataFrame) -> str:
    """The checkpoint folder that the session names; only where it names none and runs in one process, one below the warehouse."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not context.getCheckpointDir():
        named = conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or f"{conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex[:8]}")
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, as a checkpoint."""
    _folder(df)
    return df.checkpoint()


def _written(df: DataFrame) -> DataFrame:
    """df without its lineage, read back from Parquet in the checkpoint folder. A checkpoint keeps the estimated size of its plan, which joins
    multiply: in rounds of joins its digits grow with a power of the rounds, and planning takes minutes after a dozen."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maxmin_order(unit: np.ndarray, k: int, seed: int = 0) -> list[int]:
    """Rows picked one by one, each the one with the least largest similarity to the picks; ties go to the first row."""
    if not len(unit) or k <= 0:
        return []
    picks, most = [seed], unit @ unit[seed]
    while len(picks) < min(k, len(unit)):
        open_rows = most.copy()
        open_rows[picks] = np.inf
        picks.append(int(np.argmin(open_rows)))
        most = np.maximum(most, unit @ unit[picks[-1]])
    return picks


def _unit(vectors: np.ndarray) -> np.ndarray:
    n = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(n > 0, n, 1.0)


def maxmin_select(rows: DataFrame, group: str, k: int, medoid: bool = False, stop: float | None = None, pivots: int = PIVOTS) -> DataFrame:
    """Per group k diverse rows in order of picking: (group, pick, vec_id), over all groups at once.

    The first pick is the smallest id, or the row nearest to the group's sum of unit vectors. Then the row with the least largest
    cosine to the picks follows, ties to the smaller id, until that cosine reaches ``stop``.

    Unit vectors are written once, in blocks around pivots, and stay as they are. A block's state is one row: its best row, how near to the
    picks that one was, and for how many picks. More picks only bring rows nearer, so an old state bounds its block: a block is read again only
    while its bound beats the best block that is up to date. First the half of a group's blocks with the least bounds are brought up to date,
    then whatever is still below the best.
    """
    zero = F.transform("v", lambda x: F.lit(0.0))
    units = rows.select(group, "vec_id", F.coalesce(unit_vector(F.col("v")), zero).alias("u")).where(F.col("u").isNotNull())
    centres = pivots_of(rows, pivots)

    def cells(batches):
        for batch in batches:
            u = batch.column("u").to_pylist()
            cell = [int(np.argmax(centres @ np.array(x))) if centres.size and len(x) == centres.shape[1] else 0 for x in u]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    kind = rows.schema[group].dataType.simpleString()
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    placed = units.mapInArrow(cells, f"{group} {kind}, vec_id {id_kind}, u array<double>, cell long")
    number = F.floor((F.row_number().over(Window.partitionBy(group, "cell").orderBy(F.xxhash64("vec_id"))) - 1) / ROWS)
    blocks = _cut(placed.withColumn("block", number).repartition(group, "cell", "block").sortWithinPartitions(group, "cell", "block"))
    by = [group, "cell", "block"]
    if medoid:
        whole = centroid(blocks, group, "u").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias("mean"))
        first = blocks.join(whole, group).withColumn("most", -dot(F.col("u"), F.col("mean")))
    else:
        first = blocks.withColumn("most", F.lit(0.0))
    picked = _cut(first.groupBy(group).agg(F.min_by(F.struct("vec_id", "u"), F.struct("most", "vec_id")).alias("p")).select(group, F.lit(1).cast("long").alias("pick"), "p.vec_id", F.col("p.u").alias("u")))
    state = blocks.select(*by).distinct().select(*by, F.lit(float("-inf")).alias("bound"), F.lit(None).cast(id_kind).alias("best"), F.lit(0).alias("picks"))
    state, gone = _cut(state), None

    def fresh(stale: DataFrame, turn: int) -> DataFrame:
        """The state of these blocks for all picks so far."""
        near = picked.where(F.col("pick") < turn).groupBy(group).agg(F.collect_list("u").alias("near"), F.collect_list("vec_id").alias("taken"))  # k picks at most
        most = F.array_max(F.transform("near", lambda p: dot(F.col("u"), p)))
        open_rows = blocks.join(F.broadcast(stale.select(*by)) if few else stale.select(*by), by).join(near, group).where(~F.array_contains("taken", F.col("vec_id"))).select(*by, "vec_id", most.alias("most"))
        made = open_rows.groupBy(*by).agg(F.min(F.struct("most", "vec_id")).alias("m"))
        # A block without open rows is done for good.
        return stale.select(*by).join(made, by, "left").select(*by, F.coalesce("m.most", F.lit(float("inf"))).alias("bound"), F.col("m.vec_id").alias("best"), F.lit(turn).alias("picks"))

    few = state.count() <= SMALL_STATE
    most_blocks = state.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    for turn in range(2, k + 1):
        sure = state
        if most_blocks > 4:  # with so few all are read in the second step
            place = F.percent_rank().over(Window.partitionBy(group).orderBy("bound"))
            again = state.withColumn("place", place).where((F.col("place") <= 0.5) & (F.col("bound") < float("inf"))).drop("place")
            sure = _cut(fresh(again, turn).unionByName(state.join(again.select(*by), by, "left_anti")))
        best = sure.where(F.col("picks") == turn).groupBy(group).agg(F.min("bound").alias("least"))
        again = sure.join(best, group, "left").where((F.col("picks") < turn) & (F.col("bound") <= F.coalesce("least", F.lit(float("inf")))) & (F.col("bound") < float("inf"))).drop("least")
        state = _cut(fresh(again, turn).unionByName(sure.join(again.select(*by), by, "left_anti")))
        # A tie goes to the smaller id, also between blocks: those that could tie are up to date.
        won = state.where((F.col("picks") == turn) & (F.col("bound") < float("inf"))).groupBy(group).agg(F.min(F.struct("bound", "best")).alias("w"))
        if stop is not None:
            won = won.where(F.col("w.bound") < stop)
        if gone is not None:
            won = won.join(gone, group, "left_semi")
        chosen = won.select(group, F.col("w.best").alias("vec_id")).join(blocks.select(group, "vec_id", "u"), [group, "vec_id"])
        new = _cut(chosen.select(group, F.lit(turn).cast("long").alias("pick"), "vec_id", "u"))
        if new.isEmpty():
            break
        gone = new.select(group).distinct()  # groups that have stopped drop out
        picked = picked.unionByName(new)
    return picked.select(group, "pick", "vec_id")


def diverse_selection(rows: DataFrame, group: str, window: int, k: int) -> DataFrame:
    """Per group k rows: max-min over the ``window`` most relevant that have a vector, filled up by relevance.

    The pool is ranked in Spark; a fold gets no more than the window and k rows to fill up with.
    """
    has = F.coalesce(F.size("v") > 0, F.lit(False))
    order = [F.desc("relevance"), "vec_id"]
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("among", F.row_number().over(Window.partitionBy(group, has).orderBy(*order)))
    rows = ranked.where((F.col("place") <= window + k) | (has & (F.col("among") <= window)))

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["relevance", "vec_id"], ascending=[False, True])
        usable = pool[pool["v"].map(lambda v: v is not None and len(v) > 0)].head(window)
        chosen: list[int] = []
        if len(usable) > k:
            v = np.array(usable["v"].tolist(), np.float64)
            chosen = usable["vec_id"].to_numpy()[maxmin_order(_unit(v - v.mean(axis=0)), k)].tolist()
        else:
            chosen = usable["vec_id"].tolist()
        chosen += [x for x in pool["vec_id"].tolist() if x not in set(chosen)][: max(0, k - len(chosen))]
        return pd.DataFrame({group: pool[group].iloc[0], "pick": np.arange(1, len(chosen) + 1), "vec_id": chosen})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "vec_id", "v", "relevance").groupBy(group).applyInPandas(fold, f"{group} {kind}, pick long, vec_id long")


def near_any(rows: DataFrame, chosen: DataFrame, group: str, least: float) -> DataFrame:
    """(group, vec_id) of the rows that have a cosine of at least ``least`` to one of the chosen rows of their group, once for 4096 of these at most."""
    left, right, by = _blocks(chosen.select(group, F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows.select(group, "vec_id", "v"), group, ASKED)
    kind = rows.schema[group].dataType.simpleString()

    def run(key: tuple, block: pa.Table, some: pa.Table) -> pa.Table:
        near = np.zeros(len(block), bool)
        if len(block) and len(some):
            q = _unit(_flat(some.column("q"), key[0].as_py()))
            for at in range(0, len(block), QUERIES):
                near[at : at + QUERIES] = (np.einsum("ik,jk->ij", _unit(_flat(block.column("v").slice(at, QUERIES), key[0].as_py())), q) >= least).any(axis=1)
        found = block.filter(pa.array(near))
        return pa.table([found.column("key"), found.column("vec_id").cast(pa.int64())], names=[group, "vec_id"])

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"{group} {kind}, vec_id long")


def kept_redundancy(rows: DataFrame, group: str, least: float) -> DataFrame:
    """Per group how many rows are near an earlier kept row, and how many are kept.

    The first rows of each group are settled by their near pairs; what they keep puts out its later neighbours, of which no pair is made, and
    so on with what is left. The first rows are FIRST at most, more where rows have few pairs, and fewer where they have over MOST_PAIRS, so what
    is written is bounded by these and by what is left undecided, and is not all pairs. Zero vectors and those of another length are kept.
    """
    length = rows.agg(F.max(F.size("v"))).first()[0] or 0
    usable = F.coalesce((F.size("v") == length) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(True))) & F.col(group).isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    sizes = rows.groupBy(group).agg(F.count_if(usable).alias("n"), F.count_if(~usable).alias("apart"))
    todo, most, done = rows.where(usable).select(group, F.col("vec_id").cast("long").alias("vec_id"), "v"), FIRST, []
    while True:
        # The id up to which a half, a quarter and so on of a group's rows lie.
        marks = F.percentile_approx("vec_id", [2.0**-i for i in range(31)], 10_000)
        counted = _written(todo.groupBy(group).agg(F.count("*").alias("rows"), marks.alias("marks")))
        again = True
        while again:
            n = F.least("rows", F.lit(most)).cast("double")
            some = counted.agg(F.max("rows").alias("largest"), F.sum(n * (n - 1) / 2).alias("pairs")).first()
            last = (some["largest"] or 0) <= most
            halved = F.least(F.greatest(F.ceil(F.log2(F.col("rows") / most)), F.lit(0)), F.lit(30)).cast("int")
            until = counted.select(group, F.get("marks", halved).alias("until"))
            first = _written(todo if last else todo.join(until, group).where("vec_id <= until").drop("until"))
            pairs = near_dup_pairs(first, group, least)
            again = (some["pairs"] or 0) > MOST_PAIRS and most > 1 and pairs.count() > MOST_PAIRS
            most = max(1, most // 4) if again else most
        pairs = _written(pairs)
        made = pairs.count()
        settled = _settled(first, pairs, group)
        kept = _written(first.join(settled.where("kept").select(group, "vec_id").distinct(), [group, "vec_id"], "left_semi"))
        done.append(kept.groupBy(group).agg(F.count("*").alias("kept")))
        if last:
            break
        rest = todo.join(until, group).where("vec_id > until").drop("until")
        todo = _written(rest.join(near_any(rest, kept, group, least).distinct(), [group, "vec_id"], "left_anti"))
        most *= 4 if made * 16 <= MOST_PAIRS else 2 if made * 4 <= MOST_PAIRS else 1
    all_kept = functools.reduce(DataFrame.unionByName, done).groupBy(group).agg(F.sum("kept").alias("kept"))
    kept = F.coalesce("kept", F.lit(0))
    return sizes.join(all_kept, group, "left").select(group, (F.col("n") - kept).alias("redundant"), (F.col("apart") + kept).alias("kept"))


def _settled(rows: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """Rows (group, vec_id, kept) of rows with all their near pairs.

    Rows without an undecided or kept earlier neighbour are kept, their later neighbours go, and so on in rounds over the near pairs.
    A long chain of rows would take a round a row: when at most FOLD pairs are left undecided, a fold per group ends it.
    """
    state = rows.select(group, "vec_id", F.lit(None).cast("boolean").alias("kept"))
    while True:
        if pairs.count() <= FOLD:
            break
        # Pairs of a row that is gone, and of a decided later row, decide nothing more.
        of = lambda a: state.select(group, F.col("vec_id").alias(a), F.col("kept").alias(f"kept_{a}"))
        pairs = _written(pairs.select(group, "a", "b").join(of("a"), [group, "a"]).join(of("b"), [group, "b"]).where("kept_b is null and coalesce(kept_a, true)"))
        if pairs.count() <= FOLD:
            break
        seen = pairs.groupBy(group, F.col("b").alias("vec_id")).agg(F.bool_or(F.coalesce("kept_a", F.lit(False))).alias("near_kept"), F.bool_or(F.col("kept_a").isNull()).alias("open"))
        verdict = F.when(F.col("near_kept"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = _written(state.join(seen, [group, "vec_id"], "left").select(group, "vec_id", F.coalesce("kept", verdict).alias("kept")))

    def fold(left: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b in left.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):  # all of a's own pairs come before
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({group: left[group].iloc[0], "vec_id": sorted(gone)})

    kind = rows.schema[group].dataType.simpleString()
    gone = pairs.groupBy(group).applyInPandas(fold, f"{group} {kind}, vec_id long").withColumn("gone", F.lit(True))
    return state.join(gone, [group, "vec_id"], "left").select(group, "vec_id", F.coalesce("kept", F.col("gone").isNull()).alias("kept"))
