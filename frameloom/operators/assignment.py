"""Clips for the beats of videos: greedy and global packs over whole pools, windows of unused footage, bridges, audits.

Pools are searched in Spark, whatever their size; folds see lists of bounded size, and their helpers are
plain functions that tests call without Spark. What has no solution gets a status, never an error that ends the job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import py_zfill
from frameloom.operators.sequences import free_windows, least_overlap, phase_trim
from frameloom.operators.vectors import QUERIES, ROWS, _cut, cosine, scores

#: What a span may be longer than its clip, and the penalties of an assignment, and the gap of a displaced pick.
TOLERANCE = 0.05
STALE, NEIGHBOUR, TWIN, DISPLACED = 0.10, 0.05, 0.50, 0.15
IMPOSSIBLE = 1e6
#: Clips of a beat that a fold gets at first.
FIRST = 64
#: Documents of a bucket that bridges are folded for at a time.
DOCS = 500
#: What a greedy pack keeps of a picked clip.
PICKED = ["vec_id", "asset_id", "duration_sec", "category", "phase", "u"]


# ---- assignment -----------------------------------------------------------------------------------


def solve(cost: np.ndarray) -> list[int]:
    """The column of each row in a cheapest assignment (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def covering(score: np.ndarray, beats: pa.Table, clips: pa.Table) -> np.ndarray:
    """Scores of a pair of blocks without the pairs whose clip is shorter than the beat."""
    spans, durations = beats.column("span").to_numpy(), clips.column("duration_sec").to_numpy()
    return np.where(durations[None, :] + TOLERANCE >= spans[:, None], score, np.nan)


def fresh_covering(score: np.ndarray, beats: pa.Table, clips: pa.Table) -> np.ndarray:
    """Finite scores of covering pairs, less STALE where the clip has no free window as long as the beat: minus the cost of an assignment."""
    spans, longest = beats.column("span").to_numpy(), clips.column("longest").to_numpy()
    weighed = covering(score, beats, clips) - STALE * (longest[None, :] < spans[:, None])
    return np.where(np.isfinite(weighed), weighed, np.nan)


def with_windows(clips: DataFrame, ledger_windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clips with ``longest``, their longest free window; and the free windows (vec_id, start, end) themselves. Clips may share an asset."""
    sources = clips.select("vec_id", "asset_id", F.col("duration_sec").alias("source")).distinct()
    shown = ledger_windows.join(sources, "asset_id").select("vec_id", "start", "end")
    free = free_windows(shown, sources.drop("asset_id"), 0.0, "vec_id")
    longest = free.groupBy("vec_id").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    return clips.join(longest, "vec_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0.0))), free


def resolve(picks: DataFrame, free: DataFrame, ledger_windows: DataFrame) -> DataFrame:
    """picks (video, beat, vec_id, asset_id, duration_sec, span, phase) with trim_start and exhausted: in the first free window that is long enough,
    placed by the motion phase; where there is none, where it overlaps least with what was shown, the earliest such place."""
    fits = picks.join(free, "vec_id").where(F.col("end") - F.col("start") >= F.col("span"))
    first = fits.groupBy("video", "beat").agg(F.min(F.struct("start", "end")).alias("w"))
    placed = picks.join(first, ["video", "beat"], "left")
    trim = phase_trim(F.lower(F.coalesce("phase", F.lit(""))), F.col("w.start"), F.col("w.end"), F.col("span"))
    rest = placed.where(F.col("w").isNull() & F.col("asset_id").isNotNull()).select("video", "beat", "asset_id", F.col("duration_sec").alias("source"), "span")
    least = least_overlap(rest, ledger_windows, ["video", "beat"]).select("video", "beat", F.col("trim").alias("least"))
    out = placed.join(least, ["video", "beat"], "left")
    return out.select(*picks.columns, F.round(F.coalesce(trim, "least"), 3).alias("trim_start"), (F.col("w").isNull() & F.col("asset_id").isNotNull()).alias("exhausted"))


# ---- greedy: first fit by a ladder of rules ---------------------------------------------------------


def _usable(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length n without nulls as a matrix, other rows zero; and which rows those are."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = pc.fill_null(pc.equal(pc.list_value_length(lists), n), False).to_numpy(zero_copy_only=False).copy()
    flat = lists.filter(pa.array(ok)).flatten()
    rows, whole = np.zeros((len(lists), n)), flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(axis=1) if n else np.ones(int(ok.sum()), bool)
    at = np.flatnonzero(ok)
    rows[at[whole]] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)[whole] if n else 0.0
    ok[at[~whole]] = False
    return rows, ok


def _cosines(q: list[float] | None, block: pa.Table, known: dict) -> np.ndarray:
    """Cosine of a beat with each clip of a block, minus infinity where there is none, as by ``cosine``."""
    out = np.full(len(block), -np.inf)
    if q is None or any(x is None for x in q):
        return out
    if len(q) not in known:
        v, ok = _usable(block.column("v"), len(q))
        known[len(q)] = v, ok, np.sqrt(np.einsum("ij,ij->i", v, v))
    v, ok, size = known[len(q)]
    a = np.array(q, np.float64)
    size = size * np.sqrt(a @ a)
    at = np.flatnonzero(ok & ((size > 0) | np.isnan(size)))
    out[at] = (v @ a)[at] / size[at]
    return out


def _first_by_ladder(asked: DataFrame, pool: DataFrame, threshold: float | None) -> DataFrame:
    """For each block of a place's pool the first clip of each video by (rung, score, id): its columns, score, rank (the rounded score) and rung."""
    blocks = lambda df, size: df.groupBy("place").agg(F.ceil(F.count("*") / size).alias("n"))
    sizes = blocks(pool, ROWS).withColumnRenamed("n", "blocks").join(blocks(asked, QUERIES).withColumnRenamed("n", "parts"), "place")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = pool.join(F.broadcast(sizes), "place").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("part", every("parts"))
    right = asked.join(F.broadcast(sizes), "place").withColumn("part", F.pmod(F.xxhash64("video"), "parts")).withColumn("block", every("blocks"))
    by = ["place", "block", "part"]

    def run(key: tuple, clips: pa.Table, some: pa.Table) -> pa.Table:
        video, at, score, rank, rung = [], [], [], [], []
        number = lambda c: np.array(clips.column(c).to_numpy(), np.float64)
        if len(clips) and len(some):
            ids, duration, longest = clips.column("vec_id").to_numpy(), number("duration_sec"), number("longest")
            category = clips.column("category").combine_chunks().dictionary_encode()
            kinds, category = {x: i for i, x in enumerate(category.dictionary.to_pylist())}, category.indices.to_numpy()
            known, looks = {}, {}
            for row in some.to_pylist():
                if row["span"] is None:
                    continue
                fits = np.flatnonzero((duration + TOLERANCE >= row["span"]) & ~np.isin(ids, row["chosen"]))
                if not len(fits):
                    continue
                alike = category == kinds.get(row["before"], -1) if row["before"] != "" else np.zeros(len(ids), bool)
                near = np.zeros(len(ids), bool)
                for n in {len(x) for x in row["units"]} if threshold is not None else ():
                    if n not in looks:
                        looks[n] = _usable(clips.column("u"), n)
                    unit, ok = looks[n]
                    near |= ok & ((unit @ np.array([x for x in row["units"] if len(x) == n], np.float64).T) >= threshold).any(axis=1)
                steps = np.where(longest < row["span"], 4, 2 * near + alike)[fits]
                fits = fits[steps == steps.min()]
                found = _cosines(row["q"], clips, known)
                rounded = np.round(found, 12) + 0.0
                top = np.fmax.reduce(rounded[fits])
                fits = fits if np.isnan(top) else fits[rounded[fits] == top]
                one = fits[np.argmin(ids[fits])]
                for column, value in ((video, row["video"]), (at, one), (score, found[one]), (rank, rounded[one]), (rung, steps.min())):
                    column.append(value)
        taken = clips.select(PICKED).take(pa.array(at, pa.int64()))
        return pa.table([pa.array(video, pa.int64()), *taken.columns, pa.array(score, pa.float64()), pa.array(rank, pa.float64()), pa.array(rung, pa.int32())], names=["video", *PICKED, "score", "rank", "rung"])

    kinds = ", ".join(f"{c} {pool.schema[c].dataType.simpleString()}" for c in PICKED)
    left = left.select(*by, *PICKED, "v", "longest")
    right = right.select(*by, F.col("video").cast("long").alias("video"), F.col("q").cast("array<double>").alias("q"), "span", "chosen", "units", "before")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"video long, {kinds}, score double, rank double, rung int")


def greedy_pack(beats: DataFrame, clips: DataFrame, ledger_windows: DataFrame, threshold: float | None = None) -> DataFrame:
    """A clip for each beat, beat after beat, over whole pools: (video, beat, vec_id, span, score, trim_start, exhausted, ..., status).

    beats: video, place, beat (0, 1, ..), q, span. clips: place, vec_id, asset_id, v, u (a unit vector of looks, or null), duration_sec,
    category, phase. A clip is used once a video and must cover the span. Among those, the ladder takes the best-ranked clip that has a
    free window, is no near-duplicate of an earlier pick (if there is a threshold) and of another category than the pick before; if there is
    none, of the same category; then near-duplicates of another category, then any with a free window; last the best-ranked at all, which is
    marked exhausted. That is one minimum by (rung, score, id), scores to 12 places: each beat is one aggregate over the pools, and no pool is
    cut. A pool is read once a beat, in blocks that meet blocks of videos as matrices; only the picks are written. A beat that no clip covers is uncovered, and the video goes on.
    """
    pool, free = with_windows(clips, ledger_windows)
    pool = _cut(pool.withColumn("category", F.coalesce("category", F.lit(""))).withColumn("u", F.col("u").cast("array<double>")))
    videos = beats.select("video").distinct()
    empty = {"chosen": "array<bigint>", "units": "array<array<double>>"}
    state = _cut(videos.select("video", *(F.expr(f"cast(array() as {kind})").alias(c) for c, kind in empty.items()), F.lit("").alias("before")))
    last = beats.agg(F.max("beat")).first()[0]
    picks = []
    for beat in range(-1 if last is None else int(last) + 1):
        asked = state.join(beats.where(F.col("beat") == beat), "video").select("video", "place", "q", "span", *empty, "before")
        best = _first_by_ladder(asked, pool, threshold).groupBy("video").agg(F.min_by(F.struct(*PICKED, "score", "rung"), F.struct("rung", -F.col("rank"), "vec_id")).alias("p"))
        made = asked.select("video", "span").join(best, "video", "left").select("video", F.lit(beat).cast("long").alias("beat"), "span", "p.*")
        picks.append(_cut(made))
        mine = picks[-1].where(F.col("vec_id").isNotNull()).select("video", "vec_id", "u", "category")
        grown = state.join(mine, "video", "left")
        unit = F.when(F.col("u").isNotNull(), F.array("u")).otherwise(F.expr("cast(array() as array<array<double>>)"))
        state = _cut(grown.select(
            "video",
            F.when(F.col("vec_id").isNotNull(), F.concat("chosen", F.array("vec_id"))).otherwise(F.col("chosen")).alias("chosen"),
            F.concat("units", unit).alias("units"),
            F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(F.col("before")).alias("before"),
        ))
    if not picks:
        return pool.sparkSession.createDataFrame([], "video long, beat long, vec_id long, span double, score double, trim_start double, exhausted boolean, same_category boolean, near_duplicate boolean, status string")
    every = picks[0]
    for more in picks[1:]:
        every = every.unionByName(more)
    out = resolve(every.drop("u"), free, ledger_windows)
    return out.select(
        "video", "beat", "vec_id", "span", F.when(F.col("score") > float("-inf"), F.round("score", 4)).alias("score"), "trim_start", "exhausted",
        F.coalesce(F.col("rung").isin(1, 3), F.lit(False)).alias("same_category"), F.coalesce(F.col("rung").isin(2, 3), F.lit(False)).alias("near_duplicate"),
        F.when(F.col("vec_id").isNull(), "uncovered").otherwise("ok").alias("status"),
    )


# ---- all beats of a video at once -------------------------------------------------------------------


class Unseen(Exception):
    """A cheapest assignment might need a clip that was not among those given."""


def assign(costs: list[dict[int, float]], whole: list[bool], categories: dict[int, str], near: Callable[[int, int], bool] | None, rounds: int = 6) -> list[int | None]:
    """A clip for each beat, cheapest in sum: costs has for each beat its cheapest clips, all of them where ``whole`` says so.

    Clips like a neighbour's pick in category, or like any other pick in looks, cost more; with the picks of one round the next is solved,
    until they stay. Of n beats a cheapest assignment needs for each beat only its n cheapest clips, as the others hold n - 1 at most. With
    penalties on top, those are known as long as the n-th costs no more than the dearest clip given, which bounds all that were not given;
    if one is not, Unseen is raised and more clips are to be given. None: no clip covers the beat, or all that do are taken.
    """
    n = len(costs)
    picks: list[int | None] = [None] * n
    for turn in range(rounds + 1):
        now = []
        for i, own in enumerate(costs):
            around = {categories[picks[k]] for k in (i - 1, i + 1) if turn and 0 <= k < n and picks[k] is not None} - {""}
            others = [p for k, p in enumerate(picks) if k != i and p is not None] if near is not None and turn else []
            priced = {c: x + NEIGHBOUR * (categories[c] in around) + TWIN * any(near(c, p) for p in others) for c, x in own.items()}
            cheapest = sorted(priced.items(), key=lambda x: (x[1], x[0]))[:n]
            if not whole[i] and (len(cheapest) < n or cheapest[-1][1] > max(own.values())):
                raise Unseen
            now.append(dict(cheapest))
        clips = sorted({c for own in now for c in own})
        cost = np.full((n, len(clips) + n), IMPOSSIBLE)
        for i, own in enumerate(now):
            for c, x in own.items():
                cost[i, np.searchsorted(clips, c)] = x
        after = [clips[j] if j < len(clips) and cost[i, j] < IMPOSSIBLE else None for i, j in enumerate(solve(cost))] if n else []
        if after == picks:
            break
        picks = after
    return picks


def global_pack(beats: DataFrame, clips: DataFrame, ledger_windows: DataFrame, threshold: float | None = None, first: int = FIRST) -> DataFrame:
    """The clips of all beats of a video at once, cheapest in sum, over whole pools: (video, beat, vec_id, span, score, trim_start, exhausted, displaced, best, status).

    Inputs as for greedy_pack. The cost of a clip is minus its score, and STALE more without a free window for the span. A fold gets the
    ``first`` cheapest clips of each beat (and all that tie), found in blocks of the pool; where that is not enough to be sure of the result
    (see assign), the video is folded again with four times as many, and so on. Displaced picks score DISPLACED or more below the best
    covering clip. Clips that can't be scored are never assigned.
    """
    pool, free = with_windows(clips, ledger_windows)
    pool = _cut(pool.withColumn("category", F.coalesce("category", F.lit(""))))
    # A beat's id in the searches: videos have less than 2^20 beats.
    asked = _cut(beats.select("place", (F.col("video") * (1 << 20) + F.col("beat")).alias("query_id"), "q", "span", "video", "beat"))
    assets = pool.select("place", "vec_id", "v", "duration_sec", "longest")
    best = scores(asked.select("place", "query_id", "q", "span"), assets, weigh=covering, maximum="query_id", on="place").where(F.col("score") > float("-inf")).groupBy("query_id").agg(F.max("score").alias("best"))
    sizes = asked.groupBy("video").agg(F.count("*").alias("n_beats"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own, names = rows.sort_values(["beat", "place_in"]), rows.drop_duplicates("vec_id").set_index("vec_id")
        order = sorted(rows["beat"].unique().tolist())
        lists = {beat: part for beat, part in own.groupby("beat")}
        costs = [dict(zip(lists[b]["vec_id"].dropna().astype(int).tolist(), (-lists[b]["weighed"].dropna()).tolist(), strict=True)) for b in order]
        categories = names["category"].fillna("").to_dict()
        units = {int(i): np.array(u) for i, u in names["u"].items() if not pd.isna(i) and u is not None}
        near = (lambda a, b: a in units and b in units and float(units[a] @ units[b]) >= threshold) if threshold is not None else None
        given = int(rows["given"].iloc[0])
        try:
            picks, status = assign(costs, [len(c) < given for c in costs], categories, near), "ok"
        except Unseen:
            picks, status = [None] * len(order), "more"
        return pd.DataFrame({"video": rows["video"].iloc[0], "beat": order, "vec_id": pd.array(picks, "Int64"), "status": ["uncovered" if status == "ok" and p is None else status for p in picks]})

    done, todo, given = [], sizes, first
    while not todo.isEmpty():
        open_beats = asked.join(todo.select("video"), "video", "left_semi")
        found = scores(open_beats.select("place", "query_id", "q", "span"), assets, k=given, weigh=fresh_covering, on="place")
        place_in = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id"))
        few = found.withColumn("place_in", place_in).where(F.col("place_in") <= given).select("query_id", "vec_id", F.col("score").alias("weighed"), "place_in")
        told = open_beats.select("query_id", "video", "beat", "place").join(few, "query_id", "left").join(pool.select("place", "vec_id", "category", "u"), ["place", "vec_id"], "left")
        told = told.withColumn("given", F.lit(given)).select("video", "beat", "vec_id", "weighed", "place_in", "category", "u", "given")
        folded = _cut(told.groupBy("video").applyInPandas(fold, "video long, beat long, vec_id long, status string"))
        done.append(folded.where("status <> 'more'"))
        todo, given = folded.where("status = 'more'").select("video").distinct(), 4 * given
    every = done[0] if done else pool.sparkSession.createDataFrame([], "video long, beat long, vec_id long, status string")
    for more in done[1:]:
        every = every.unionByName(more)
    named = asked.join(every, ["video", "beat"]).join(pool.select("place", "vec_id", "asset_id", "v", "duration_sec", "phase"), ["place", "vec_id"], "left").join(best, "query_id", "left")
    scored = named.withColumn("score", F.when(F.col("vec_id").isNotNull(), cosine(F.col("q"), F.col("v")))).drop("q", "v", "place", "query_id")
    out = resolve(scored, free, ledger_windows)
    return out.select("video", "beat", "vec_id", "span", F.round("score", 4).alias("score"), "trim_start", "exhausted", F.coalesce(F.col("best") - F.col("score") >= DISPLACED, F.lit(False)).alias("displaced"), F.round("best", 4).alias("best"), "status")


# ---- bridges and audits -----------------------------------------------------------------------------


def bridge_buckets(entries: DataFrame, clips: DataFrame, docs: int = DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with the bucket of about ``docs`` documents of their place; each document's bound; and for each bucket the clips that bridges
    of its documents may need, longest first: (place, bucket, place_in, clip_id, duration, before).

    entries: doc, place, segment, clip_id, start, source, trim, display_end. A gap uses up clips until it is covered, the last one in part;
    so a document needs a prefix of its place's clips by length whose sum is the sum of its gaps, and the longest clip once for each gap and
    each clip that it shows itself. A bucket gets the longest prefix of its documents: what is dealt out grows with the documents, not with
    documents times clips.
    """
    buckets = entries.groupBy("place").agg(F.ceil(F.approx_count_distinct("doc") / docs).alias("buckets"))
    of = F.broadcast(buckets.withColumnRenamed("place", "of"))
    dealt = entries.join(of, F.col("place").eqNullSafe(F.col("of"))).withColumn("bucket", F.pmod(F.xxhash64("doc"), "buckets")).drop("of", "buckets")
    open_ = F.greatest(F.col("display_end") - F.col("start") - F.greatest(F.col("source") - F.col("trim"), F.lit(0.0)), F.lit(0.0))
    need = dealt.groupBy("place", "bucket", "doc").agg(F.sum(open_).alias("need"), F.count("*").alias("n"))
    usable = clips.where("duration > 0").select("place", "clip_id", "duration")
    longest = usable.groupBy("place").agg(F.max("duration").alias("longest"))
    bounds = need.join(F.broadcast(longest), "place").select("place", "bucket", "doc", (F.col("need") + 2 * F.col("n") * F.col("longest")).alias("bound"))
    bound = bounds.groupBy("place", "bucket").agg(F.max("bound").alias("bound"))
    order = Window.partitionBy("place").orderBy(F.desc("duration"), "clip_id")
    before = F.coalesce(F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    listed = usable.withColumn("before", before).withColumn("place_in", F.row_number().over(order))
    # No bucket needs more than the longest prefix of its place.
    most = bound.groupBy("place").agg(F.max("bound").alias("most"))
    listed = listed.join(F.broadcast(most), "place").where(F.col("before") <= F.col("most"))
    prefix = listed.join(bound, "place").where(F.col("before") <= F.col("bound"))
    return dealt, bounds, prefix.select("place", "bucket", "place_in", "clip_id", "duration", "before")


def bridge_pools(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """The clips that each document's bridges may need: (doc, place_in, clip_id, duration), without those that it shows itself."""
    _, bounds, prefix = bridge_buckets(entries, clips)
    own = prefix.join(bounds, ["place", "bucket"]).where(F.col("before") <= F.col("bound"))
    return own.join(entries.select("doc", "clip_id").distinct(), ["doc", "clip_id"], "left_anti").select("doc", "place_in", "clip_id", "duration")


def bridge_fill(entries: DataFrame, clips: DataFrame, docs: int = DOCS) -> DataFrame:
    """(doc, segment, clip, start, used): the unused clips of a document's place that fill what its entries leave uncovered, longest first, each
    once a document. What no clip is left for has a row without clip. Entries without footage of their own (source 0) are left as they are."""
    footage = entries.where("source > 0")
    dealt, _, pools = bridge_buckets(footage, clips, docs)

    def fold(key: tuple, rows: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        listed = list(pool.sort_values("place_in")[["clip_id", "duration"]].itertuples(index=False, name=None))
        out, now, at, own = [], None, 0, set()
        shown = rows.groupby("doc")["clip_id"].agg(set)
        for e in rows.sort_values(["doc", "segment"]).itertuples(index=False):
            if e.doc != now:
                now, at, own = e.doc, 0, shown[e.doc]
            cursor = e.start + max(e.source - e.trim, 0.0)
            while e.display_end - cursor > TOLERANCE:
                while at < len(listed) and listed[at][0] in own:
                    at += 1
                if at == len(listed):
                    out.append((e.doc, e.segment, None, cursor, e.display_end - cursor))
                    break
                clip, length = listed[at]
                at += 1
                use = min(e.display_end - cursor, length)
                out.append((e.doc, e.segment, clip, cursor, use))
                cursor += use
        return pd.DataFrame(out, columns=["doc", "segment", "clip", "start", "used"])

    own = dealt.select("place", "bucket", "doc", "segment", "clip_id", "start", "source", "trim", "display_end")
    return own.groupBy("place", "bucket").cogroup(pools.groupBy("place", "bucket")).applyInPandas(fold, "doc long, segment long, clip string, start double, used double")


def audit(entries: DataFrame, segments: DataFrame, clips: DataFrame, n_words: DataFrame) -> DataFrame:
    """Rows (doc, segment, place, violation) of what assignments break; place is null for rules of a whole segment.

    entries: doc, segment, place (the order in the segment), clip_id, first_word, last_word, trim, span. segments: doc, segment, first_word,
    last_word. n_words: doc, n_words. clips: clip_id, duration_sec. Every segment has entries; indexes lie within the document's words and
    are in order; the entries tile their segment's words without gap or overlap; ids, padded to four digits, are known and used once a
    document; trims are not negative; and the clip is long enough behind its trim.
    """
    in_segment = Window.partitionBy("doc", "segment").orderBy("place")
    padded = entries.withColumn("clip", py_zfill(F.col("clip_id"), 4))
    turn = F.row_number().over(Window.partitionBy("doc", "clip").orderBy("segment", "place"))
    known = clips.select(py_zfill(F.col("clip_id"), 4).alias("clip"), "duration_sec").groupBy("clip").agg(F.max("duration_sec").alias("duration"))
    bounds = segments.select("doc", "segment", F.col("first_word").alias("from"), F.col("last_word").alias("to"))
    rows = padded.withColumn("turn", turn).withColumn("before", F.lag("last_word").over(in_segment)).withColumn("final", F.lead("place").over(in_segment).isNull())
    rows = rows.join(known, "clip", "left").join(bounds, ["doc", "segment"], "left").join(n_words, "doc", "left")
    expected = F.coalesce(F.col("before") + 1, F.col("from"))
    rules = {
        "unknown_segment": F.col("from").isNull(),
        "index_out_of_bounds": (F.col("first_word") < 0) | (F.col("last_word") >= F.col("n_words")) | (F.col("first_word") > F.col("last_word")),
        "gap": F.col("first_word") != expected,
        "short_of_segment": F.col("final") & (F.col("last_word") != F.col("to")),
        "no_clip": F.col("clip_id").isNull() | (F.col("clip_id") == ""),
        "unknown_clip": F.col("clip_id").isNotNull() & (F.col("clip_id") != "") & F.col("duration").isNull(),
        "repeated_clip": (F.col("clip_id") != "") & (F.col("turn") > 1),
        "negative_trim": F.col("trim") < 0,
        "too_short": F.col("duration") - F.col("trim") + TOLERANCE < F.col("span"),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    broken = rows.select("doc", "segment", F.col("place").cast("long").alias("place"), F.explode(found).alias("violation"))
    empty = segments.join(entries.select("doc", "segment").distinct(), ["doc", "segment"], "left_anti").select("doc", "segment", F.lit(None).cast("long").alias("place"), F.lit("missing_segment").alias("violation"))
    return broken.unionByName(empty)
