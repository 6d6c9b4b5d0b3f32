"""Greedy and global packs against a plain replay of their rules, pools beyond what a fold gets at first."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import assignment as A

TOL = 0.05


def free(source, used, least):
    gaps, cursor = [], 0.0
    for a, z in sorted(used):
        a, z = min(max(0.0, a), source), min(max(0.0, z), source)
        if a > cursor:
            gaps.append((cursor, a))
        cursor = max(cursor, z)
    if source > cursor:
        gaps.append((cursor, source))
    return [g for g in gaps if g[1] - g[0] >= least]


def trim_of(clip, span, used):
    """The trim, and whether no free window is long enough."""
    gaps = free(clip["duration"], used, span)
    if gaps:
        (a, z), phase = gaps[0], clip["phase"]
        slack = z - a - span
        if slack <= 0:
            return a, False
        return (a + slack if any(x in phase for x in ("late", "end", "climax")) else a + slack / 2 if any(x in phase for x in ("mid", "peak")) else a), False
    top = max(0.0, clip["duration"] - span)
    tries = {0.0} | {min(max(0.0, z), top) for _, z in used} | {min(max(0.0, a - span), top) for a, _ in used}
    overlap = lambda t: sum(max(0.0, min(t + span, z) - max(t, a)) for a, z in used)
    return min(tries, key=lambda t: (overlap(t), t)), True


def make(seed, n_clips, n_beats, videos=2, dims=6):
    rnd = np.random.default_rng(seed)
    clips = []
    for i in range(n_clips):
        v = rnd.normal(size=dims)
        u = rnd.normal(size=dims)
        clips.append({"place": i % 2, "vec_id": i, "asset": f"a{i % (n_clips * 3 // 4)}", "v": v, "u": None if i % 7 == 0 else u / np.linalg.norm(u), "duration": float(rnd.integers(4, 40)) / 4, "category": ["", "x", "y", "z"][int(rnd.integers(4))], "phase": ["early", "MID", "climax", None, "late"][i % 5]})
    beats = [{"video": v, "place": v % 2, "beat": b, "q": rnd.normal(size=dims), "span": float(rnd.integers(2, 24)) / 4} for v in range(videos) for b in range(n_beats)]
    windows = collections.defaultdict(list)
    for c in clips:
        at = 0.0
        while rnd.random() < 0.6:
            a = at + float(rnd.integers(0, 8)) / 4
            z = a + float(rnd.integers(1, 12)) / 4
            windows[c["asset"]].append((a, z))
            at = z + 0.25
        windows[c["asset"]] = merged(windows[c["asset"]])
    return beats, clips, windows


def merged(w):
    out = []
    for a, z in sorted(w):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def frames(spark, beats, clips, windows):
    b = spark.createDataFrame([(x["video"], x["place"], x["beat"], x["q"].tolist(), x["span"]) for x in beats], "video long, place int, beat long, q array<double>, span double")
    c = spark.createDataFrame([(x["place"], x["vec_id"], x["asset"], x["v"].tolist(), None if x["u"] is None else x["u"].tolist(), x["duration"], x["category"], x["phase"]) for x in clips], "place int, vec_id long, asset_id string, v array<double>, u array<double>, duration_sec double, category string, phase string")
    w = spark.createDataFrame([(k, a, z) for k, v in windows.items() for a, z in v], "asset_id string, start double, end double")
    return b, c, w


def cos(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def replay(beats, clips, windows, threshold):
    """The ladder, pass after pass over each beat's ranking."""
    out = {}
    for video in sorted({b["video"] for b in beats}):
        seen, units, before = set(), [], ""
        for b in (x for x in beats if x["video"] == video):
            ranking = sorted((c for c in clips if c["place"] == b["place"]), key=lambda c: (-cos(b["q"], c["v"]), c["vec_id"]))
            usable = [c for c in ranking if c["vec_id"] not in seen and c["duration"] + TOL >= b["span"]]
            near = lambda c: threshold is not None and c["u"] is not None and any(float(c["u"] @ x) >= threshold for x in units)  # noqa: B023, E731
            found = None
            for diverse in (True, False) if threshold is not None else (False,):
                for unlike in (True, False):
                    for c in usable:
                        if unlike and before and c["category"] == before or diverse and near(c):
                            continue
                        if free(c["duration"], windows[c["asset"]], b["span"]):
                            found = found or (c, not unlike, threshold is not None and not diverse)
                    if found:
                        break
                if found:
                    break
            if not found and usable:
                found = (usable[0], False, False)
            if not found:
                out[video, b["beat"]] = (None, None, False, False, False, "uncovered")
                continue
            c, same, dup = found
            seen.add(c["vec_id"])
            units += [c["u"]] if c["u"] is not None else []
            before = c["category"] or before
            trim, exhausted = trim_of({**c, "phase": (c["phase"] or "").lower()}, b["span"], windows[c["asset"]])
            out[video, b["beat"]] = (c["vec_id"], round(trim, 3), exhausted, same, dup, "ok")
    return out


@pytest.mark.parametrize(("seed", "threshold", "n"), [(0, None, 80), (1, 0.6, 80), (2, -0.2, 60), (3, 0.9, 14)])
def test_greedy_pack_is_the_ladder(spark, seed, threshold, n):
    beats, clips, windows = make(seed, n, 7)
    found = A.greedy_pack(*frames(spark, beats, clips, windows), threshold=threshold).collect()
    got = {(r.video, r.beat): (r.vec_id, None if r.trim_start is None else round(r.trim_start, 3), r.exhausted, r.same_category, r.near_duplicate, r.status) for r in found}
    assert got == replay(beats, clips, windows, threshold)


def test_greedy_pack_in_blocks(spark, monkeypatch):
    """Pools and videos meet in blocks, each of which gives one clip a video; the picks are those of the whole pool."""
    monkeypatch.setattr(A, "ROWS", 9)
    monkeypatch.setattr(A, "QUERIES", 1)
    beats, clips, windows = make(5, 60, 4)
    b, c, w = frames(spark, beats, clips, windows)
    found = A.greedy_pack(b, c, w, threshold=0.6).collect()
    assert {(r.video, r.beat): r.vec_id for r in found} == {k: x[0] for k, x in replay(beats, clips, windows, 0.6).items()}
    pool, _ = A.with_windows(c, w)
    none = [F.array().cast(kind).alias(name) for name, kind in (("chosen", "array<long>"), ("units", "array<array<double>>"))]
    asked = b.where("beat = 0").select("video", "place", "q", "span", *none, F.lit("").alias("before"))
    rows = A._first_by_ladder(asked, pool, 0.6).groupBy("video").count().collect()
    assert len(rows) == asked.count() and all(1 < r["count"] <= -(-60 // 9) for r in rows)


def test_packs_without_beats_or_clips(spark):
    beats, clips, windows = frames(spark, *make(0, 8, 2))
    assert A.greedy_pack(beats.limit(0), clips, windows).isEmpty() and A.global_pack(beats.limit(0), clips, windows).isEmpty()
    assert {r.status for r in A.greedy_pack(beats, clips.limit(0), windows).collect()} == {"uncovered"}
    assert {r.status for r in A.global_pack(beats, clips.limit(0), windows).collect()} == {"uncovered"}


def full_rounds(beats, clips, windows, threshold):
    """Costs of the picks of each round by the whole matrix; the picks of the last."""
    out = {}
    for video in sorted({b["video"] for b in beats}):
        own, pool = [b for b in beats if b["video"] == video], None
        pool = [c for c in clips if c["place"] == own[0]["place"]]
        n, m = len(own), len(pool)
        base = np.full((n, m + n), A.IMPOSSIBLE)
        for i, b in enumerate(own):
            for j, c in enumerate(pool):
                if c["duration"] + TOL >= b["span"]:
                    base[i, j] = -cos(b["q"], c["v"]) + (0 if free(c["duration"], windows[c["asset"]], b["span"]) else A.STALE)
        picks = A.solve(base)
        for _ in range(6):
            cost = base.copy()
            for i in range(n):
                around = {pool[picks[k]]["category"] for k in (i - 1, i + 1) if 0 <= k < n and picks[k] < m} - {""}
                others = [pool[p]["u"] for k, p in enumerate(picks) if k != i and p < m and pool[p]["u"] is not None]
                for j, c in enumerate(pool):
                    if cost[i, j] < A.IMPOSSIBLE:
                        cost[i, j] += A.NEIGHBOUR * (c["category"] in around)
                        if threshold is not None and c["u"] is not None:
                            cost[i, j] += A.TWIN * any(float(c["u"] @ o) >= threshold for o in others)
            after = A.solve(cost)
            if after == picks:
                break
            picks = after
        out[video] = [None if p >= m else pool[p]["vec_id"] for p in picks]
    return out


@pytest.mark.parametrize(("seed", "threshold", "n", "first"), [(0, None, 300, 8), (1, 0.5, 300, 8), (2, 0.2, 300, 16), (3, 0.5, 9, 8), (4, 0.4, 5000, 64)])
def test_global_pack_equals_the_whole_matrix(spark, seed, threshold, n, first):
    beats, clips, windows = make(seed, n, 6, videos=3)
    found = A.global_pack(*frames(spark, beats, clips, windows), threshold=threshold, first=first).collect()
    want = full_rounds(beats, clips, windows, threshold)
    by_id = {c["vec_id"]: c for c in clips}
    picks = {(r.video, r.beat): r.vec_id for r in found}
    assert {v: [picks[v, b] for b in range(6)] for v in want} == want
    for r in found:
        b = next(x for x in beats if (x["video"], x["beat"]) == (r.video, r.beat))
        best = max((cos(b["q"], c["v"]) for c in clips if c["place"] == b["place"] and c["duration"] + TOL >= b["span"]), default=None)
        if r.vec_id is None:
            assert r.status == "uncovered"
            continue
        c = by_id[r.vec_id]
        trim, exhausted = trim_of({**c, "phase": (c["phase"] or "").lower()}, b["span"], windows[c["asset"]])
        assert (r.trim_start, r.exhausted) == (pytest.approx(trim, abs=6e-4), exhausted)
        assert r.displaced == (best - cos(b["q"], c["v"]) >= A.DISPLACED) and r.best == pytest.approx(best, abs=6e-5)
