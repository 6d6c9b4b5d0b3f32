"""Interval and sequence operators: windows, merges, gaps, running offsets, groups, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import round_binary


# ---- intervals ------------------------------------------------------------------------------------


def used_windows(ledger: DataFrame) -> DataFrame:
    """Ledger rows as (asset_id, start, end, source) on the source's clock; malformed and stale rows are dropped."""
    trim, first, last, source = (F.col(c).try_cast("double") for c in ("trim_start_sec", "display_start_sec", "display_end_sec", "source_duration_sec"))
    start = F.greatest(trim, F.lit(0.0))
    end = start + (last - first)
    known = source > 0
    cut = ledger.where(trim.isNotNull() & (last > first)).select("asset_id", F.when(known, F.least(start, source)).otherwise(start).alias("start"), F.when(known, F.least(end, source)).otherwise(end).alias("end"), source.alias("source"))
    return cut.where(F.col("end") > F.col("start"))


def merge_windows(windows: DataFrame, key: str = "asset_id") -> DataFrame:
    """Overlapping and touching windows of a key as one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return windows.withColumn("new", new).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def free_windows(windows: DataFrame, sources: DataFrame, least: float, key: str = "asset_id") -> DataFrame:
    """Gaps (key, start, end) of at least ``least`` seconds, and of some length, that windows leave of each source (key, source), from 0 to its end.

    A source without windows is free as a whole; what windows have beyond a source is cut off first. Windows may overlap.
    """
    known = sources.where(F.col("source") > 0)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("source"))
    cut = windows.select(key, "start", "end").join(known, key).select(key, clamp(F.col("start")).alias("start"), clamp(F.col("end")).alias("end"))
    # The end of a source is a window without length: the gap before it is the last.
    edges = cut.unionByName(known.select(key, F.col("source").alias("start"), F.col("source").alias("end")))
    reach = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    gaps = edges.select(key, F.coalesce(reach, F.lit(0.0)).alias("from"), F.col("start").alias("to"))
    long_enough = (F.col("to") - F.col("from") >= least) & (F.col("to") > F.col("from"))
    return gaps.where(long_enough).select(key, F.col("from").alias("start"), F.col("to").alias("end")).distinct()


def least_overlap(asked: DataFrame, merged: DataFrame, by: list[str], key: str = "asset_id") -> DataFrame:
    """Rows (by, key, source, span) with the trim of least overlap with the key's windows, the earliest such; candidates are 0 and the places
    just beside a window, within the source. A source without windows is taken from 0."""
    top = F.greatest(F.lit(0.0), F.col("source") - F.col("span"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), top)
    own = [*dict.fromkeys([*by, key]), "source", "span"]
    beside = asked.join(merged, key).select(*own, F.explode(F.array(clamp(F.col("end")), clamp(F.col("start") - F.col("span")))).alias("t"))
    tries = beside.unionByName(asked.select(*own, F.lit(0.0).alias("t"))).distinct()
    overlap = F.greatest(F.least(F.col("t") + F.col("span"), F.col("end")) - F.greatest("t", F.col("start")), F.lit(0.0))
    scored = tries.join(merged, key, "left").groupBy(*by, "t").agg(F.sum(F.coalesce(overlap, F.lit(0.0))).alias("overlap"))
    return scored.groupBy(*by).agg(F.min(F.struct("overlap", "t")).alias("best")).select(*by, F.col("best.t").alias("trim"), F.col("best.overlap").alias("overlap"))


def phase_trim(phase: Column, start: Column, end: Column, span: Column) -> Column:
    """Where a span starts in a free window: late phases at its end, middle ones centred, else its start."""
    slack = end - start - span
    late, middle = phase.rlike("late|end|climax"), phase.rlike("mid|peak")
    return F.when(slack <= 0, start).when(late, start + slack).when(middle, start + slack / 2).otherwise(start)


# ---- sequences ------------------------------------------------------------------------------------


def display_spans(segments: DataFrame, end: Column, key: str = "doc", order: str = "segment") -> DataFrame:
    """segments with the time to the next one's start; the last goes on to the end; never negative."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy(order))
    return segments.withColumn("span", F.greatest(F.coalesce(following, end) - F.col("start"), F.lit(0.0)))


def word_ranges(segments: DataFrame, count: Column, key: str = "doc", order: str = "segment") -> DataFrame:
    """segments with the first and last word index that their counts give."""
    last = F.sum(count).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("last_word", last - 1).withColumn("first_word", F.col("last_word") - count + 1)


def pause_batches(segments: DataFrame, key: str = "doc", order: str = "segment", least: int = 2) -> DataFrame:
    """segments with a batch number that grows after every pause of at least ``least``."""
    w = Window.partitionBy(key).orderBy(order)
    breaks = F.when(F.coalesce(F.lag("pause_weight").over(w), F.lit(0)) >= least, 1).otherwise(0)
    return segments.withColumn("__b", breaks).withColumn("batch", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def running_offsets(parts: DataFrame, length: Column, key: str = "doc", order: str = "batch") -> DataFrame:
    """parts with the sum of the lengths before each."""
    before = F.sum(length).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("offset", F.coalesce(before, F.lit(0.0)))


def next_valid(rows: DataFrame, valid: Column, key: str = "doc", order: str = "segment") -> DataFrame:
    """rows with the start of the first later row that is valid."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_start", F.first(F.when(valid, F.col("start")), ignorenulls=True).over(w))


def monotonic_repair(rows: DataFrame, value: str, step: int, key: str = "doc", order: str = "segment") -> DataFrame:
    """rows whose whole-number values rise by at least a step: each becomes the largest of what the earlier ones allow."""
    w = Window.partitionBy(key).orderBy(order)
    turn = F.row_number().over(w)
    held = F.max(F.col(value) - F.col("__n") * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__n", turn).withColumn("repaired", (held + F.col("__n") * step).cast("long")).drop("__n")


def caption_visibility(rows: DataFrame, hold: float, key: str = "doc", order: str = "segment") -> DataFrame:
    """rows with the time until which each shows: its end and a hold, or the next start if that comes first."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("visible_until", F.least(F.col("end") + hold, following))


def largest_remainder(rows: DataFrame, weight: Column, total: int, key: str, order: str) -> DataFrame:
    """Whole shares of total by weight, one at least each; what is left goes to the largest fractions, ties in order."""
    whole = Window.partitionBy(key)
    spare = F.greatest(F.lit(total) - F.count("*").over(whole), F.lit(0))
    every = F.sum(weight).over(whole)
    exact = rows.withColumn("__exact", F.coalesce(spare * weight / F.nullif(every, every * 0), F.lit(0.0))).withColumn("__spare", spare)
    floored = exact.withColumn("__floor", F.floor("__exact")).withColumn("__left", F.col("__spare") - F.sum(F.floor("__exact")).over(whole))
    turn = F.row_number().over(whole.orderBy(F.desc(F.col("__exact") - F.col("__floor")), order))
    share = (1 + F.col("__floor") + F.when(turn <= F.col("__left"), 1).otherwise(0)).cast("long")
    return floored.withColumn("share", share).drop("__exact", "__spare", "__floor", "__left")


def capped_shares(rows: DataFrame, size: str, total: int, key: str, order: str) -> DataFrame:
    """Shares of total in proportion to size: one at least, never more than there are; what is left goes round twice by the largest fractions."""
    whole = Window.partitionBy(key)
    n = F.col(size)
    target = F.least(F.lit(total), F.sum(n).over(whole))
    exact = target * n / F.sum(n).over(whole)
    shared = rows.withColumn("__exact", exact).withColumn("share", F.greatest(F.lit(1), F.least(n, F.floor("__exact"))))
    turn = whole.orderBy(F.desc(F.col("__exact") - F.floor("__exact")), order)
    for _ in range(2):
        left = F.least(F.lit(total), F.sum(n).over(whole)) - F.sum("share").over(whole)
        shared = shared.withColumn("__left", left).withColumn("__room", (F.col("share") < n).cast("int"))
        shared = shared.withColumn("__turn", F.sum("__room").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
        shared = shared.withColumn("share", F.col("share") + F.when((F.col("__room") == 1) & (F.col("__turn") <= F.col("__left")), 1).otherwise(0))
    return shared.withColumn("share", F.col("share").cast("long")).drop("__exact", "__left", "__room", "__turn")


def pause_budget(segments: DataFrame, target: float, wpm: float, cap: int, key: str = "doc", order: str = "segment") -> DataFrame:
    """segments with pause_ms: the time that speech leaves, by weight over pauses of weight 2 or more, but never after the last."""
    whole = Window.partitionBy(key)
    last = F.max(order).over(whole) == F.col(order)
    weight = F.when((F.col("pause_weight") >= 2) & ~last, F.col("pause_weight")).otherwise(0)
    need = F.lit(target) * 0.9 - F.sum("word_count").over(whole) / wpm * 60
    weighted = segments.withColumn("__w", weight).withColumn("__need", need)
    weighted = weighted.withColumn("__sum", F.sum("__w").over(whole))
    raw = F.bround(F.col("__need") * 1000 / 1.1)
    ms = F.least(F.bround(F.bround(raw * F.col("__w") / F.col("__sum")) * 1.1), F.lit(float(cap)))
    return weighted.withColumn("pause_ms", F.when((F.col("__need") > 0) & (F.col("__w") > 0), ms).otherwise(0.0).cast("long")).drop("__w", "__need", "__sum")


def round_robin(rows: DataFrame, choices: list[str], key: str, order: list[str]) -> DataFrame:
    """rows with a choice dealt in turn within a key."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    options = F.array(*map(F.lit, choices))
    return rows.withColumn("choice", F.get(options, F.pmod(turn - 1, F.lit(len(choices))).cast("int")))


def rotate(rows: DataFrame, start: int, take: int, key: str, order: list[str]) -> DataFrame:
    """The first ``take`` rows of a key, counted round from row ``start``."""
    w = Window.partitionBy(key)
    turned = rows.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("__size", F.count("*").over(w))
    place = F.pmod(F.col("__n") - 1 - start, F.col("__size"))
    return turned.withColumn("place", place).where(F.col("place") < take).drop("__n", "__size")


def rate_metric(words: DataFrame, key: str = "doc") -> DataFrame:
    """Words a minute from the first start to the last end; null for fewer than two words or no time."""
    span = F.max("end") - F.min("start")
    n = F.count("*")
    return words.groupBy(key).agg(n.alias("n_words"), F.when((n >= 2) & (span > 0), n / span * 60).alias("wpm"))


def pause_windows(words: DataFrame, least: float, key: str = "doc", order: str = "word_idx") -> DataFrame:
    """Gaps of at least ``least`` seconds between a word's end and the next start."""
    gap = F.lead("start").over(Window.partitionBy(key).orderBy(order)) - F.col("end")
    return words.withColumn("gap", gap).where(F.col("gap") >= least)


def allocate_words(words: DataFrame, segments: DataFrame, batches: DataFrame) -> DataFrame:
    """(doc, segment, start, end, duration, word_count): the spans of segments from the timed words of their batches.

    words: doc, batch, word_idx, start, end, on the batch's clock. segments: doc, batch, segment, word_count, text. batches: doc, batch,
    duration, silence. Each batch starts after the ones before and their silences. Where a batch's declared words are as many as its timed
    ones, segments take theirs in order; elsewhere the words are dealt out in proportion to the characters of the texts (one at least), the
    last segment taking the rest. A segment without words lies at its batch's start.
    """
    in_doc, in_batch = Window.partitionBy("doc").orderBy("batch"), Window.partitionBy("doc", "batch").orderBy("segment")
    until = in_batch.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc", "batch")
    before = F.sum(F.col("duration") + F.col("silence")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    offsets = batches.select("doc", "batch", F.coalesce(before, F.lit(0.0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("doc", "batch").orderBy("word_idx"))
    timed = words.withColumn("place", place).select("doc", "batch", "place", "start", "end")
    counts = timed.groupBy("doc", "batch").agg(F.count("*").alias("n"))
    declared = F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(0)).cast("long")
    chars = F.greatest(F.length(F.trim(F.coalesce("text", F.lit("")))), F.lit(1)).cast("long")
    asked = segments.join(counts, ["doc", "batch"], "left").join(offsets, ["doc", "batch"]).withColumn("n", F.coalesce("n", F.lit(0)))
    asked = asked.withColumn("exact", (F.sum(declared).over(whole) == F.col("n")) & (F.col("n") > 0))
    share = F.least(F.rint(F.col("n") * F.sum(chars).over(until) / F.sum(chars).over(whole)).cast("long"), F.col("n"))
    last = F.lead("segment").over(in_batch).isNull()
    asked = asked.withColumn("to", F.when(F.col("exact"), F.sum(declared).over(until)).when(last, F.col("n")).otherwise(share))
    asked = asked.withColumn("from", F.coalesce(F.lag("to").over(in_batch), F.lit(0)))
    head = timed.select("doc", "batch", F.col("place").alias("p0"), "start")
    tail = timed.select("doc", "batch", F.col("place").alias("p1"), "end")
    spanned = asked.withColumn("p0", F.when(F.col("to") > F.col("from"), F.col("from") + 1)).withColumn("p1", F.when(F.col("to") > F.col("from"), F.col("to")))
    spanned = spanned.join(head, ["doc", "batch", "p0"], "left").join(tail, ["doc", "batch", "p1"], "left")
    at = lambda c: round_binary(F.when(F.col("p0").isNotNull(), round_binary(F.col(c) + F.col("offset"), 3)).otherwise(F.col("offset")), 3)
    out = spanned.select("doc", "segment", at("start").alias("start"), at("end").alias("end"), (F.col("to") - F.col("from")).alias("word_count"))
    return out.withColumn("duration", round_binary(F.col("end") - F.col("start"), 3))


def spoken_words(chars: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, pos, c) of characters as words: (by, first_pos, last_pos, word). White space and each < part words; what stands in <...>,
    nested too, is left out, and its brackets with it. A > without an open < is a character like any other."""
    order = Window.partitionBy(*by).orderBy("pos")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    # A depth that never falls below zero: the running sum less the least that it has been.
    step = F.when(F.col("c") == "<", 1).when(F.col("c") == ">", -1).otherwise(0)
    raw = chars.withColumn("sum", F.sum(step).over(until))
    raw = raw.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(until), F.lit(0)))
    raw = raw.withColumn("was", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    blank = F.col("c").rlike("^\\s$")
    raw = raw.withColumn("island", F.sum(F.when(blank | (F.col("c") == "<"), 1).otherwise(0)).over(until))
    said = raw.where((F.col("depth") == 0) & ~((F.col("c") == ">") & (F.col("was") > 0)) & ~blank)
    letters = F.array_sort(F.collect_list(F.struct("pos", "c")))  # one word's
    return said.groupBy(*by, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("word")).drop("island")
