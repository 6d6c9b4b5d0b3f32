"""Beats and caption phrases of narrations, as windows and folds over the arrays of a segment.

Words are rows (doc, segment, word_idx, word, start, end). A segment, or a stretch without a pause or full
stop, is one array; nothing larger is gathered. A narration whose budget is smaller than its
number of segments has no plan: it gives one row with that status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.sequences import largest_remainder

#: How much farther from its grid time a clause may start than the nearest word, in seconds.
SNAP = 0.6
#: Signs that end a clause, and closers that may follow them.
SIGNS, CLOSERS = ",.;:!?…—", "\"'”’)»]"


def is_boundary(word: Column) -> Column:
    """Whether a word ends a clause, closing quotes and brackets aside."""
    return word.rlike("[" + SIGNS + "][" + CLOSERS.replace("]", "\\]") + "]*$")


def _span(low: Column, high: Column) -> Column:
    """low..high, nothing if high is below low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def _narration(words: DataFrame) -> DataFrame:
    """A row a segment: w, its words in order (word_idx, start, ends), the segment's start, and until, the next one's start or the narration's end."""
    w = F.array_sort(F.collect_list(F.struct("word_idx", "start", is_boundary(F.col("word")).alias("ends"))))
    per = words.groupBy("doc", "segment").agg(w.alias("w"), F.max("end").alias("end")).withColumn("start", F.col("w")[0]["start"])
    doc = Window.partitionBy("doc")
    return per.withColumn("until", F.coalesce(F.lead("start").over(doc.orderBy("segment")), F.max("end").over(doc))).drop("end")


def _grid(first: Column, last: Column, start: Column, end: Column, n: Column) -> Column:
    """Places where n parts of the words first..last start: on equal times, or on a clause if one starts about as near."""
    at = lambda i: F.get("w", i - 1)

    def add(starts: Column, k: Column) -> Column:
        want = start + (end - start) * k / n
        free = _span(_last(starts) + 1, last - n + k + 1)  # later parts keep a word each
        away = lambda places: F.array_min(F.transform(places, lambda i: F.struct(F.abs(at(i)["start"] - want).alias("d"), i.alias("i"))))
        word, clause = away(free), away(F.filter(free, lambda i: at(i - 1)["ends"]))
        return F.concat(starts, F.array(F.when(clause["d"] <= word["d"] + SNAP, clause["i"]).otherwise(word["i"])))

    return F.aggregate(_span(F.lit(1), n - 1), F.array(first), add)


def _clauses(least: float, most: float) -> Column:
    """Places in w where beats start: clauses joined while short, long ones cut."""
    n, until = F.size("w"), F.col("until")
    heads = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get("w", i - 2)["ends"], F.lit(True)))
    time = lambda i: F.coalesce(F.get("w", i - 1)["start"], until)
    clauses = F.transform(heads, lambda i, k: F.struct(i.alias("i"), time(i).alias("start"), time(F.get(heads, k + 1)).alias("end")))

    def join(beats: Column, c: Column) -> Column:
        since = _last(beats)["start"]
        short = (c["start"] - since < least) & (c["end"] - since <= most)
        return F.when(F.coalesce(short, F.lit(False)), beats).otherwise(F.concat(beats, F.array(F.struct(c["i"].alias("i"), c["start"].alias("start")))))

    return F.aggregate(clauses, F.expr("cast(array() as array<struct<i: int, start: double>>)"), join)


def _plan(rows: DataFrame, least: float, most: float) -> DataFrame:
    """rows with starts, the places in w where beats start."""
    until, size = F.col("until"), F.size("joined")
    rows = rows.withColumn("joined", _clauses(least, most))
    before = F.get("joined", size - 2)["start"]
    short_tail = (size > 1) & (until - _last(F.col("joined"))["start"] < least) & (until - before <= most)
    rows = rows.withColumn("joined", F.when(F.coalesce(short_tail, F.lit(False)), F.slice("joined", 1, size - 1)).otherwise(F.col("joined")))

    def split(b: Column, k: Column) -> Column:
        after = F.get("joined", k + 1)
        last, end = F.coalesce(after["i"] - 1, F.size("w")), F.coalesce(after["start"], until)
        span = end - b["start"]
        parts = F.least(F.ceil(span / most).cast("int"), last - b["i"] + 1)
        return F.when(span > most, _grid(b["i"], last, b["start"], end, parts)).otherwise(F.array(b["i"]))

    return rows.withColumn("starts", F.flatten(F.transform("joined", split))).drop("joined")


def beats(words: DataFrame, least: float = 2.0, most: float = 4.0, budget: int | None = None) -> DataFrame:
    """Beats of every narration: doc, beat, segment, first_word, last_word; with a budget also status, ``ok`` or ``budget_below_segments``."""
    plan = _plan(_narration(words), least, most)
    doc = Window.partitionBy("doc")
    if budget is not None:
        counted = plan.withColumn("over", F.sum(F.size("starts")).over(doc) > budget).withColumn("segments", F.count("*").over(doc))
        shared = largest_remainder(counted.withColumn("span", F.greatest(F.col("until") - F.col("start"), F.lit(0.0))), F.col("span"), budget, "doc", "segment")
        parts = F.least(F.col("share").cast("int"), F.size("w"))
        shared = shared.withColumn("starts", F.when(F.col("over"), _grid(F.lit(1), F.size("w"), F.col("start"), F.col("until"), parts)).otherwise(F.col("starts")))
        plan = shared.where(F.col("segments") <= budget)
    ends = F.transform("starts", lambda i, k: F.struct(i.alias("i"), F.coalesce(F.get("starts", k + 1) - 1, F.size("w")).alias("j")))
    flat = plan.select("doc", "segment", "w", F.posexplode(ends).alias("place", "b"))
    number = F.row_number().over(doc.orderBy("segment", "place")) - 1
    word = lambda i: F.get("w", i - 1)["word_idx"].cast("long")
    out = flat.select(F.col("doc").cast("long").alias("doc"), number.cast("long").alias("beat"), F.col("segment").cast("long").alias("segment"), word(F.col("b.i")).alias("first_word"), word(F.col("b.j")).alias("last_word"))
    if budget is None:
        return out
    none = F.lit(None).cast("long")
    without = shared.where(F.col("segments") > budget).select(F.col("doc").cast("long").alias("doc")).distinct()
    failed = without.select("doc", none.alias("beat"), none.alias("segment"), none.alias("first_word"), none.alias("last_word"), F.lit("budget_below_segments").alias("status"))
    return out.withColumn("status", F.lit("ok")).unionByName(failed)


def caption_phrases(words: DataFrame, long: int = 8, comma: int = 4, pause: float = 0.25) -> DataFrame:
    """Caption phrases: doc, phrase, first_word, last_word. A full stop or pause ends one, a comma from ``comma`` words on, and ``long`` words."""
    order = Window.partitionBy("doc").orderBy("word_idx")
    gap = F.lead("start").over(order) - F.col("end")
    marked = words.withColumn("stop", F.col("word").rlike("[.!?;]$") | F.coalesce(gap > pause + 1e-9, F.lit(True)))
    # What lies between two stops is one array; a phrase never crosses them.
    run = F.coalesce(F.sum(F.col("stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = marked.withColumn("run", run).groupBy("doc", "run").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.col("word").endswith(",").alias("comma")))).alias("w"))

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + 1
        cut = (x["comma"] & (n >= comma)) | (n >= long)
        return F.struct(F.when(cut, 0).otherwise(n).alias("n"), F.when(cut, F.concat(state["cuts"], F.array(x["word_idx"]))).otherwise(state["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("cuts"))
    cuts = F.aggregate("w", start, step)["cuts"]
    ends = rows.select("doc", F.get("w", F.lit(0))["word_idx"].alias("head"), F.array_distinct(F.concat(cuts, F.array(_last(F.col("w"))["word_idx"]))).alias("ends"))
    flat = ends.select("doc", "head", "ends", F.posexplode("ends").alias("k", "last_word"))
    first = F.coalesce(F.get("ends", F.col("k") - 1) + 1, F.col("head"))
    out = flat.select("doc", first.cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))
    return out.withColumn("phrase", (F.row_number().over(Window.partitionBy("doc").orderBy("first_word")) - 1).cast("long")).select(F.col("doc").cast("long").alias("doc"), "phrase", "first_word", "last_word")
