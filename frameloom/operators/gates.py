"""Gates of a narration script: soft repair, structure, script only; each sees the text that the one before repaired.

Segments are rows (doc, segment, text, pause_weight, clips, clip_id): clips are the ids of a segment's clips, clip_id
is the one clip of the older form. Rules that are broken are reported per document, as sorted texts with the
place of the segment from 1; nothing raises. A document without rows is in none of the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import text as T


@dataclass(frozen=True)
class Profile:
    """What a format asks for. In long formats too few words are a violation, in others the pauses take the time."""

    segments: int = 4
    words: tuple[int, int] = (145, 900)
    segment_words: tuple[int, int] = (20, 260)
    clips: tuple[int, int] = (4, 12)
    most_clips: int = 4
    long: bool = True


def repair(segments: DataFrame, profile: Profile) -> DataFrame:
    """segments with the text repaired: openers go from every segment, then last sentences from the last one while there are too many words.

    place is the segment's place, word_count its words; last marks the last segment of a document.
    """
    opened = segments.withColumn("text", T.strip_opener(F.col("text")))
    trimmed = T.trim_overflow(opened.select("doc", "segment", F.coalesce("text", F.lit("")).alias("text")), *profile.words)
    out = opened.drop("text").join(trimmed, ["doc", "segment"]).join(opened.select("doc", "segment", F.col("text").isNull().alias("no_text")), ["doc", "segment"])
    order = Window.partitionBy("doc").orderBy("segment")
    out = out.withColumn("text", F.when(~F.col("no_text"), F.col("text"))).drop("no_text").withColumn("word_count", T.word_count(F.col("text")))
    return out.withColumn("place", F.row_number().over(order)).withColumn("last", F.lead("segment").over(order).isNull())


def _told(name: str, *values: Column) -> Column:
    return F.concat_ws(":", F.lit(name), *(v.cast("string") for v in values))


def _words(profile: Profile) -> Column:
    low, high = profile.segment_words
    return F.when(~F.col("word_count").between(low, high), _told("words", F.col("place"), F.col("word_count")))


def _counted(per: DataFrame, profile: Profile) -> Column:
    return F.when(F.col("n_segments") != profile.segments, _told("segments", F.col("n_segments")))


def _joined(rules: list[Column], terms: Column) -> Column:
    """What a document breaks, in order: single rules, then arrays of them."""
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*rules)), terms)))


def _banned(text: Column, words: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    return F.transform(T.banned_terms(text, words, phrases), lambda t: F.concat(F.lit("banned:"), t))


def floor_gate(repaired: DataFrame, profile: Profile) -> DataFrame:
    """(doc, total_words, violations): long formats need the least number of words."""
    per = repaired.groupBy("doc").agg(F.sum("word_count").alias("total_words"))
    low = F.when(F.lit(profile.long) & (F.col("total_words") < profile.words[0]), _told("below_floor", F.col("total_words")))
    return per.select("doc", "total_words", F.array_compact(F.array(low)).alias("violations"))


def _per_document(repaired: DataFrame, single: Column, **more: Column) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ")
    return repaired.groupBy("doc").agg(F.count("*").alias("n_segments"), F.flatten(F.collect_list(single)).alias("found"), text.alias("text"), *(c.alias(n) for n, c in more.items()))


def script_only_gate(repaired: DataFrame, profile: Profile, words: tuple[str, ...] = T.BANNED_WORDS, phrases: tuple[str, ...] = T.BANNED_PHRASES) -> DataFrame:
    """(doc, violations) of texts alone: number of segments, missing texts, words of each, pause weights 1 to 3 but for the last, banned terms."""
    weight = F.when(~F.col("last") & ~F.coalesce(F.col("pause_weight").isin(1, 2, 3), F.lit(False)), _told("pause_weight", F.col("place")))
    missing = F.when(F.col("text").isNull(), _told("no_text", F.col("place")))
    per = _per_document(repaired, F.array_compact(F.array(missing, _words(profile), weight)))
    return per.select("doc", _joined([_counted(per, profile)], F.concat("found", _banned(F.col("text"), words, phrases))).alias("violations"))


def structural_gate(repaired: DataFrame, inventory: DataFrame, profile: Profile, words: tuple[str, ...] = T.BANNED_WORDS, phrases: tuple[str, ...] = T.BANNED_PHRASES) -> DataFrame:
    """(doc, violations) of texts and clips. Where segments or fields are missing, only that is reported. Else words, clips of each segment
    (one to most_clips; the one clip of the older form counts as a list), clips in all, clips that are used twice or not in the inventory (clip_id), banned terms."""
    ids = F.coalesce("clips", F.when(F.col("clip_id").isNotNull(), F.array("clip_id")))
    given = repaired.withColumn("ids", ids).withColumn("n", F.coalesce(F.size("ids"), F.lit(0)))
    missing = F.array_compact(F.array(F.when(F.col("text").isNull(), _told("no_text", F.col("place"))), F.when(F.col("ids").isNull(), _told("no_clips_field", F.col("place")))))
    rules = F.array_compact(F.array(_words(profile), F.when(F.col("n") == 0, _told("no_clips", F.col("place"))).when(F.col("n") > profile.most_clips, _told("many_clips", F.col("place"), F.col("n")))))
    uses = given.select("doc", F.explode("ids").alias("clip_id")).groupBy("doc", "clip_id").agg(F.count("*").alias("n"))
    known = inventory.select("clip_id").distinct().withColumn("known", F.lit(True))
    faults = uses.join(known, "clip_id", "left").select("doc", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, _told("clip_twice", F.col("clip_id"))), F.when(F.col("known").isNull(), _told("unknown_clip", F.col("clip_id")))))).alias("fault"))
    faults = faults.groupBy("doc").agg(F.collect_list("fault").alias("faults"))
    per = _per_document(given, rules, missing=F.flatten(F.collect_list(missing)), total=F.sum("n")).join(faults, "doc", "left")
    low, high = profile.clips
    in_all = F.when(~F.col("total").between(low, high), _told("clips", F.col("total")))
    none = F.expr("cast(array() as array<string>)")
    early = _joined([_counted(per, profile)], F.col("missing"))
    late = _joined([in_all], F.concat("found", F.coalesce("faults", none), _banned(F.col("text"), words, phrases)))
    return per.select("doc", F.when(F.size(early) > 0, early).otherwise(late).alias("violations"))


def gates(segments: DataFrame, inventory: DataFrame, profile: Profile, words: tuple[str, ...] = T.BANNED_WORDS, phrases: tuple[str, ...] = T.BANNED_PHRASES) -> DataFrame:
    """(doc, total_words, floor, structure, script): the violations of all gates over the repaired texts, each joined by commas."""
    repaired = repair(segments, profile)
    floor = floor_gate(repaired, profile).select("doc", "total_words", F.array_join("violations", ",").alias("floor"))
    structure = structural_gate(repaired, inventory, profile, words, phrases).select("doc", F.array_join("violations", ",").alias("structure"))
    script = script_only_gate(repaired, profile, words, phrases).select("doc", F.array_join("violations", ",").alias("script"))
    return floor.join(structure, "doc").join(script, "doc")
