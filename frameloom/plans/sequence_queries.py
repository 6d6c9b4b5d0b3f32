"""Queries over ledgers as intervals and over narrations as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.text import word_count
from frameloom.operators import assignment as A
from frameloom.operators import beats as B
from frameloom.operators import relational as R
from frameloom.operators import selection as Q
from frameloom.operators import sequences as S
from frameloom.sources.media import CTES, catalog, ledger, segments, words


def _with(sql: str, *names: str) -> str:
    return "with " + ", ".join(CTES[n] if n in CTES else n for n in names) + " " + sql


USED = """used as (select asset_id, least(s, 60.0) as start, least(s + len, 60.0) as "end", src as source from (select asset_id, greatest(try_cast(trim_start_sec as double), 0.0) s, display_end_sec - display_start_sec len, source_duration_sec src from ledger
  where try_cast(trim_start_sec as double) is not null) where len > 0 and least(s + len, 60.0) > least(s, 60.0))"""
MERGED = """merged as (select asset_id, min(start) as start, max("end") as "end" from (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by asset_id order by start, "end" rows unbounded preceding) island from (
  select *, max("end") over (partition by asset_id order by start, "end" rows between unbounded preceding and 1 preceding) reach from used)) group by asset_id, island)"""


SOURCES = "sources as (select asset_id, duration_sec source from catalog)"
FREE = """free_ as (select asset_id, f as start, t as "end" from (select asset_id, coalesce(max(z) over (partition by asset_id order by a, z rows between unbounded preceding and 1 preceding), 0.0) f, a t from (
  select m.asset_id, least(greatest(start, 0.0), source) a, least(greatest("end", 0.0), source) z from merged m join sources s on m.asset_id = s.asset_id union all select asset_id, source, source from sources)) where t > f)"""


def merged_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_windows(S.used_windows(ledger(spark, d)))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("asset_id", F.col("duration_sec").alias("source"))


def used_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.used_windows(ledger(spark, d))


def merge_windows(spark: SparkSession, d: str) -> DataFrame:
    return merged_windows(spark, d)


def free_windows(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every clip, used or not, in gaps of two seconds or more."""
    return S.free_windows(merged_windows(spark, d), _sources(spark, d), 2.0)


def least_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Where six seconds of each clip that is long enough overlap least with what was shown of it."""
    asked = _sources(spark, d).where("source >= 6").withColumn("span", F.lit(6.0))
    return S.least_overlap(asked, merged_windows(spark, d), ["asset_id"]).select("asset_id", "trim", F.round("overlap", 6).alias("overlap"))


def bridge_reserve(spark: SparkSession, d: str) -> DataFrame:
    shown = merged_windows(spark, d).groupBy("asset_id").agg(F.sum(F.col("end") - F.col("start")).alias("shown"))
    fresh = F.greatest(F.lit(0.0), F.col("duration_sec") - F.coalesce("shown", F.lit(0.0)))
    clips = catalog(spark, d).where("status = 'active' and duration_sec > 0").join(shown, "asset_id", "left").withColumn("fresh", fresh)
    return clips.orderBy("usage_count", F.desc("duration_sec"), F.desc("fresh"), "clip_id").limit(16).select("asset_id", "usage_count", "duration_sec", "fresh")


def phase_trim(spark: SparkSession, d: str) -> DataFrame:
    """The trim of 2.5 seconds in each free window by the motion phase; unknown phases start where the window does."""
    phase = F.element_at(F.array(*map(F.lit, ("early", "middle", "climax", "late peak", ""))), (F.pmod(F.floor("start"), F.lit(5)) + 1).cast("int"))
    gaps = S.free_windows(merged_windows(spark, d), _sources(spark, d), 2.0).withColumn("phase", phase)
    return gaps.select("asset_id", "start", "end", S.phase_trim(F.col("phase"), F.col("start"), F.col("end"), F.lit(2.5)).alias("trim"))


def _starts(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).groupBy("doc", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("word_count"))
    return w


STARTS = 'starts as (select doc, segment, min(start) as start, max("end") as "end", count(*) word_count from words group by 1, 2)'


def display_spans(spark: SparkSession, d: str) -> DataFrame:
    ends = F.max("end").over(Window.partitionBy("doc"))
    spans = S.display_spans(_starts(spark, d).withColumn("doc_end", ends), F.col("doc_end"))
    return spans.select("doc", "segment", F.round("span", 4).alias("span"))


def word_ranges(spark: SparkSession, d: str) -> DataFrame:
    return S.word_ranges(_starts(spark, d), F.col("word_count")).select("doc", "segment", "first_word", "last_word")


def pause_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.pause_batches(segments(spark, d)).select("doc", "segment", F.col("batch").cast("long").alias("batch"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    batched = S.pause_batches(segments(spark, d)).select("doc", "segment", "batch")
    return _starts(spark, d).join(batched, ["doc", "segment"]).groupBy("doc", "batch").agg(F.sum(F.round((F.col("end") - F.col("start")) * 100).cast("long")).alias("ticks"), F.sum("word_count").alias("n_words"))


def back_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Each batch's words start after the batches before and their silences of half a second."""
    out = S.running_offsets(_batches(spark, d), (F.col("ticks") + 50) / 100)
    return out.select("doc", F.col("batch").cast("long").alias("batch"), "n_words", F.round("offset", 4).alias("offset"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    s = S.display_spans(_starts(spark, d), F.col("start") + 2.0)
    return s.select("doc", "segment", "start", F.round(F.col("start") + F.col("span"), 4).alias("display_end"))


def next_valid_span(spark: SparkSession, d: str) -> DataFrame:
    s = S.next_valid(_starts(spark, d), F.col("word_count") % 3 != 0)
    return s.select("doc", "segment", "start", "next_start")


def monotonic_repair(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.pmod(F.col("segment") * 7 + F.col("doc"), F.lit(5)) * 1000).cast("long")
    return S.monotonic_repair(segments(spark, d).withColumn("ms", ms), "ms", 1).select("doc", "segment", "ms", "repaired")


def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.pmod(F.col("segment") * 7 + F.col("doc"), F.lit(5)) * 1000).cast("long")
    before = F.lag("ms").over(Window.partitionBy("doc").orderBy("segment"))
    return segments(spark, d).withColumn("ms", ms).withColumn("before", before).where("ms <= before").select("doc", "segment", "ms", "before")


def caption_visibility(spark: SparkSession, d: str) -> DataFrame:
    return S.caption_visibility(_starts(spark, d), 0.3).select("doc", "segment", F.round("visible_until", 4).alias("visible_until"))


def pause_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.pause_windows(words(spark, d), 0.3).select("doc", "word_idx", F.round("gap", 4).alias("gap"))


def timing_contract(spark: SparkSession, d: str) -> DataFrame:
    """Words whose times break the contract, some planted: blank, start below 0, end not after start, end over half a second past the narration."""
    k, duration = F.col("word_idx"), F.max("end").over(Window.partitionBy("doc"))
    w = words(spark, d).withColumn("duration", duration).withColumn("word", F.when(k % 37 == 0, "  ").otherwise(F.col("word")))
    w = w.withColumn("end", F.when(k % 41 == 0, F.col("start")).when(k % 29 == 0, F.col("duration") + 0.75).when(k % 31 == 0, F.col("duration") + 0.5).otherwise(F.col("end"))).withColumn("start", F.when(k % 43 == 1, -0.25).otherwise(F.col("start")))
    bad = w.withColumn("violations", R.violations(end=F.col("end") <= F.col("start"), late=F.col("end") > F.col("duration") + 0.5, start=F.col("start") < 0, word=F.trim("word") == ""))
    return bad.where(F.size("violations") > 0).select("doc", "word_idx", F.array_join("violations", ",").alias("violations"))


def props_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose clips don't start one after the other, or whose timed words differ from those of the texts by more than 5 and a tenth."""
    ms = (F.col("segment") * 1000 - F.when((F.col("doc") % 6 == 0) & (F.col("segment") == 2), 1000).otherwise(0)).cast("long")
    before = F.lag("ms").over(Window.partitionBy("doc").orderBy("segment"))
    clips = segments(spark, d).withColumn("ms", ms).withColumn("before", before).groupBy("doc").agg(F.count_if(F.col("ms") <= F.col("before")).alias("out_of_order"), F.sum(word_count(F.col("text"))).alias("total"))
    timed = words(spark, d).where((F.col("doc") % 4 != 0) | (F.col("word_idx") % 7 != 0)).groupBy("doc").agg(F.count("*").alias("timed"))
    rows = clips.join(timed, "doc", "left").withColumn("timed", F.coalesce("timed", F.lit(0)))
    apart = F.abs(F.col("total") - F.col("timed")) > F.greatest(F.lit(5), F.floor(F.col("total") * 0.1))
    return rows.select("doc", "out_of_order", "total", "timed", apart.alias("words_differ")).where((F.col("out_of_order") > 0) | F.col("words_differ"))


def segment_spans(spark: SparkSession, d: str) -> DataFrame:
    """Segments' spans from the timed words of their batches; every third document declares a word too many, so its batches are split by characters."""
    batch = S.pause_batches(segments(spark, d)).select("doc", "segment", F.col("batch").cast("long").alias("batch"))
    timed = words(spark, d).join(batch, ["doc", "segment"])
    first = F.min("start").over(Window.partitionBy("doc", "batch"))
    timed = timed.withColumn("t0", first).select("doc", "batch", "word_idx", (F.col("start") - F.col("t0")).alias("start"), (F.col("end") - F.col("t0")).alias("end"))
    durations = timed.groupBy("doc", "batch").agg(F.max("end").alias("duration")).withColumn("silence", F.lit(0.5))
    declared = segments(spark, d).join(batch, ["doc", "segment"]).select("doc", "batch", "segment", "text", (word_count(F.col("text")) + F.when((F.col("doc") % 3 == 0) & (F.col("segment") == 0), 1).otherwise(0)).alias("word_count"))
    return S.allocate_words(timed, declared, durations).select("doc", "segment", "start", "end", "duration", F.col("word_count").cast("long").alias("word_count"))


def rate_metric(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_metric(words(spark, d)).select("doc", "n_words", F.round("wpm", 4).alias("wpm"))


def coverage_metric(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).groupBy("doc").agg(F.round((F.max("end") - F.min("start")) / 65.0, 6).alias("coverage"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def beat_text(spark: SparkSession, d: str) -> DataFrame:
    ranges = S.word_ranges(_starts(spark, d), F.col("word_count")).select("doc", "segment", "first_word", "last_word")
    w = words(spark, d).select("doc", "word_idx", "word").join(ranges, "doc").where(F.col("word_idx").between(F.col("first_word"), F.col("last_word")))
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "word")))
    return w.groupBy("doc", "segment").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("beat_text"))


def pause_budget(spark: SparkSession, d: str) -> DataFrame:
    counted = segments(spark, d).withColumn("word_count", word_count(F.col("text")))
    return S.pause_budget(counted, 400.0, 148.0, 3000).select("doc", "segment", "pause_ms")


def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    counted = segments(spark, d).withColumn("word_count", word_count(F.col("text")))
    return S.largest_remainder(counted, F.col("word_count"), 40, "doc", "segment").select("doc", "segment", "share")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return S.round_robin(segments(spark, d), ["ada", "bea", "cai"], "doc", ["segment"]).select("doc", "segment", F.col("choice").alias("voice"))


def rotating_motifs(spark: SparkSession, d: str) -> DataFrame:
    motifs = catalog(spark, d).where("category <> ''").select("category", F.lower("scene_description").alias("motif")).distinct()
    return S.rotate(motifs, 3, 5, "category", ["motif"]).select("category", "motif", F.col("place").cast("long").alias("place"))


def stratified_alloc(spark: SparkSession, d: str) -> DataFrame:
    sizes = catalog(spark, d).where("category <> ''").groupBy("category").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return S.capped_shares(sizes, "n", 200, "all", "category").select("category", "n", "share")


#: Categories in the order in which first clips are dealt, and the cards of hooks.
PRIORITY, HOOKS = ["PROMO", "LARGE", "ECONOMY"], ["hook_a", "hook_b", "hook_c"]


def variant_plan(spark: SparkSession, d: str) -> DataFrame:
    """Per place up to seven variants: the first clip from the categories in their order, then from the others by id, dealt round where there are few; hooks in turn from the place's seed."""
    first = F.split("category", " ")[0]
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), first), F.lit(0)), F.lit(len(PRIORITY) + 1))
    clips = catalog(spark, d).where("status = 'active'").select("poi_id", "clip_id", place.alias("priority"))
    ranked = clips.withColumn("turn", F.row_number().over(Window.partitionBy("poi_id").orderBy("priority", "clip_id"))).withColumn("size", F.count("*").over(Window.partitionBy("poi_id")))
    number = F.regexp_extract("poi_id", "([0-9]+)", 1).cast("int")
    wanted = ranked.select("poi_id", "size").distinct().withColumn("seed", number).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("seed") % 7)))
    dealt = wanted.withColumn("turn", (F.col("i") % F.least(F.col("seed") % 7 + 1, F.col("size")) + 1).cast("int")).join(ranked.select("poi_id", "turn", "clip_id"), ["poi_id", "turn"])
    return dealt.select("poi_id", F.col("i").cast("long").alias("variant"), "clip_id", F.get(F.array(*map(F.lit, HOOKS)), ((F.col("seed") + F.col("i")) % len(HOOKS)).cast("int")).alias("hook"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A drawn sample of 200 clips, each category by its share, drawn by the ids' hash."""
    clips = catalog(spark, d).where("category <> ''").select("category", "clip_id")
    return Q.stratified_sample(clips, "category", "clip_id", 200, 50, 7).select("category", "clip_id", F.col("turn").cast("long").alias("turn"))


def spoken_words(spark: SparkSession, d: str) -> DataFrame:
    """Words from characters that hold tags, nested ones and loose brackets too."""
    k = F.col("doc") + F.col("segment")
    tagged = F.concat(F.when(k % 3 == 0, "a<break <x> y>b <<p>> ").when(k % 3 == 1, "> <t>").otherwise(""), F.col("text"), F.when(k % 5 == 0, " c<never closed").otherwise(""))
    chars = segments(spark, d).select("doc", "segment", F.posexplode(F.split(tagged, "")).alias("pos", "c")).where("c <> ''")
    return S.spoken_words(chars, ["doc", "segment"]).select("doc", "segment", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"), "word")


def chars_to_words(spark: SparkSession, d: str) -> DataFrame:
    """Characters grouped to words: white space starts a new one."""
    chars = segments(spark, d).select("doc", "segment", F.posexplode(F.split("text", "")).alias("pos", "c")).where("c <> ''")
    order = Window.partitionBy("doc", "segment").orderBy("pos")
    blank = F.col("c").isin(" ", "\n")
    island = F.sum(F.when(blank, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = chars.withColumn("word_no", island).where(~blank)
    return parts.groupBy("doc", "segment", "word_no").agg(F.count("*").alias("n_chars"), F.min("pos").cast("long").alias("first_pos")).withColumn("word_no", F.col("word_no").cast("long"))


def drop_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, ninth decile by the exclusive rule (the largest of ten values or fewer) and the largest, by rounds of histograms."""
    rows = ledger(spark, d).select("usage_role", "value")
    found = Q.quantiles(rows, "usage_role", "value", {"median": (1, 2), "decile": (9, 10)})
    largest = rows.groupBy("usage_role").agg(F.max("value").alias("largest")).withColumnRenamed("usage_role", "role")
    joined = found.join(largest, F.col("usage_role").eqNullSafe(F.col("role")))
    return joined.select("usage_role", F.round("median", 6).alias("median"), F.round(F.when(F.col("n") > 10, F.col("decile")).otherwise(F.col("largest")), 6).alias("p90"), "largest")


def beats(spark: SparkSession, d: str) -> DataFrame:
    return B.beats(words(spark, d))


def beat_budget(spark: SparkSession, d: str) -> DataFrame:
    return B.beats(words(spark, d), budget=12)


def caption_phrases(spark: SparkSession, d: str) -> DataFrame:
    return B.caption_phrases(words(spark, d))


def bridge_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bridges from the catalog: a document shows clips of its place, a second in each trimmed, and lacks footage up to nine seconds a segment."""
    clips = catalog(spark, d).where("status = 'active'").select("poi_id", "clip_id", F.col("duration_sec").alias("duration"))
    clips = clips.withColumn("place", F.regexp_extract("poi_id", "([0-9]+)", 1).cast("long") % 5)
    listed = clips.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("clip_id")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("place")))
    spans = _starts(spark, d).withColumn("place", F.col("doc") % 5).join(listed.select("place", "size").distinct(), "place").withColumn("n", ((F.col("doc") * 3 + F.col("segment")) % F.col("size")).cast("int"))
    entries = spans.join(listed.select("place", "n", "clip_id", F.col("duration").alias("source")), ["place", "n"])
    entries = entries.select("doc", "place", "segment", "clip_id", "start", "source", F.lit(1.0).alias("trim"), F.least(F.col("end"), F.col("start") + 9).alias("display_end"))
    return A.bridge_fill(entries, clips.select("place", "clip_id", "duration")).select("doc", "segment", "clip", F.round("start", 4).alias("start"), F.round("used", 4).alias("used"))


#: The fold of bridges, a step at a time: a clip is taken, or the next gap is looked at.
BRIDGES = _with("""select doc, segment, clip, round(since, 4) as start, round(used, 4) used from step where emits""", "words", STARTS, "catalog",
  "pool as (select *, row_number() over (partition by place order by clip_id) - 1 n, count(*) over (partition by place) size from (select clip_id, duration_sec dur, regexp_extract(poi_id, '([0-9]+)', 1)::bigint % 5 place from catalog where status = 'active'))",
  """entries as (select s.doc, s.segment, s.doc % 5 place, clip_id, start + greatest(dur - 1.0, 0.0) cursor, least("end", start + 9) z, row_number() over (partition by doc order by segment) g from starts s join pool p on p.place = s.doc % 5 and p.n = (s.doc * 3 + s.segment) % p.size)""",
  "queue as (select d.doc, p.clip_id, p.dur, row_number() over (partition by d.doc order by p.dur desc, p.clip_id) q from (select distinct doc, place from entries) d join pool p using (place) where not exists(select 1 from entries e where e.doc = d.doc and e.clip_id = p.clip_id))",
  """step as (select doc, 1::bigint g, 1::bigint q, null::bigint segment, null::varchar clip, null::double since, null::double used, false emits, null::double cursor from (select distinct doc from entries)
  union all select s.doc, case when e.z - coalesce(s.cursor, e.cursor) > 0.05 and u.clip_id is not null then s.g else s.g + 1 end, case when e.z - coalesce(s.cursor, e.cursor) > 0.05 and u.clip_id is not null then s.q + 1 else s.q end, e.segment, u.clip_id,
    coalesce(s.cursor, e.cursor), case when u.clip_id is null then e.z - coalesce(s.cursor, e.cursor) else least(e.z - coalesce(s.cursor, e.cursor), u.dur) end, e.z - coalesce(s.cursor, e.cursor) > 0.05,
    case when e.z - coalesce(s.cursor, e.cursor) > 0.05 and u.clip_id is not null then coalesce(s.cursor, e.cursor) + least(e.z - coalesce(s.cursor, e.cursor), u.dur) end
  from step s join entries e on e.doc = s.doc and e.g = s.g left join queue u on u.doc = s.doc and u.q = s.q)""").replace("with ", "with recursive ", 1)

CATALOGUE = {
    "used_windows": (used_windows, _with('select asset_id, start, "end", source from used', "ledger", USED)),
    "merge_windows": (merge_windows, _with('select asset_id, start, "end" from merged', "ledger", USED, MERGED)),
    "free_windows": (free_windows, _with('select asset_id, start, "end" from free_ where "end" - start >= 2.0', "catalog", "ledger", USED, MERGED, SOURCES, FREE)),
    "least_overlap": (least_overlap, _with("""select asset_id, arg_min(t, (o, t)) trim, round(min(o), 6) overlap from (select asset_id, t, sum(coalesce(greatest(least(t + 6.0, "end") - greatest(t, start), 0.0), 0.0)) o from (
  select distinct asset_id, unnest([0.0, least(greatest("end", 0.0), source - 6.0), least(greatest(start - 6.0, 0.0), source - 6.0)]) t from sources join merged using (asset_id) where source >= 6
  union select asset_id, 0.0 from sources where source >= 6) left join merged using (asset_id) group by 1, 2) group by 1""", "catalog", "ledger", USED, MERGED, SOURCES)),
    "bridge_reserve": (bridge_reserve, _with("""select asset_id, usage_count, duration_sec, greatest(0.0, duration_sec - coalesce(shown, 0.0)) fresh from catalog left join (select asset_id, sum("end" - start) shown from merged group by 1) using (asset_id)
  where status = 'active' and duration_sec > 0 order by usage_count, duration_sec desc, fresh desc, clip_id limit 16""", "catalog", "ledger", USED, MERGED)),
    "phase_trim": (phase_trim, _with("""select asset_id, f as start, t as "end", case floor(f)::int % 5 when 1 then f + (t - f - 2.5) / 2 when 2 then f + (t - f - 2.5) when 3 then f + (t - f - 2.5) else f end * (t - f > 2.5)::int + f * (t - f <= 2.5)::int trim
  from (select asset_id, start f, "end" t from free_) where t - f >= 2.0""", "catalog", "ledger", USED, MERGED, SOURCES, FREE)),
    "display_spans": (display_spans, _with('select doc, segment, round(greatest(coalesce(lead(start) over (partition by doc order by segment), max("end") over (partition by doc)) - start, 0.0), 4) span from starts', "words", STARTS)),
    "word_ranges": (word_ranges, _with("select doc, segment, (sum(word_count) over w - word_count)::bigint first_word, (sum(word_count) over w - 1)::bigint last_word from starts window w as (partition by doc order by segment)", "words", STARTS)),
    "pause_batches": (pause_batches, _with("select doc, segment, (sum((coalesce(b, 0) >= 2)::int) over (partition by doc order by segment))::bigint batch from (select *, lag(pause_weight) over (partition by doc order by segment) b from segments)", "segments")),
    "back_allocate": (back_allocate, _with("""select doc, batch, n_words, round(coalesce(sum((ticks + 50) / 100.0::double) over (partition by doc order by batch rows between unbounded preceding and 1 preceding), 0.0), 4) as "offset" from (
  select doc, batch, sum(round(("end" - start) * 100)::bigint)::bigint ticks, sum(word_count)::bigint n_words from starts join (
    select doc, segment, (sum((coalesce(b, 0) >= 2)::int) over (partition by doc order by segment))::bigint batch from (select *, lag(pause_weight) over (partition by doc order by segment) b from segments)) using (doc, segment) group by 1, 2)""", "words", STARTS, "segments")),
    "timeline": (timeline, _with("select doc, segment, start, round(start + greatest(coalesce(lead(start) over (partition by doc order by segment), start + 2.0) - start, 0.0), 4) display_end from starts", "words", STARTS)),
    "next_valid_span": (next_valid_span, _with("select doc, segment, start, (select min(b.start) from starts b where b.doc = a.doc and b.segment > a.segment and b.word_count % 3 <> 0) next_start from starts a", "words", STARTS)),
    "monotonic_repair": (monotonic_repair, _with("""select doc, segment, ms, (max(ms - n) over (partition by doc order by segment rows unbounded preceding) + n)::bigint repaired from (
  select doc, segment, ((segment * 7 + doc) % 5 * 1000)::bigint ms, row_number() over (partition by doc order by segment) n from segments)""", "segments")),
    "monotonic_check": (monotonic_check, _with("select * from (select doc, segment, ms, lag(ms) over (partition by doc order by segment) as \"before\" from (select doc, segment, ((segment * 7 + doc) % 5 * 1000)::bigint ms from segments)) where ms <= \"before\"", "segments")),
    "caption_visibility": (caption_visibility, _with('select doc, segment, round(least("end" + 0.3, lead(start) over (partition by doc order by segment)), 4) visible_until from starts', "words", STARTS)),
    "pause_windows": (pause_windows, _with('select doc, word_idx, round(gap, 4) gap from (select doc, word_idx, lead(start) over (partition by doc order by word_idx) - "end" gap from words) where gap >= 0.3', "words")),
    "timing_contract": (timing_contract, _with("""select * from (select doc, word_idx, concat_ws(',', case when e <= s then 'end' end, case when e > d + 0.5 then 'late' end, case when s < 0 then 'start' end, case when word_idx % 37 = 0 or trim(word) = '' then 'word' end) violations
  from (select *, case when word_idx % 41 = 0 then start when word_idx % 29 = 0 then d + 0.75 when word_idx % 31 = 0 then d + 0.5 else "end" end e, case when word_idx % 43 = 1 then -0.25 else start end s from (select *, max("end") over (partition by doc) d from words))) where violations <> ''""", "words")),
    "props_check": (props_check, _with("""select doc, out_of_order, total, timed, words_differ from (select *, abs(total - timed) > greatest(5, floor(total * 0.1)) words_differ from (
  select doc, count_if(ms <= prev)::bigint out_of_order, sum(n)::bigint total from (select *, lag(ms) over (partition by doc order by segment) prev from (select doc, segment, segment * 1000 - case when doc % 6 = 0 and segment = 2 then 1000 else 0 end ms,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) n from segments)) group by 1) join (select doc, count(*) timed from words where doc % 4 <> 0 or word_idx % 7 <> 0 group by 1) using (doc)) where out_of_order > 0 or words_differ""", "segments", "words")),
    "segment_spans": (segment_spans, _with("""select doc, segment, round(s, 3) as start, round(e, 3) as "end", round(round(e, 3) - round(s, 3), 3) duration, (z - a)::bigint word_count from (
  select g.*, case when z > a then round(x.start - x.t0 + o, 3) else o end s, case when z > a then round(y."end" - y.t0 + o, 3) else o end e from (
    select *, coalesce(lag(z) over (partition by doc, batch order by segment), 0) a from (select *, case when declared = n then upto when final then n else least(round_even(n * chars_to / chars_all::double, 0)::bigint, n) end z from (
      select doc, segment, batch, n, o, sum(wc) over (partition by doc, batch) declared, sum(wc) over w upto, sum(ch) over w chars_to, sum(ch) over (partition by doc, batch) chars_all, lead(segment) over w is null as final from (
        select doc, segment, batch, greatest(length(trim(text)), 1) ch, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + (doc % 3 = 0 and segment = 0)::int wc from segments join batch_of using (doc, segment)) join clocks using (doc, batch) window w as (partition by doc, batch order by segment)))) g
  left join placed x on x.doc = g.doc and x.batch = g.batch and x.p = g.a + 1 and g.z > g.a left join placed y on y.doc = g.doc and y.batch = g.batch and y.p = g.z and g.z > g.a)""", "segments", "words",
  """batch_of as (select doc, segment, (sum((coalesce(b, 0) >= 2)::int) over (partition by doc order by segment))::bigint batch from (select *, lag(pause_weight) over (partition by doc order by segment) b from segments))""",
  """placed as (select w.*, batch, min(start) over (partition by doc, batch) t0, row_number() over (partition by doc, batch order by word_idx) p from words w join batch_of using (doc, segment))""",
  """clocks as (select *, coalesce(sum(dur + 0.5) over (partition by doc order by batch rows between unbounded preceding and 1 preceding), 0.0) o from (select doc, batch, count(*) n, max("end" - t0) dur from placed group by 1, 2))""")),
    "rate_metric": (rate_metric, _with('select doc, count(*) n_words, round(case when count(*) >= 2 and max("end") > min(start) then count(*) / (max("end") - min(start)) * 60 end, 4) wpm from words group by 1', "words")),
    "coverage_metric": (coverage_metric, _with('select doc, round((max("end") - min(start)) / 65.0, 6) coverage, min(start) first_start, max("end") last_end from words group by 1', "words")),
    "beat_text": (beat_text, _with("""select w.doc, r.segment, string_agg(word, ' ' order by word_idx) beat_text from words w join (select doc, segment, sum(word_count) over w - word_count f, sum(word_count) over w - 1 l from starts window w as (partition by doc order by segment)) r
  on w.doc = r.doc and word_idx between f and l group by 1, 2""", "words", STARTS)),
    "pause_budget": (pause_budget, _with("""select doc, segment, (case when need > 0 and w > 0 then least(round_even(round_even(round_even(need * 1000 / 1.1, 0) * w / sw, 0) * 1.1, 0), 3000.0) else 0 end)::bigint pause_ms from (
  select *, sum(w) over (partition by doc) sw from (select doc, segment, case when pause_weight >= 2 and segment <> max(segment) over (partition by doc) then pause_weight else 0 end w, 400.0::double * 0.9 - sum(wc) over (partition by doc) / 148.0::double * 60 need
    from (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) wc from segments)))""", "segments")),
    "largest_remainder": (largest_remainder, _with("""select doc, segment, (1 + fl + (turn <= lft)::int)::bigint share from (select *, row_number() over (partition by doc order by ex - fl desc, segment) turn from (
  select *, floor(ex) fl, spare - sum(floor(ex)) over (partition by doc) lft from (select doc, segment, greatest(40 - count(*) over (partition by doc), 0) spare,
    greatest(40 - count(*) over (partition by doc), 0) * wc / sum(wc) over (partition by doc) ex from (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) wc from segments))))""", "segments")),
    "round_robin": (round_robin, _with("select doc, segment, ['ada', 'bea', 'cai'][(row_number() over (partition by doc order by segment) - 1) % 3 + 1] voice from segments", "segments")),
    "rotating_motifs": (rotating_motifs, _with("""select category, motif, place from (select *, ((n - 1 - 3) % size + size) % size place from (select *, row_number() over (partition by category order by motif) n, count(*) over (partition by category) size from (
  select distinct category, lower(scene_description) motif from catalog where category <> ''))) where place < 5""", "catalog")),
    "stratified_alloc": (stratified_alloc, _with("""select category, n, (share + case when room2 = 1 and turn2 <= left2 then 1 else 0 end)::bigint share from (
  select *, sum(room2) over (order by ex - floor(ex) desc, category rows unbounded preceding) turn2 from (select *, target - sum(share) over () left2, (share < n)::int room2 from (
  select category, n, ex, target, share + case when room = 1 and turn <= lft then 1 else 0 end share from (select *, sum(room) over (order by ex - floor(ex) desc, category rows unbounded preceding) turn from (
  select *, target - sum(share) over () lft, (share < n)::int room from (select *, greatest(1, least(n, floor(ex)::bigint)) share from (select *, least(200, sum(n) over ()) target, least(200, sum(n) over ()) * n / sum(n) over () ex from (
    select category, count(*) n from catalog where category <> '' group by 1))))))))""", "catalog")),
    "variant_plan": (variant_plan, _with("""select poi_id, i::bigint variant, clip_id, ['hook_a', 'hook_b', 'hook_c'][(seed + i) % 3 + 1] hook from (select *, unnest(range(0, seed % 7 + 1)) i from (select poi_id, regexp_extract(poi_id, '([0-9]+)', 1)::int seed, count(*) size from ranked group by 1, 2))
  join ranked using (poi_id) where turn = i % least(seed % 7 + 1, size) + 1""", "catalog", "ranked as (select poi_id, clip_id, row_number() over (partition by poi_id order by coalesce(list_position(['PROMO', 'LARGE', 'ECONOMY'], string_split(category, ' ')[1]), 4), clip_id) turn from catalog where status = 'active')")),
    "spoken_words": (spoken_words, None),
    "chars_to_words": (chars_to_words, _with("""select doc, segment, word_no::bigint word_no, count(*) n_chars, min(pos) first_pos from (select *, sum((c in (' ', chr(10)))::int) over (partition by doc, segment order by pos) word_no from (
  select doc, segment, unnest(string_split(text, '')) c, generate_subscripts(string_split(text, ''), 1) - 1 pos from segments)) where c not in (' ', chr(10)) group by 1, 2, 3""", "segments")),
    "drop_quantiles": (drop_quantiles, _with("""select usage_role, round(case when n % 2 = 1 then v[(n + 1) // 2] else (v[n // 2] + v[n // 2 + 1]) / 2 end, 6) median, round(case when n > 10 then (v[j] * (10 - (9 * (n + 1) - 10 * j)) + v[j + 1] * (9 * (n + 1) - 10 * j)) / 10 else v[n] end, 6) p90, v[n] largest
  from (select *, greatest(1, least(9 * (n + 1) // 10, n - 1)) j from (select usage_role, list_sort(list(value)) v, count(*) n from ledger group by 1))""", "ledger")),
    "beats": (beats, None),
    "beat_budget": (beat_budget, None),
    "caption_phrases": (caption_phrases, None),
    "bridge_fill": (bridge_fill, BRIDGES),
}
_SHARES = CATALOGUE["stratified_alloc"][1].removeprefix(f"with {CTES['catalog']} ")
CATALOGUE["stratified_sample"] = (stratified_sample, _with("select category, clip_id, turn from (select category, clip_id, share, row_number() over (partition by category order by md5('7:' || category || ':' || clip_id), clip_id) turn from catalog join shares using (category)) where turn <= share", "catalog", f"shares as ({_SHARES})"))
