"""Queries over narration and description texts, and over content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import text as T
from frameloom.functions.text import py_zfill
from frameloom.operators import gates as G
from frameloom.sources.media import CTES, catalog, segments, table

#: Terms that these invented texts have; the defaults never occur in them.
WORDS, PHRASES = (*T.BANNED_WORDS, "thon"), (*T.BANNED_PHRASES, "of the")
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each English document with the benchmark item of its number."""
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.col("text").alias("narration"), F.pmod("doc_id", F.lit(40)).alias("item_id"))
    joined = docs.join(table(spark, d, "benchmark"), "item_id")
    return joined.select("doc_id", "item_id", F.round(T.overlap_score(F.col("text"), F.col("narration")), 6).alias("score"))


def segment_queries(spark: SparkSession, d: str) -> DataFrame:
    sentence = F.explode(F.split("text", "\\n")).alias("query")
    return segments(spark, d).where("role = 'user'").select("doc", "segment", sentence).where(F.trim("query") != "")


def norm_dedupe(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.md5(T.norm_key(F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def banned_terms(spark: SparkSession, d: str) -> DataFrame:
    found = segments(spark, d).select("doc", "segment", F.array_join(T.banned_terms(F.col("text"), WORDS, PHRASES), ",").alias("banned"))
    return found.where("banned <> ''")


def opener_strip(spark: SparkSession, d: str) -> DataFrame:
    opened = F.concat(F.when(F.pmod("doc", F.lit(3)) == 0, "Imagine ").when(F.pmod("doc", F.lit(3)) == 1, "Discover, ").otherwise(""), F.lower("text"))
    return segments(spark, d).select("doc", "segment", T.strip_opener(opened).alias("text"))


def sentence_trim(spark: SparkSession, d: str) -> DataFrame:
    one_line = F.trim(F.regexp_replace("text", "\\n", " "))
    return T.trim_overflow(segments(spark, d).withColumn("text", one_line), 100, 140)


#: What the invented scripts are held against.
PROFILE = G.Profile(segments=4, words=(60, 330), segment_words=(8, 90), clips=(4, 11))


def _scripts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Segments with openers, missing texts and clips, clips of the older form, used twice or unknown; and the clips there are."""
    k = F.col("doc") + F.col("segment")
    text = F.regexp_replace("text", "\\n", " ")
    opened = F.when(k % 13 == 0, None).when(k % 3 == 0, F.concat(F.lit("Imagine, "), F.lower(text))).otherwise(text)
    count = F.when(F.col("doc") % 4 == 0, 2).otherwise(k % 6)
    ids = F.transform(F.sequence(F.lit(1), count), lambda i: py_zfill((F.col("doc") * 31 + F.col("segment") * 7 + i * 13) % 230, 4))
    clips = F.when((k % 7 == 0) | (k % 11 == 0), None).when(count > 0, ids).otherwise(F.expr("cast(array() as array<string>)"))
    one = F.when((k % 7 == 0) & (k % 11 != 0), py_zfill(F.col("doc") % 210, 4))
    scripts = segments(spark, d).select("doc", "segment", opened.alias("text"), F.nullif(F.col("pause_weight"), F.lit(0)).alias("pause_weight"), clips.alias("clips"), one.alias("clip_id"))
    return scripts, catalog(spark, d).where("vec_id <= 200").select("clip_id")


def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    return G.repair(_scripts(spark, d)[0], PROFILE).select("doc", "segment", "text", "word_count")


def script_gates(spark: SparkSession, d: str) -> DataFrame:
    return G.gates(*_scripts(spark, d), PROFILE, WORDS, PHRASES)


def _priced(spark: SparkSession, d: str, price: F.Column) -> DataFrame:
    """Prices with commas, and percent signs with and without a space."""
    k = F.col("p_partkey")
    shown = F.when(k % 3 == 0, F.format_number(price * 10, 2)).when(k % 3 == 1, F.format_number(price * 100, 0)).otherwise(price.cast("string"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("only $"), shown, F.lit(" or "), "p_size", F.when(k % 2 == 0, " % off").when(k % 5 == 0, "\t%, $5.").otherwise("% off")).alias("text"))


def tts_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d, F.floor("p_retailprice").cast("decimal(12,2)")).select("p_partkey", T.speak_units(F.col("text")).alias("spoken"))


def spoken_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d, F.col("p_retailprice").cast("decimal(12,2)")).select("p_partkey", T.speak_numbers(T.speak_units(F.col("text"))).alias("spoken"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.slug(F.col("s_name")).alias("slug"), T.slug(F.concat(F.lit(" The "), "s_name", F.lit(" & Co. ")), "-").alias("hyphen_slug"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.embedding_text(F.when(F.col("p_partkey") % 9 == 0, None).otherwise(F.col("p_name")), F.col("p_type")).alias("text"))


def event_ids(spark: SparkSession, d: str) -> DataFrame:
    variant = F.pmod("l_linenumber", F.lit(3))
    occurrence = F.format_string("occ_%04d_%06d", variant, F.col("l_linenumber"))
    parts = (F.lit("v1"), F.concat(F.lit("man_"), "l_orderkey"), variant.cast("string"), occurrence, F.concat(F.lit("asset_"), "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.event_id(*parts).alias("event_id"))


def recipe_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    ordered = F.array_sort(F.collect_list("line"))
    hashes = F.transform(ordered, lambda x: F.concat(F.lit("sha256:"), F.sha2(x["l_partkey"].cast("string"), 256)))
    return lines.groupBy("l_orderkey").agg(T.fingerprint(hashes).alias("fingerprint"))


def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each document's first segment."""
    first = segments(spark, d).withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("segment"))).where("turn = 1")
    return first.select("doc", F.get(T.sentences(F.regexp_replace("text", "\\n", " ")), F.lit(0)).alias("sentence"))


WC = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
SCRIPTS = f"""with {CTES["catalog"]}, raw as (select conv_id doc, turn segment, conv_id + turn k, nullif((conv_id + turn) % 4, 0)::int pause_weight, replace(text, chr(10), ' ') t from conversations),
  given as (select doc, segment, pause_weight, case when k % 13 = 0 then null when k % 3 = 0 then upper(substr(lower(t), 1, 1)) || substr(lower(t), 2) else t end t,
    case when k % 7 = 0 or k % 11 = 0 then null else list_transform(range(1, case when doc % 4 = 0 then 3 else k % 6 + 1 end), lambda i: lpad(((doc * 31 + segment * 7 + i * 13) % 230)::varchar, 4, '0')) end clips,
    case when k % 7 = 0 and k % 11 <> 0 then lpad((doc % 210)::varchar, 4, '0') end clip_id from raw),
  c as (select *, row_number() over w place, lead(segment) over w is null as final, {WC.format("coalesce(t, '')")} n, sum({WC.format("coalesce(t, '')")}) over (partition by doc) total from given window w as (partition by doc order by segment)),
  heads as (select doc, segment, total - n rest, unnest(list_transform(range(1, len(parts) + 1), lambda j: array_to_string(parts[1:j], ' '))) head from (select *, string_split(regexp_replace(trim(coalesce(t, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) parts from c where final and total > {PROFILE.words[1]})),
  best as (select doc, segment, arg_max(head, length(head)) head from heads where rest + {WC.format("head")} between {PROFILE.words[0]} and {PROFILE.words[1]} group by 1, 2),
  repaired as (select * exclude (t, n, total, head), case when t is not null then coalesce(head, t) end as text, {WC.format("coalesce(case when t is not null then coalesce(head, t) end, '')")}::int word_count from c left join best using (doc, segment))"""
BANNED = "list_filter([" + ", ".join(f"case when contains(lower(whole), '{t}') then 'banned:{t}' end" if t in PHRASES else f"case when regexp_matches(lower(whole), '\\b{t}\\b') then 'banned:{t}' end" for t in sorted(WORDS + PHRASES)) + "], lambda x: x is not null)"
BAND, CLIPS = f"between {PROFILE.segment_words[0]} and {PROFILE.segment_words[1]}", f"between {PROFILE.clips[0]} and {PROFILE.clips[1]}"
GATES = f"""ids as (select *, coalesce(clips, case when clip_id is not null then [clip_id] end) ids from repaired),
  per as (select doc, count(*) n_segments, sum(word_count)::bigint total_words, string_agg(coalesce(text, ''), ' ' order by place) whole, sum(coalesce(len(ids), 0)) n_clips,
    list('words:' || place || ':' || word_count) filter (word_count not {BAND}) words_, list('no_text:' || place) filter (text is null) texts_, list('no_clips_field:' || place) filter (ids is null) fields_,
    list('no_clips:' || place) filter (coalesce(len(ids), 0) = 0) none_, list('many_clips:' || place || ':' || len(ids)) filter (len(ids) > 4) many_, list('pause_weight:' || place) filter (not final and pause_weight is null) pauses_ from ids group by 1),
  uses as (select doc, id, count(*) n from (select doc, unnest(ids) id from ids) group by 1, 2),
  faults as (select doc, list(f) faults from (select doc, 'clip_twice:' || id f from uses where n > 1 union all select doc, 'unknown_clip:' || id from uses where id not in (select clip_id from catalog where vec_id <= 200)) group by 1),
  named as (select *, case when n_segments <> {PROFILE.segments} then ['segments:' || n_segments] else [] end count_, {BANNED} banned_ from per left join faults using (doc)),
  arrays as (select *, list_concat(count_, coalesce(texts_, []), coalesce(fields_, [])) early, list_concat(case when n_clips not {CLIPS} then ['clips:' || n_clips] else [] end, coalesce(words_, []), coalesce(none_, []), coalesce(many_, []), coalesce(faults, []), banned_) late,
    list_concat(count_, coalesce(texts_, []), coalesce(words_, []), coalesce(pauses_, []), banned_) script_ from named)
  select doc, total_words, case when total_words < {PROFILE.words[0]} then 'below_floor:' || total_words else '' end as floor, array_to_string(list_sort(case when len(early) > 0 then early else late end), ',') structure, array_to_string(list_sort(script_), ',') script from arrays"""

CATALOGUE = {
    "match_quality": (match_quality, f"""select doc_id, item_id, round(coalesce(len(list_intersect(mine, theirs))::double / nullif(len(mine), 0), 0.0), 6) score from (
  select d.doc_id, b.item_id, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9'']+'), lambda x: x not in ({STOP}))) mine, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z0-9'']+'), lambda x: x not in ({STOP}))) theirs
  from documents d join benchmark b on b.item_id = d.doc_id % 40 where lang = 'en')"""),
    "segment_queries": (segment_queries, "select * from (select conv_id doc, turn segment, unnest(string_split(text, chr(10))) query from conversations where role = 'user') where trim(query) <> ''"),
    "norm_dedupe": (norm_dedupe, "select md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key, min(doc_id) first_id, count(*) n from documents group by 1"),
    "banned_terms": (banned_terms, "select * from (select conv_id doc, turn segment, concat_ws(',', " + ", ".join(f"case when contains(lower(text), '{t}') then '{t}' end" if t in PHRASES else f"case when regexp_matches(lower(text), '\\b{t}\\b') then '{t}' end" for t in sorted(WORDS + PHRASES)) + ") banned from conversations) where banned <> ''"),
    "opener_strip": (opener_strip, "select conv_id doc, turn segment, case when conv_id % 3 < 2 then upper(substr(t, 1, 1)) || substr(t, 2) else t end as text from (select *, lower(text) t from conversations)"),
    "sentence_trim": (sentence_trim, """with s as (select conv_id doc, turn segment, trim(replace(text, chr(10), ' ')) as text from conversations),
  c as (select *, sum(n) over (partition by doc) total, segment = max(segment) over (partition by doc) is_last from (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) n from s)),
  marked as (select *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) parts from c where is_last and total > 140),
  heads as (select doc, segment, total - n rest, unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[1:k], ' '))) head from marked),
  best as (select doc, segment, arg_max(head, length(head)) head from heads where rest + len(list_filter(regexp_split_to_array(head, '\\s+'), lambda x: x <> '')) between 100 and 140 group by 1, 2)
  select doc, segment, coalesce(head, text) as text from c left join best using (doc, segment)"""),
    "repaired_texts": (repaired_texts, f"{SCRIPTS} select doc, segment, text, word_count from repaired"),
    "script_gates": (script_gates, f"{SCRIPTS}, {GATES}"),
    "tts_normalize": (tts_normalize, """select p_partkey, 'only ' || case p_partkey % 3 when 0 then printf('%,d', floor(p_retailprice)::bigint * 10) || '.00' when 1 then printf('%,d', floor(p_retailprice)::bigint * 100) else floor(p_retailprice)::bigint || '.00' end || ' dollars or ' || p_size || ' percent'
  || case when p_partkey % 2 = 0 then ' off' when p_partkey % 5 = 0 then ', 5 dollars.' else ' off' end spoken from part"""),
    "spoken_numbers": (spoken_numbers, None),
    "slugs": (slugs, "select s_suppkey, lower(replace(s_name, '#', '')) slug, 'the-' || lower(replace(s_name, '#', '')) || '-co' hyphen_slug from supplier"),
    "embedding_texts": (embedding_texts, "select p_partkey, case when p_partkey % 9 = 0 then '' else trim(p_name) end || ' | ' || trim(p_type) as text from part"),
    "event_ids": (event_ids, "select l_orderkey, l_linenumber, 'sha256:' || sha256('v1' || chr(10) || 'man_' || l_orderkey || chr(10) || (l_linenumber % 3) || chr(10) || printf('occ_%04d_%06d', l_linenumber % 3, l_linenumber) || chr(10) || 'asset_' || l_partkey) event_id from lineitem"),
    "recipe_fingerprint": (recipe_fingerprint, "select l_orderkey, 'rfp2:' || sha256(string_agg('sha256:' || sha256(l_partkey::varchar), '|' order by l_linenumber, l_partkey, l_suppkey)) fingerprint from lineitem group by 1"),
    "first_sentences": (first_sentences, """select doc, coalesce(nullif(regexp_extract(t, '^(.*?[.!?])\\s', 1), ''), t) sentence from (
  select conv_id doc, trim(replace(text, chr(10), ' ')) t, row_number() over (partition by conv_id order by turn) n from conversations) where n = 1"""),
}
assert set(CTES)  # the shared table definitions are used by the other catalogues
