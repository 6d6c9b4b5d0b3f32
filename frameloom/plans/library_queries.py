"""Queries over usage events, projections, JSON texts, names, counters and ledger writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import text as T
from frameloom.functions.numbers import round_binary
from frameloom.operators import relational as R
from frameloom.sources import sinks
from frameloom.sources.media import CTES, catalog, ledger, segments, table


def _with(sql: str, *names: str) -> str:
    return "with " + ", ".join(CTES[n] for n in names) + " " + sql


def usage_event_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row a use of an asset: the lines of complete orders with what their order says; lines without order are a row of the audit."""
    outputs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", F.bround(F.col("o_totalprice") / 1000).cast("int").alias("target_sec"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    joined = lines.join(outputs, "l_orderkey")
    occurrence = F.format_string("occ_%04d_%06d", F.col("l_orderkey"), F.col("l_linenumber"))
    event = T.event_id(F.lit("v1"), F.concat(F.lit("man_"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), occurrence, F.concat(F.lit("asset_"), F.col("l_partkey").cast("string")))
    return joined.select(event.alias("event_id"), occurrence.alias("occurrence_id"), F.concat(F.lit("poi_"), "o_custkey").alias("poi_id"), F.concat(F.lit("asset_"), "l_partkey").alias("asset_id"), F.col("l_returnflag").alias("usage_role"), "o_orderdate", "target_sec")


def _clip_rows(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows as loose text, with some cells that can't be read."""
    k = F.col("vec_id")
    return catalog(spark, d).select("vec_id", F.when(k % 6 == 0, None).otherwise(F.col("clip_id")).alias("clip_id"), "category", F.when(k % 8 == 0, "n/a").otherwise(F.col("duration_sec").cast("string")).alias("duration_sec"), F.when(k % 9 == 0, "").otherwise(F.col("usage_count").cast("string")).alias("usage_count"))


CLIP_ROWS = """clip_rows as (select vec_id, case when vec_id % 6 = 0 then null else clip_id end clip_id, category, case when vec_id % 8 = 0 then 'n/a' else duration_sec::varchar end duration_sec,
  case when vec_id % 9 = 0 then '' else usage_count::varchar end usage_count from catalog)"""


def brief_projection(spark: SparkSession, d: str) -> DataFrame:
    """Clips for a brief: numbers or zero, and the row's number of its category where the id is missing."""
    number = F.row_number().over(Window.partitionBy("category").orderBy("vec_id"))
    rows = _clip_rows(spark, d).withColumn("n", number)
    return rows.select("vec_id", T.py_zfill(F.coalesce("clip_id", F.col("n").cast("string")), 4).alias("clip_id"), "category", F.coalesce(F.col("duration_sec").try_cast("double"), F.lit(0.0)).alias("duration_sec"), F.coalesce(F.col("usage_count").try_cast("int"), F.lit(0)).alias("usage_count"))


def durations_map(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("duration_sec").try_cast("double")
    return _clip_rows(spark, d).where(F.col("clip_id").isNotNull() & seconds.isNotNull()).select("clip_id", seconds.alias("seconds"))


def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimensions"))
    return catalog(spark, d).join(vectors, "vec_id", "left").select(F.col("clip_id").alias("id"), F.col("scene_description").alias("description"), F.col("duration_sec").alias("source_duration_sec"), "usage_count", "dimensions")


def hit_projection(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("event_id", "asset_id", round_binary(F.col("value") / 7, 6).alias("score"))


def metadata_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of candidates, with the candidate's place; ids that lead nowhere are left out."""
    asked = ledger(spark, d).where("usage_role = 'click'").groupBy("asset_id").agg(F.min("event_id").alias("position"))
    ready = catalog(spark, d).where("status = 'active'").select("asset_id", "clip_id")
    known = catalog(spark, d).where("category <> ''").select("clip_id", "scene_description")
    return asked.join(ready, "asset_id").join(known, "clip_id").select("position", "asset_id", "clip_id", "scene_description")


def clip_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Clip to asset to vector; the second vector is optional."""
    assets = catalog(spark, d).select("clip_id", "asset_id", "vec_id")
    first = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("text_label"))
    second = table(spark, d, "embeddings").where("label % 3 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("label").alias("visual_label"))
    return assets.join(first, "vec_id").join(second, "vec_id", "left").select("clip_id", "asset_id", "text_label", "visual_label")


def artifact_context(spark: SparkSession, d: str) -> DataFrame:
    """Each manifest with its receipt and the context of its sidecar, where there is one."""
    manifests = ledger(spark, d).groupBy("manifest_id").agg(F.count("*").alias("n"))
    receipts = ledger(spark, d).where("usage_role = 'purchase'").groupBy("manifest_id").agg(F.max("event_id").alias("receipt"))
    sidecars = ledger(spark, d).where("event_id % 13 = 0").groupBy("manifest_id").agg(F.min("run_id").alias("contract"))
    return manifests.join(receipts, "manifest_id", "left").join(sidecars, "manifest_id", "left")


def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("item_count"), F.count_if(s == "O").alias("pending_upload"), F.count_if(s == "F").alias("uri_ready"), F.count_if(s == "P").alias("upload_failed"), F.count_if(F.col("o_custkey") % 10 == 0).alias("missing_outputs"))


def candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).agg(F.count("*").alias("candidate_count"), F.countDistinct("poi_id").alias("poi_count"), F.countDistinct("manifest_id").alias("uri_count"))


def shared_union(spark: SparkSession, d: str) -> DataFrame:
    """Shared rows of all variants, one a clip: that of the first variant."""
    rows = ledger(spark, d).select((F.col("event_id") % 3).alias("variant"), "asset_id", "event_id")
    turn = F.row_number().over(Window.partitionBy("asset_id").orderBy("variant", "event_id"))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    answer = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 1, body).when(k % 5 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k % 5 == 3, F.lit("[1, 2]")).otherwise("no answer }{")
    return table(spark, d, "part").select("p_partkey", body.alias("body"), answer.alias("answer"))


def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", F.get_json_object(T.fenced_json(F.col("answer")), "$.name").alias("name"))


def salvaged_json(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", F.get_json_object(T.salvaged_json(F.col("answer")), "$.size").cast("int").alias("size"))


def batch_spec(spark: SparkSession, d: str) -> DataFrame:
    """Places of a batch's JSON, their name under one of three keys; places without name or id are left out."""
    k = F.col("s_suppkey")
    key = F.when(k % 4 == 0, "name").when(k % 4 == 1, "poi_name").when(k % 4 == 2, "display_name").otherwise("title")
    spec = F.to_json(F.create_map(key, F.concat(F.lit(" "), "s_name"), F.lit("poi_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("poi_"), k))))
    parsed = table(spark, d, "supplier").select("s_suppkey", F.from_json(spec, "name string, poi_name string, display_name string, poi_id string").alias("j"))
    named = parsed.select("s_suppkey", F.trim(F.coalesce("j.name", "j.poi_name", "j.display_name")).alias("name"), F.col("j.poi_id").alias("poi_id"))
    return named.where((F.col("name") != "") & (F.col("poi_id") != ""))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and labels of outputs: file, path, uri, duration label, floor of assets."""
    k = F.col("p_partkey")
    seconds = F.col("p_retailprice") / 30
    path = F.concat(F.lit("out/clip"), k, F.when(k % 2 == 0, "_30s").otherwise(""), F.when(k % 3 == 0, ".mov").otherwise(""))
    uri = F.when(k % 4 == 0, F.concat(F.lit("drive:"), k)).when(k % 4 == 1, "https://x/1")
    return table(spark, d, "part").select("p_partkey", T.music_filename(F.concat(F.lit(" "), "p_name", F.lit("!.")), k.cast("string")).alias("file"), T.output_path(path, k % 3, seconds).alias("path"), T.drive_uri(uri, F.concat(F.lit("f"), k)).alias("uri"), T.duration_label(seconds).alias("label"), T.asset_floor(k % 5, 20, 4).cast("int").alias("floor"))


def caption_words(spark: SparkSession, d: str) -> DataFrame:
    word = F.explode(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    rows = segments(spark, d).select("doc", word.alias("word")).distinct()
    wrapped = rows.withColumn("word", F.concat(F.lit("«("), "word", F.lit("\")")))
    return wrapped.select("doc", "word", T.caption_word(F.col("word")).alias("clean"))


def rounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("event_id", T.rounded_or_null(F.when(F.col("event_id") % 31 == 0, "bad").otherwise(F.col("value").cast("string"))).alias("value"))


def pacing_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Scripts whose pace is out of 120 to 150 words a minute, that fill over 90 % of their time, or whose last of four segments is the longer one."""
    counted = segments(spark, d).withColumn("n", T.word_count(F.col("text")))
    per = counted.groupBy("doc").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.min_by("n", "segment").alias("first"), F.max_by("n", "segment").alias("final"))
    rate = F.col("total") / 90.0 * 60
    rules = {"too_slow": rate >= 120, "too_fast": rate <= 150, "too_full": F.col("total") / 130.0 * 60 / 90.0 <= 0.9, "long_close": (F.col("k") != 4) | (F.col("final") <= F.col("first") + 3)}
    return per.select("doc", F.array_join(F.array_compact(F.array(*(F.when(~good, F.lit(name)) for name, good in rules.items()))), ",").alias("warnings"))


CANDIDATE = ["event_id", "asset_id", "run_id", "poi_id", "manifest_id"]


def candidate_insert(spark: SparkSession, d: str) -> DataFrame:
    """Which of the bought candidates go in, one after the other, under two unique keys: (asset, run) and (place, manifest)."""
    rows = ledger(spark, d)
    there, sent = rows.where("event_id % 90 = 0").select(*CANDIDATE), rows.where("usage_role = 'purchase' and event_id % 90 <> 0").select(*CANDIDATE)
    good, skipped = sinks.insertable(there, sent, ["asset_id"], ["poi_id", "manifest_id"], order=["event_id"])
    return good.withColumn("inserted", F.lit(True)).unionByName(skipped.withColumn("inserted", F.lit(False))).select("event_id", "inserted")


def register_check(spark: SparkSession, d: str) -> DataFrame:
    """Batches (a manifest each) sent to a ledger that has a third of their rows, some in other words: those batches are refused."""
    rows = ledger(spark, d).select("event_id", "asset_id", "run_id", "manifest_id")
    there = rows.where("event_id % 3 = 0").withColumn("run_id", F.when((F.col("event_id") % 21 == 0) & F.col("manifest_id").rlike("[05]$"), "other").otherwise(F.col("run_id")))
    return sinks.register(there, rows, "manifest_id", "event_id", ["asset_id", "run_id"], ["asset_id"])[1]


def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = ledger(spark, d).where("usage_role = 'error'").select("asset_id")
    return sinks.soft_delete(catalog(spark, d).select("asset_id", "status"), gone, "asset_id").groupBy("status").agg(F.count("*").alias("n"))


def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    wanted = catalog(spark, d).select("asset_id", T.embedding_text(F.col("scene_description"), F.col("category")).alias("text"))
    cache = wanted.where("asset_id not like '%3'").withColumn("text", F.when(F.col("asset_id").like("%7"), "old").otherwise(F.col("text")))
    return sinks.stale_texts(cache, wanted, "asset_id", "text").select("asset_id")


def duration_updates(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("duration_sec > 10").select("asset_id", sinks.duration_update(F.concat("asset_id", F.lit("'s")), F.col("duration_sec")).alias("sql"))


def usage_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the manifest without an output."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("variant"), F.concat(F.lit("asset_"), "l_partkey").alias("asset_id"), F.format_string("occ_%04d_%06d", F.col("l_orderkey"), F.col("l_linenumber")).alias("occurrence_id"))
    outputs = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("variant"))
    return R.orphans(lines, outputs)


BODY = "case p_partkey % 5 when 0 then 1 when 1 then 1 else 0 end"
INSERT = """with recursive {ledger}, there as (select * from ledger where {there}), sent as (select *, row_number() over (order by event_id) n, {taken} as taken from ledger where {sent}),
  fold as (select 0::bigint n, []::varchar[] a, []::varchar[] b, false ok union all select n, case when ok then list_append(a, x) else a end, case when ok then list_append(b, y) else b end, ok from (
    select s.n, f.a, f.b, {x} x, {y} y, not s.taken and not list_contains(f.a, {x}) and not list_contains(f.b, {y}) ok from fold f join sent s on s.n = f.n + 1))"""
CANDIDATE_INSERT = INSERT.format(ledger=CTES["ledger"], there="event_id % 90 = 0", sent="usage_role = 'purchase' and event_id % 90 <> 0", x="s.asset_id", y="s.poi_id || '|' || s.manifest_id", taken="asset_id in (select asset_id from there) or poi_id || '|' || manifest_id in (select poi_id || '|' || manifest_id from there)")

CATALOGUE = {
    "usage_event_rows": (usage_event_rows, """select 'sha256:' || sha256('v1' || chr(10) || 'man_' || l_orderkey || chr(10) || l_linenumber || chr(10) || printf('occ_%04d_%06d', l_orderkey, l_linenumber) || chr(10) || 'asset_' || l_partkey) event_id, printf('occ_%04d_%06d', l_orderkey, l_linenumber) occurrence_id,
  'poi_' || o_custkey poi_id, 'asset_' || l_partkey asset_id, l_returnflag usage_role, o_orderdate, round_even(o_totalprice / 1000, 0)::int target_sec from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'"""),
    "usage_orphans": (usage_orphans, "select printf('occ_%04d_%06d', l_orderkey, l_linenumber) as key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 11 <> 0)"),
    "brief_projection": (brief_projection, _with(f"select vec_id, case when length(c) < 4 then lpad(c, 4, '0') else c end clip_id, category, coalesce(try_cast(duration_sec as double), 0.0) duration_sec, coalesce(try_cast(usage_count as int), 0) usage_count from (select *, coalesce(clip_id, (row_number() over (partition by category order by vec_id))::varchar) c from clip_rows)", "catalog").replace(" select vec_id, case", f", {CLIP_ROWS} select vec_id, case", 1)),
    "durations_map": (durations_map, f"with {CTES['catalog']}, {CLIP_ROWS} select clip_id, try_cast(duration_sec as double) as seconds from clip_rows where clip_id is not null and try_cast(duration_sec as double) is not null"),
    "metadata_projection": (metadata_projection, _with("select clip_id id, scene_description description, duration_sec source_duration_sec, usage_count, len(embedding)::int dimensions from catalog left join embeddings using (vec_id)", "catalog")),
    "hit_projection": (hit_projection, _with("select event_id, asset_id, printf('%.6f', value / 7)::double score from ledger", "ledger")),
    "metadata_in_order": (metadata_in_order, _with("select position, a.asset_id, c.clip_id, scene_description from (select asset_id, min(event_id) as position from ledger where usage_role = 'click' group by 1) a join catalog c using (asset_id) where status = 'active' and category <> ''", "catalog", "ledger")),
    "clip_vectors": (clip_vectors, _with("select clip_id, asset_id, e.label text_label, v.label visual_label from catalog c join embeddings e using (vec_id) left join embeddings v on v.vec_id + 1 = c.vec_id and v.label % 3 = 0", "catalog")),
    "artifact_context": (artifact_context, _with("select manifest_id, count(*) n, max(case when usage_role = 'purchase' then event_id end) receipt, min(case when event_id % 13 = 0 then run_id end) contract from ledger group by 1", "ledger")),
    "inventory_summary": (inventory_summary, "select count(*) item_count, count_if(o_orderstatus = 'O')::bigint pending_upload, count_if(o_orderstatus = 'F')::bigint uri_ready, count_if(o_orderstatus = 'P')::bigint upload_failed, count_if(o_custkey % 10 = 0)::bigint missing_outputs from orders"),
    "candidate_summary": (candidate_summary, _with("select count(*) candidate_count, count(distinct poi_id) poi_count, count(distinct manifest_id) uri_count from ledger", "ledger")),
    "shared_union": (shared_union, _with("select event_id % 3 as variant, asset_id, event_id from ledger qualify row_number() over (partition by asset_id order by event_id % 3, event_id) = 1", "ledger")),
    "fenced_json": (fenced_json, f"select p_partkey, case when {BODY} = 1 then p_name end as name from part"),
    "salvaged_json": (salvaged_json, "select p_partkey, case when p_partkey % 5 <= 2 then p_size::int end as size from part"),
    "batch_spec": (batch_spec, "select s_suppkey, trim(s_name) as name, 'poi_' || s_suppkey poi_id from supplier where s_suppkey % 4 <> 3 and s_suppkey % 5 <> 0"),
    "output_names": (output_names, """select p_partkey, 'music_' || coalesce(nullif(regexp_replace(regexp_replace(' ' || p_name || '!.', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'track') || '_' || p_partkey || '.mp3' file,
  'out/clip' || p_partkey || '_v' || (p_partkey % 3) || '_' || round_even(p_retailprice / 30, 0)::int || 's' || case when p_partkey % 3 = 0 then '.mov' else '.mp4' end as path,
  case p_partkey % 4 when 0 then 'drive:' || p_partkey when 1 then null else 'drive:f' || p_partkey end uri, 'pgc_' || round_even(p_retailprice / 30, 0)::int || 's' as label, (20 + 4 * greatest(p_partkey % 5 - 1, 0))::int as floor from part"""),
    "caption_words": (caption_words, """select doc, '«(' || w || '")' word, coalesce(nullif(regexp_replace(regexp_replace('«(' || w || '")', '^["''“”‘’(\\[{<«»—–-]+', ''), '["''“”‘’)\\]}>«»—–]+$', ''), ''), '«(' || w || '")') clean from (
  select distinct conv_id doc, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) w from conversations)"""),
    "rounded_numbers": (rounded_numbers, _with("select event_id, case when event_id % 31 = 0 then null else printf('%.3f', value)::double end as value from ledger", "ledger")),
    "pacing_warnings": (pacing_warnings, """select doc, concat_ws(',', case when total / 90.0::double * 60 < 120 then 'too_slow' end, case when total / 90.0::double * 60 > 150 then 'too_fast' end, case when total / 130.0::double * 60 / 90.0 > 0.9 then 'too_full' end, case when k = 4 and final > first_ + 3 then 'long_close' end) warnings from (
  select conv_id doc, sum(n) total, count(*) k, arg_min(n, turn) first_, arg_max(n, turn) final from (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) n from conversations) group by 1)"""),
    "candidate_insert": (candidate_insert, f"{CANDIDATE_INSERT} select event_id, ok as inserted from sent join fold using (n)"),
    "register_check": (register_check, _with("""select manifest_id, expected, refused, mismatches, case when refused then 0 else there end as already, case when refused then 0 else fresh end as inserted, case when refused then 0 else expected - there - fresh end as skipped from (
  select manifest_id, count(*) as expected, count_if(event_id % 21 = 0 and manifest_id[-1] in ('0', '5'))::bigint mismatches, count_if(event_id % 21 = 0 and manifest_id[-1] in ('0', '5')) > 0 refused, count_if(event_id % 3 = 0)::bigint there from ledger group by 1) left join (
  select manifest_id, count(*) fresh from (select *, row_number() over (partition by asset_id order by event_id) turn from ledger where event_id % 3 <> 0 and asset_id not in (select asset_id from ledger where event_id % 3 = 0)
    and manifest_id not in (select manifest_id from ledger where event_id % 21 = 0 and manifest_id[-1] in ('0', '5'))) where turn = 1 group by 1) using (manifest_id)""", "ledger").replace("as already, case when refused then 0 else fresh end", "as already, case when refused then 0 else coalesce(fresh, 0) end").replace("expected - there - fresh", "expected - there - coalesce(fresh, 0)")),
    "soft_delete": (soft_delete, _with("select case when asset_id in (select asset_id from ledger where usage_role = 'error') then 'rejected' else status end as status, count(*) n from catalog group by 1", "catalog", "ledger")),
    "stale_embeddings": (stale_embeddings, _with("select asset_id from catalog where asset_id like '%3' or asset_id like '%7'", "catalog")),
    "duration_updates": (duration_updates, _with("select asset_id, printf('update music set duration_sec = %.6f where id = ''%s'''';', duration_sec, asset_id || '''''s') as sql from catalog where duration_sec > 10", "catalog").replace("''%s'''';'", "''%s'';'")),
}
