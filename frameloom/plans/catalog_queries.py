"""Queries over the catalog and the ledger: scans, filters, contracts, joins, roll-ups, audits, writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.text import py_zfill
from frameloom.operators import relational as R
from frameloom.sources.media import CTES, catalog, ledger, table

BAND = R.ResolutionPolicy("width_band", 720, 60)
CUTOFF = "2024-01-20 00:00:00"


def _with(sql: str, *names: str) -> str:
    return "with " + ", ".join(CTES[n] for n in names) + " " + sql


def _ready(spark: SparkSession, d: str) -> DataFrame:
    """Assets with a usable text vector: those of an embedding row with an even label."""
    return table(spark, d, "embeddings").where((F.col("label") % 2 == 0) & F.col("embedding").isNotNull()).select(F.concat(F.lit("asset_"), F.col("vec_id")).alias("asset_id")).distinct()


READY = "ready as (select distinct 'asset_' || vec_id asset_id from embeddings where label % 2 = 0 and embedding is not null)"


def scan_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d)


def scan_point(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(F.col("poi_id") == "poi_b7").orderBy("clip_id").limit(20).select("poi_id", "clip_id", "asset_id")


def ready_assets(spark: SparkSession, d: str) -> DataFrame:
    clips = catalog(spark, d).where((F.col("status") == "active") & (F.col("scene_description") != ""))
    return clips.join(_ready(spark, d), "asset_id").select("asset_id", "clip_id", "category", "duration_sec")


def ready_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ready(spark, d)


def eligible_pool(spark: SparkSession, d: str) -> DataFrame:
    visual = table(spark, d, "embeddings").where("label < 8").select(F.concat(F.lit("asset_"), F.col("vec_id")).alias("asset_id"))
    return catalog(spark, d).where("usage_count < 3").join(_ready(spark, d), "asset_id", "left_semi").join(visual, "asset_id", "left_semi").select("poi_id", "asset_id", "usage_count")


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Songs whose ids are no UUID, whose names or files are blank, whose lengths can't be read, now and then."""
    k, h = F.col("vec_id"), F.md5(F.col("asset_id").cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    seconds = F.when(k % 19 == 0, "n/a").when(k % 23 == 0, "-1").otherwise(F.col("duration_sec").cast("string"))
    return catalog(spark, d).select(F.when(k % 11 == 0, h).otherwise(uuid).alias("id"), F.when(k % 13 == 0, " ").otherwise(F.col("scene_description")).alias("music_name"), F.when(k % 17 == 0, None).otherwise(F.concat(F.lit("file"), k)).alias("drive_file_id"), seconds.alias("duration_sec"))


TRACKS = """tracks as (select case when vec_id % 11 = 0 then h else substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) end id, case when vec_id % 13 = 0 then ' ' else scene_description end music_name,
  case when vec_id % 17 = 0 then null else 'file' || vec_id end drive_file_id, case when vec_id % 19 = 0 then 'n/a' when vec_id % 23 = 0 then '-1' else duration_sec::varchar end duration_sec from (select *, md5(asset_id) h from catalog))"""


def music_pool(spark: SparkSession, d: str) -> DataFrame:
    """The shortest tracks of six seconds or more that keep the contract."""
    good = R.music_contract(_tracks(spark, d), 6.0).where(F.size("violations") == 0).withColumn("duration_sec", F.col("duration_sec").cast("double"))
    return good.orderBy("duration_sec", "music_name", "id").limit(200).select("id", "music_name", "duration_sec")


def music_contract(spark: SparkSession, d: str) -> DataFrame:
    return R.music_contract(_tracks(spark, d), 6.0).where(F.size("violations") > 0).select("id", F.array_join("violations", ",").alias("violations"))


def linked_candidates(spark: SparkSession, d: str) -> DataFrame:
    events = ledger(spark, d).select("event_id", F.concat(F.lit("manifest:"), "manifest_id", F.lit(":variant:"), (F.col("event_id") % 3).cast("string")).alias("source_video_key"))
    wanted = events.sparkSession.createDataFrame([("man_7",), ("man_12",)], "manifest_id string")
    # The key holds the id between colons, so it is cut out and joined by equality instead of by contains.
    return events.withColumn("manifest_id", F.split_part("source_video_key", F.lit(":"), F.lit(2))).join(F.broadcast(wanted), "manifest_id").select("source_video_key").distinct()


def file_ids(spark: SparkSession, d: str) -> DataFrame:
    found = F.coalesce(F.nullif(F.regexp_extract("url", "/([0-9]{3})[?]", 1), F.lit("")), F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit("")))
    ids = table(spark, d, "pages").select("page_id", py_zfill(found, 4).alias("clip_id")).where(F.col("clip_id").isNotNull())
    first = Window.partitionBy("clip_id").orderBy("page_id")
    return ids.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")


def audited_paths(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).where((F.col("usage_role") == "purchase") & (F.col("trim_start_sec") != "bad")).select("manifest_id").distinct()


def resolution_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(BAND.predicate(F.col("width"), F.col("height"))).select("asset_id", "width", "height")


def classification_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(F.array_contains(F.split("scene_description", " "), "red") | (F.col("category") == "ECONOMY")).select("asset_id", "category")


def row_contract(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the catalog that break its contract, each rule broken by some."""
    k = F.col("vec_id")
    bad = lambda n, value, c: F.when(k % n == 0, value).otherwise(c)
    path = F.concat("poi_id", F.lit("/clips/"), "asset_id", F.lit(".mp4"))
    path = F.when(k % 31 == 0, F.concat(F.lit("poi-assets/"), path)).when(k % 37 == 0, F.concat(path, F.lit("x"))).when(k % 41 == 0, "").otherwise(path)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("asset_id").cast("binary"), 256))
    rows = catalog(spark, d).select(
        "vec_id", bad(43, F.upper("poi_id"), F.col("poi_id")).alias("poi_id"), bad(47, None, F.col("asset_id")).alias("asset_id"), bad(53, F.concat("clip_id", F.lit("x")), F.col("clip_id")).alias("clip_id"), F.when(k % 59 == 0, "other").when(k % 61 == 0, " ").otherwise("poi-assets").alias("source_storage_bucket"),
        path.alias("source_storage_path"), bad(29, F.upper(digest), digest).alias("source_content_hash"), bad(5, None, F.col("status")).alias("status"), bad(67, F.lit("long"), (F.col("duration_sec") - 1).cast("string")).alias("duration_sec"),
        bad(71, F.lit("0"), F.lit(None)).alias("fps"), bad(73, F.lit("7.5"), F.col("width").cast("string")).alias("width"), "height", bad(79, F.lit(-1), F.lit(None)).alias("file_size_bytes"))
    return R.row_contract(rows).where(F.size("violations") > 0).select("vec_id", F.array_join("violations", ",").alias("violations"))


def snapshot_dupes(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(catalog(spark, d).withColumn("short_id", F.substring("clip_id", 3, 2)), "poi_id", "short_id")


def width_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.width_summary(catalog(spark, d))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(catalog(spark, d), "category")


def duration_bands(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).groupBy(R.duration_band(F.col("duration_sec")).alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("duration_sec"), 4).alias("seconds"))


def pool_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return catalog(spark, d).where("status = 'active'").groupBy("poi_id").agg(n.alias("n"), F.when(n < 20, "error").when(n < 80, "warning").otherwise("ok").alias("gate"))


def category_brief(spark: SparkSession, d: str) -> DataFrame:
    clips = catalog(spark, d).where("category <> ''")
    counts = clips.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("duration_sec"), 4).alias("seconds"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "category"))  # a row a category: few
    least = F.greatest(F.lit(4), F.ceil(F.sum("n").over(Window.partitionBy()) * 0.06))
    tier = F.when(F.col("place") <= 3, "core").when(F.col("n") >= F.col("least"), "secondary").otherwise("other")
    tiers = counts.withColumn("place", place).withColumn("least", least).withColumn("tier", tier)
    quota = F.when(F.col("tier") == "core", 6).when(F.col("tier") == "secondary", 4).otherwise(2)
    picked = clips.dropDuplicates(["category", "scene_description"]).select("category", "scene_description")
    turn = F.row_number().over(Window.partitionBy("category").orderBy("scene_description"))
    motifs = picked.withColumn("turn", turn).join(tiers, "category").where(F.col("turn") <= quota)
    return motifs.groupBy("category", "tier", "n", "seconds").agg(F.array_join(F.array_sort(F.collect_list("scene_description")), "|").alias("motifs"))


def _brief(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_brand").alias("shot_size"), F.when(F.col("p_partkey") % 9 == 0, None).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("camera_motion"))
    return catalog(spark, d).where("status = 'active'").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).join(parts, "vec_id")


def category_mixes(spark: SparkSession, d: str) -> DataFrame:
    """Per category the numbers of its clips by duration band, shot size and camera motion; what is not known counts as unknown."""
    clips = _brief(spark, d)
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    mixes = F.array(*(F.struct(F.lit(n).alias("mix"), v.alias("value")) for n, v in (("duration", R.duration_band(F.col("duration_sec"))), ("shot_size", value("shot_size")), ("camera_motion", value("camera_motion")))))
    return clips.select("category", F.explode(mixes).alias("m")).groupBy("category", "m.mix", "m.value").agg(F.count("*").alias("n"))


def _tiers(clips: DataFrame) -> DataFrame:
    counts = clips.groupBy("category").agg(F.count("*").alias("n"))  # a row a category: few
    place, least = F.row_number().over(Window.orderBy(F.desc("n"), "category")), F.greatest(F.lit(4), F.ceil(F.sum("n").over(Window.partitionBy()) * 0.06))
    tiers = counts.withColumn("place", place).withColumn("least", least)
    return tiers.withColumn("tier", F.when(F.col("place") <= 3, "core").when(F.col("n") >= F.col("least"), "secondary").otherwise("supporting_detail")).drop("least")


def _motifs(clips: DataFrame, by: list[str]) -> DataFrame:
    """Each scene once a category (lower case), at its first clip, in the order of clips."""
    once = clips.withColumn("phrase", F.lower(F.trim("scene_description"))).where("phrase <> ''").groupBy("category", "phrase").agg(F.min("clip_id").alias("clip_id"))
    return once.withColumn("turn", F.row_number().over(Window.partitionBy("category").orderBy(*by)))


def grounding_set(spark: SparkSession, d: str) -> DataFrame:
    """What a brief shows: six scenes of each core category, four of secondary and two of others, categories by size, 36 in all."""
    clips = _brief(spark, d)
    quota = F.when(F.col("tier") == "core", 6).when(F.col("tier") == "secondary", 4).otherwise(2)
    taken = _motifs(clips, ["clip_id", "phrase"]).join(_tiers(clips), "category").where(F.col("turn") <= quota)
    first = taken.orderBy("place", "turn").limit(36)
    return first.select("category", "tier", F.col("turn").cast("long").alias("turn"), "phrase")


def core_visuals(spark: SparkSession, d: str) -> DataFrame:
    """At most three anchors: of each core category, by size, the first of its four leading scenes that no earlier anchor shows."""
    clips = _brief(spark, d)
    core = _motifs(clips, ["clip_id", "phrase"]).where("turn <= 4").join(_tiers(clips).where("tier = 'core'"), "category")

    def fold(rows):  # twelve rows at most
        seen, out = set(), []
        for _, own in rows.sort_values(["place", "turn"]).groupby("place"):
            free = [r for r in own.itertuples(index=False) if r.phrase not in seen]
            if free and len(out) < 3:
                seen.add(free[0].phrase)
                out.append((free[0].category, free[0].phrase))
        return pd.DataFrame(out, columns=["category", "phrase"])

    return core.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "category string, phrase string")


def cooldown_set(spark: SparkSession, d: str) -> DataFrame:
    return R.cooldown_set(ledger(spark, d), F.lit(CUTOFF).cast("timestamp_ntz"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    receipts = orders.select(F.concat(F.lit("batch_"), F.pmod("o_orderkey", F.lit(400))).alias("batch"), F.when((F.pmod("o_orderkey", F.lit(400)) > 120) | (F.col("o_orderstatus") == "F"), "complete").otherwise("rendering").alias("state"))
    selections = orders.select(F.concat(F.lit("batch_"), F.pmod("o_orderkey", F.lit(400))).alias("batch"), F.concat(F.lit("poi_b"), F.pmod("o_custkey", F.lit(30))).alias("poi_id"))
    return R.active_claims(selections, receipts)


CLAIMS = """claims as (select poi_id, min(batch) batch from (
  select 'batch_' || (o_orderkey % 400) batch, 'poi_b' || (o_custkey % 30) poi_id from orders) s
  left join (select 'batch_' || (o_orderkey % 400) batch, bool_and(o_orderkey % 400 > 120 or o_orderstatus = 'F') released from orders group by 1) r using (batch)
  where not coalesce(released, false) group by 1)"""


def active_claims(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d)


def place_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return _eligibility(spark, d)


def _eligibility(spark: SparkSession, d: str) -> DataFrame:
    claims = _claims(spark, d).where("poi_id like 'poi_b1%'")
    cooled = ledger(spark, d).where("value > 300").select(F.concat(F.lit("poi_b"), F.pmod("event_id", F.lit(17))).alias("poi_id")).distinct()
    policy = R.ResolutionPolicy("min_width", 720, 0, 1.60, 1.86)
    return R.place_eligibility(catalog(spark, d), _ready(spark, d), claims, cooled, 4, policy, ["scene_description", "category"], "vec_id")


def select_places(spark: SparkSession, d: str) -> DataFrame:
    return R.select_places(_eligibility(spark, d), 5, 42)


def asset_snapshot(spark: SparkSession, d: str) -> DataFrame:
    shared = catalog(spark, d).where("vec_id % 3 <> 0").select("clip_id", F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(F.col("duration_sec")).alias("shared_sec"), "category")
    local = catalog(spark, d).where("vec_id % 2 = 0").select("clip_id", (F.col("duration_sec") + 1).alias("local_sec"), F.col("category").alias("local_category"))
    seconds = F.coalesce(F.nullif("shared_sec", F.lit(0.0)), F.nullif("local_sec", F.lit(0.0)))
    return catalog(spark, d).select("clip_id").join(shared, "clip_id", "left").join(local, "clip_id", "left").select("clip_id", seconds.alias("duration_sec"), F.coalesce("category", "local_category").alias("category"))


def attach_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.attach_vectors(catalog(spark, d).select("vec_id", "asset_id"), vectors, "vec_id").select("asset_id", "has_vector")


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_ids(ledger(spark, d), catalog(spark, d).where("vec_id % 4 <> 1").select("asset_id"), "asset_id")


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    outputs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").join(outputs, "l_orderkey").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("outputs"), F.countDistinct("l_partkey").alias("assets"))


def manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders as manifests, their lines as timeline entries: a manifest an order, an output for each ship mode, an asset for each part; each rule is broken by some."""
    o = F.col("o_orderkey")
    bad = lambda key, n, value, c: F.when(key % n == 3, value).otherwise(c)
    orders = table(spark, d, "orders")
    manifests = orders.select(o.alias("manifest_id"), bad(o, 101, 2, F.lit(1)).alias("schema_version"), bad(o, 103, " ", F.lit("run")).alias("run_id"), bad(o, 107, None, F.col("o_custkey").cast("string")).alias("poi_id"), F.col("o_orderpriority").alias("poi_name"))
    m, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines, key = table(spark, d, "lineitem"), F.col("l_orderkey") * 7 + F.col("l_linenumber")
    outputs = lines.where(m % 109 != 3).select(m.alias("manifest_id"), n.alias("n"), F.when(key % 113 == 3, F.lit("x")).when(key % 31 == 3, F.lit("1")).otherwise(n.cast("string")).alias("variant"), bad(key, 127, "", F.lit("out")).alias("path"), bad(key, 131, None, F.col("l_returnflag")).alias("music_label"))
    assets = lines.where(m % 137 != 3).select(m.alias("manifest_id"), n.alias("n"), F.when(key % 139 == 3, F.lit("")).when(key % 37 == 3, F.lit("asset_1")).otherwise(F.concat(F.lit("asset_"), "l_partkey")).alias("asset_id"))
    occurrence = F.when(key % 149 == 3, F.lit(None)).when(key % 41 == 3, F.lit("occ")).otherwise(F.format_string("occ_%04d", n))
    role = F.when(key % 151 == 3, F.lit("")).when(key % 5 == 3, F.lit("bridge_tail")).otherwise("assigned")
    entries = lines.where(m % 157 != 3).select(m.alias("manifest_id"), n.alias("n"), F.when(key % 163 == 3, F.lit("0")).when(key % 43 == 3, F.lit("99")).otherwise(n.cast("string")).alias("variant"), bad(key, 167, None, F.lit("0001")).alias("clip_id"), occurrence.alias("occurrence_id"), role.alias("usage_role"), F.when(key % 7 == 3, n).alias("segment"), F.when(key % 173 == 3, F.lit(None)).when(key % 47 == 3, F.lit("asset_x")).otherwise(F.concat(F.lit("asset_"), "l_partkey")).alias("asset_id"))
    return R.manifest_audit(manifests, outputs, assets, entries)


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    expected = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("customer"))
    seen = expected.where("o_orderkey % 19 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 23 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("customer", F.when(F.col("o_orderkey") % 29 == 0, None).when(F.col("o_orderkey") % 31 == 0, F.concat(F.lit(" "), "customer")).otherwise(F.col("customer")))
    return expected, seen.unionByName(seen.where("o_orderkey % 37 = 0"))


def reconcile_events(spark: SparkSession, d: str) -> DataFrame:
    return R.reconcile(*_recorded(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority", "customer"]).distinct()


def reconcile_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.reconcile(*_recorded(spark, d), "o_orderkey", ["o_orderstatus", "customer"], blank_is_null=True).distinct()


def _reconcile_sql(fields: tuple[str, ...], text: str) -> str:
    parts = [
        f"select e.o_orderkey, 'mismatch' kind, '{f}' field, {text.format('e.' + f)} expected, {text.format('o.' + f)} observed from expected e join observed o using (o_orderkey) where {text.format('e.' + f)} is distinct from {text.format('o.' + f)}"
        for f in fields
    ]
    return f"""with expected as (select o_orderkey, o_orderstatus, o_orderpriority, o_custkey::varchar customer from orders),
  seen as (select o_orderkey, case when o_orderkey % 23 = 0 then 'X' else o_orderstatus end o_orderstatus, o_orderpriority,
    case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 then ' ' || customer else customer end customer from expected where o_orderkey % 19 <> 0),
  observed as (select * from seen union all select * from seen where o_orderkey % 37 = 0)
  select distinct * from (select o_orderkey, 'missing' kind, null::varchar field, null::varchar expected, null::varchar observed from expected where o_orderkey not in (select o_orderkey from observed)
  union all {" union all ".join(parts)}
  union all select o_orderkey, 'duplicate', null, null, count(*)::varchar from observed group by 1 having count(*) > 1)"""


def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey", "l_linenumber").alias("keys")).withColumn("is_unique", F.col("rows") == F.col("keys"))


def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """Append every event of a purchase or click, each sent twice, to a ledger that has the clicks."""
    rows = ledger(spark, d).select("event_id", "asset_id", "run_id", "usage_role")
    sent = rows.where(F.col("usage_role").isin("purchase", "click"))
    return R.append_new(rows.where("usage_role = 'click'"), sent.unionByName(sent)).drop("usage_role")


def revert_preview(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("man_3",), ("man_50",)], "manifest_id string")
    role = F.coalesce("usage_role", F.lit("unknown"))
    return ledger(spark, d).join(F.broadcast(wanted), "manifest_id", "left_semi").groupBy("manifest_id", role.alias("role")).agg(F.count("*").alias("n"))


def revert_counts(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("man_3",), ("man_50",)], "manifest_id string")
    return R.revert(ledger(spark, d), wanted)[1]


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    role = F.coalesce("usage_role", F.lit("unknown"))
    return ledger(spark, d).groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.countDistinct("poi_id").alias("places"), F.countDistinct("asset_id").alias("assets"))


def resume_action(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("usage_role") == "purchase", "complete").when(F.col("usage_role") == "click", "rendered").otherwise("queued")
    return ledger(spark, d).groupBy(R.resume_action(state).alias("action")).agg(F.count("*").alias("n"))


def receipt_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a batch's videos, by priority, with the states of all their steps."""
    k = F.col("o_orderkey")
    of = lambda n, *states: F.get(F.array(*(F.lit(s) for s in states)), (F.floor(k / n) % len(states)).cast("int"))
    videos = table(spark, d, "orders").select("o_orderpriority", of(1, "rendered", "render_failed", "rendered_ok", None, "skipped_quarantined_poi", "queued").alias("state"), of(2, 0, 1, None).alias("return_code"), of(3, "found", "not_checked").alias("manifest"), of(5, "passed", "failed", "error", "not_run").alias("audit"), of(7, "verified", "failed", "verification_failed", None).alias("usage"),
        of(11, "verified", "failed_retryable", "verification_failed", "none").alias("candidate"), of(13, "verified", "verified_existing", "failed", None).alias("upload"), of(17, "verified", "failed", None).alias("upscale"))
    return R.receipt_summary(videos, ["o_orderpriority"])


def assigned_union(spark: SparkSession, d: str) -> DataFrame:
    assigned = ledger(spark, d).where("usage_role = 'purchase'").select("asset_id")
    reserve = catalog(spark, d).where("usage_count = 0").select("asset_id")
    return assigned.union(reserve).distinct()


def latest_valid(spark: SparkSession, d: str) -> DataFrame:
    docs = ledger(spark, d).select("asset_id", "created_at", "event_id", "trim_start_sec")
    return R.latest_valid(docs, "asset_id", "created_at", F.col("trim_start_sec").try_cast("double").isNotNull()).select("asset_id", "created_at", "event_id")


def calibrated_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per place the mean value of its newest day that has usable values."""
    usable = ledger(spark, d).where((F.col("value") > 20) & (F.col("usage_role") != "error"))
    days = usable.groupBy("poi_id", F.to_date("created_at").alias("day")).agg(F.round(F.avg("value"), 4).alias("rate"))
    return days.groupBy("poi_id").agg(F.max_by("rate", "day").alias("rate"), F.max("day").cast("string").alias("day"))


BRIEF = f"""with {CTES["catalog"]}, brief as (select c.* replace (coalesce(nullif(category, ''), 'unknown') as category), p_brand shot_size, case when p_partkey % 9 = 0 then null else split_part(p_name, chr(32), 2) end camera_motion from catalog c join part on p_partkey = vec_id where status = 'active')"""
TIERS = """tiers as (select *, case when place <= 3 then 'core' when n >= least then 'secondary' else 'supporting_detail' end tier from (select category, count(*) n, row_number() over (order by count(*) desc, category) place, greatest(4, ceil(sum(count(*)) over () * 0.06)) least from brief group by 1)),
  motifs as (select *, row_number() over (partition by category order by clip_id, phrase) turn from (select category, lower(trim(scene_description)) phrase, min(clip_id) clip_id from brief group by 1, 2) where phrase <> '')"""

CATALOGUE = {
    "scan_catalog": (scan_catalog, _with("select * from catalog", "catalog")),
    "scan_point": (scan_point, _with("select poi_id, clip_id, asset_id from catalog where poi_id = 'poi_b7' order by clip_id limit 20", "catalog")),
    "ready_assets": (ready_assets, _with("select asset_id, clip_id, category, duration_sec from catalog join ready using (asset_id) where status = 'active' and scene_description <> ''", "catalog").replace("with ", f"with {READY}, ", 1)),
    "ready_ids": (ready_ids, f"with {READY} select asset_id from ready"),
    "eligible_pool": (eligible_pool, _with("select poi_id, asset_id, usage_count from catalog where usage_count < 3 and asset_id in (select asset_id from ready) and asset_id in (select 'asset_' || vec_id from embeddings where label < 8)", "catalog").replace("with ", f"with {READY}, ", 1)),
    "music_pool": (music_pool, _with(f"select id, music_name, duration_sec::double duration_sec from tracks where regexp_full_match(id, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') and trim(music_name) <> '' and drive_file_id <> '' and try_cast(duration_sec as double) >= 6 order by duration_sec::double, music_name, id limit 200", "catalog").replace(" select id,", f", {TRACKS} select id,", 1)),
    "music_contract": (music_contract, _with("""select id, violations from (select id, concat_ws(',', case when not regexp_full_match(id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then 'id' end, case when trim(music_name) = '' then 'music_name' end, case when drive_file_id is null then 'drive_file_id' end,
  case when not coalesce(try_cast(duration_sec as double) > 0, false) then 'duration_sec' end, case when try_cast(duration_sec as double) > 0 and try_cast(duration_sec as double) < 6 then 'short' end) violations from tracks) where violations <> ''""", "catalog").replace(" select id, violations", f", {TRACKS} select id, violations", 1)),
    "linked_candidates": (linked_candidates, _with("select distinct key source_video_key from (select 'manifest:' || manifest_id || ':variant:' || (event_id % 3) as key from ledger) where contains(key, ':man_7:') or contains(key, ':man_12:')", "ledger")),
    "file_ids": (file_ids, """with ids as (select page_id, coalesce(nullif(regexp_extract(url, '/([0-9]{3})[?]', 1), ''), nullif(regexp_extract(url, 'page=([0-9]+)', 1), '')) i from pages)
  select min(page_id) page_id, case when length(i) < 4 then lpad(i, 4, '0') else i end clip_id from ids where i is not null group by 2"""),
    "audited_paths": (audited_paths, _with("select distinct manifest_id from ledger where usage_role = 'purchase' and trim_start_sec <> 'bad'", "ledger")),
    "resolution_filter": (resolution_filter, _with("select asset_id, width, height from catalog where abs(width - 720) <= 60 and height::double / width between 1.70 and 1.86", "catalog")),
    "classification_filter": (classification_filter, _with("select asset_id, category from catalog where list_contains(string_split(scene_description, ' '), 'red') or category = 'ECONOMY'", "catalog")),
    "row_contract": (row_contract, _with("""select vec_id, violations from (select vec_id, concat_ws(',', case when vec_id % 47 = 0 then 'missing_asset_id' end, case when vec_id % 59 <> 0 and vec_id % 61 = 0 then 'missing_source_storage_bucket' end,
  case when p = 41 then 'missing_source_storage_path' end, case when vec_id % 43 = 0 then 'poi_id' end, case when vec_id % 53 = 0 or not regexp_full_match(clip_id, '[0-9]{4}') then 'clip_id' end, case when vec_id % 29 = 0 then 'source_content_hash' end, case when vec_id % 59 = 0 then 'bucket' end,
  case when p = 31 then 'path_has_bucket' end, case when p = 37 or (p is null and (vec_id % 43 = 0 or vec_id % 47 = 0)) then 'path' end, case when vec_id % 5 <> 0 and status <> 'active' then 'status' end, case when vec_id % 67 = 0 or duration_sec <= 1 then 'duration_sec' end, case when vec_id % 71 = 0 then 'fps' end,
  case when vec_id % 73 = 0 then 'width' end, case when vec_id % 79 = 0 then 'file_size_bytes' end) violations from (select *, case when vec_id % 31 = 0 then 31 when vec_id % 37 = 0 then 37 when vec_id % 41 = 0 then 41 end p from catalog)) where violations <> ''""", "catalog")),
    "snapshot_dupes": (snapshot_dupes, _with("select poi_id, substr(clip_id, 3, 2) short_id, count(*) n from catalog group by 1, 2 having count(*) > 1", "catalog")),
    "width_summary": (width_summary, _with("select count(*) total, count_if(width is null or width <= 0)::bigint \"unknown\", count_if(width between 680 and 760)::bigint around_720, count_if(width between 1040 and 1120)::bigint around_1080, count_if(width >= 720)::bigint at_least_720 from catalog", "catalog")),
    "value_counts": (value_counts, _with("select coalesce(nullif(category, ''), 'unknown') as value, count(*) n from catalog group by 1", "catalog")),
    "duration_bands": (duration_bands, _with("select case when duration_sec < 6 then '<6s' when duration_sec < 8 then '6-8s' else '>=8s' end band, count(*) n, round(sum(duration_sec), 4) as seconds from catalog group by 1", "catalog")),
    "pool_gate": (pool_gate, _with("select poi_id, count(*) n, case when count(*) < 20 then 'error' when count(*) < 80 then 'warning' else 'ok' end gate from catalog where status = 'active' group by 1", "catalog")),
    "category_brief": (category_brief, _with("""select category, tier, n, seconds, string_agg(scene_description, '|' order by scene_description) motifs from (
  select t.*, m.scene_description, row_number() over (partition by category order by m.scene_description) turn from (
    select *, case when place <= 3 then 'core' when n >= least then 'secondary' else 'other' end tier from (
      select category, count(*) n, round(sum(duration_sec), 4) as seconds, row_number() over (order by count(*) desc, category) place, greatest(4, ceil(sum(count(*)) over () * 0.06)) least from catalog where category <> '' group by 1)) t
    join (select distinct category, scene_description from catalog where category <> '') m using (category)) where turn <= case tier when 'core' then 6 when 'secondary' then 4 else 2 end group by 1, 2, 3, 4""", "catalog")),
    "category_mixes": (category_mixes, f"{BRIEF} select category, mix, value, count(*) n from (select category, 'duration' mix, case when duration_sec < 6 then '<6s' when duration_sec < 8 then '6-8s' else '>=8s' end as value from brief union all select category, 'shot_size', shot_size from brief union all select category, 'camera_motion', coalesce(camera_motion, 'unknown') from brief) group by 1, 2, 3"),
    "grounding_set": (grounding_set, f"{BRIEF}, {TIERS} select category, tier, turn, phrase from motifs join tiers using (category) where turn <= case tier when 'core' then 6 when 'secondary' then 4 else 2 end order by place, turn limit 36"),
    "core_visuals": (core_visuals, f"""{BRIEF}, {TIERS}, c as (select * from motifs join tiers using (category) where tier = 'core' and turn <= 4), a as (select category, phrase from c where place = 1 and turn = 1),
  b as (select category, phrase from c where place = 2 and phrase not in (select phrase from a) order by turn limit 1), z as (select category, phrase from c where place = 3 and phrase not in (select phrase from a union all select phrase from b) order by turn limit 1) select * from a union all select * from b union all select * from z"""),
    "cooldown_set": (cooldown_set, _with(f"select distinct poi_id from ledger where created_at >= timestamp '{CUTOFF}' and starts_with(run_id, 'pgc_run_')", "ledger")),
    "active_claims": (active_claims, f"with {CLAIMS} select poi_id, batch from claims"),
    "place_eligibility": (place_eligibility, _with("""select poi_id, active_assets, effective_assets, ready_assets, fitting, unknown_width, around_720, around_1080, at_least_720, scene_description, category, case when claimed then 'in_progress_lock' when active_assets < 4 then 'insufficient_active_assets'
  when effective_assets < 4 then 'insufficient_source_resolution_assets' when ready_assets < 4 then 'insufficient_source_resolution_candidate_ready_assets' else 'eligible' end reason, coalesce(cooled, false) cooldown from (
  select poi_id, count(distinct asset_id) active_assets, count(distinct case when fits then asset_id end) effective_assets, count(distinct case when fits and r then asset_id end) ready_assets, count_if(fits)::bigint fitting, 0::bigint unknown_width, count_if(fits and width between 680 and 760)::bigint around_720, count_if(fits and width between 1040 and 1120)::bigint around_1080,
    count_if(fits and width >= 720)::bigint at_least_720, arg_min(scene_description, vec_id) scene_description, arg_min(category, vec_id) category from (
    select c.*, width >= 720 and height::double / width between 1.60 and 1.86 fits, r.asset_id is not null r from catalog c left join ready r using (asset_id) where status = 'active') group by 1)
  left join (select poi_id, true claimed from claims where poi_id like 'poi_b1%') using (poi_id)
  left join (select distinct 'poi_b' || (event_id % 17) poi_id, true cooled from ledger where value > 300) using (poi_id)""", "catalog", "ledger").replace("with ", f"with {READY}, {CLAIMS}, ", 1)),
    "asset_snapshot": (asset_snapshot, _with("""select c.clip_id, coalesce(nullif(case when s.vec_id % 5 = 0 then 0.0 else s.duration_sec end, 0), nullif(l.duration_sec + 1, 0)) duration_sec, coalesce(s.category, l.category) category
  from catalog c left join (select * from catalog where vec_id % 3 <> 0) s using (clip_id) left join (select * from catalog where vec_id % 2 = 0) l using (clip_id)""", "catalog")),
    "attach_vectors": (attach_vectors, _with("select asset_id, exists(select 1 from embeddings e where e.vec_id = catalog.vec_id and len(embedding) > 0) has_vector from catalog", "catalog")),
    "missing_ids": (missing_ids, _with("select distinct asset_id from ledger where asset_id not in (select asset_id from catalog where vec_id % 4 <> 1)", "catalog", "ledger")),
    "usage_events": (usage_events, "select l_returnflag, l_linestatus, count(*) n, count(distinct l_orderkey) outputs, count(distinct l_partkey) assets from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1, 2"),
    "manifest_audit": (manifest_audit, """with k as (select l_orderkey m, l_linenumber n, l_orderkey * 7 + l_linenumber k, l_partkey p from lineitem),
  outs as (select m, n, k, case when k % 113 = 3 then null when k % 31 = 3 then 1 else n end v from k where m % 109 <> 3), snap as (select m, n, case when k % 139 = 3 then '' when k % 37 = 3 then 'asset_1' else 'asset_' || p end a from k where m % 137 <> 3),
  ent as (select m, n, k, case when k % 163 = 3 then 0 when k % 43 = 3 then 99 else n end v, case when k % 149 = 3 then null when k % 41 = 3 then 'occ' else printf('occ_%04d', n) end o, case when k % 173 = 3 then null when k % 47 = 3 then 'asset_x' else 'asset_' || p end a from k where m % 157 <> 3)
  select o_orderkey manifest_id, 'schema_version' field, null::varchar as key from orders where o_orderkey % 101 = 3 union all select o_orderkey, 'run_id', null from orders where o_orderkey % 103 = 3 union all select o_orderkey, 'poi.poi_id', null from orders where o_orderkey % 107 = 3
  union all select o_orderkey, 'outputs', null from orders where o_orderkey not in (select m from outs) union all select o_orderkey, 'asset_snapshot', null from orders where o_orderkey not in (select m from snap) union all select o_orderkey, 'timeline_entries', null from orders where o_orderkey not in (select m from ent)
  union all select m, 'outputs.variant_index', n::varchar from outs where v is null union all select m, 'outputs.variant_index.unique', n::varchar from (select *, row_number() over (partition by m, v order by n) t from outs where v is not null) where t > 1
  union all select m, 'outputs.output_path', n::varchar from outs where k % 127 = 3 union all select m, 'outputs.music_label', n::varchar from outs where k % 131 = 3
  union all select m, 'asset_snapshot.asset_id', n::varchar from snap where a = '' union all select m, 'asset_snapshot.asset_id.unique', n::varchar from (select *, row_number() over (partition by m, a order by n) t from snap where a <> '') where t > 1
  union all select m, 'timeline_entries.variant_index', n::varchar from ent where v = 0 union all select m, 'timeline_entries.variant_index.reference', n::varchar from ent e where v > 0 and exists(select 1 from outs o where o.m = e.m and o.v is not null) and not exists(select 1 from outs o where o.m = e.m and o.v = e.v)
  union all select m, 'timeline_entries.clip_id', n::varchar from ent where k % 167 = 3 union all select m, 'timeline_entries.occurrence_id', n::varchar from ent where o is null
  union all select m, 'timeline_entries.occurrence_id.unique', n::varchar from (select *, row_number() over (partition by m, o order by n) t from ent where o is not null) where t > 1 union all select m, 'timeline_entries.usage_role', n::varchar from ent where k % 151 = 3
  union all select m, 'timeline_entries.segment', n::varchar from ent where k % 151 <> 3 and k % 5 = 3 and k % 7 = 3 union all select m, 'timeline_entries.asset_id', n::varchar from ent where a is null
  union all select m, 'timeline_entries.asset_id.reference', n::varchar from ent e where a is not null and exists(select 1 from snap s where s.m = e.m and s.a <> '') and not exists(select 1 from snap s where s.m = e.m and s.a = e.a)"""),
    "reconcile_events": (reconcile_events, _reconcile_sql(("o_orderstatus", "o_orderpriority", "customer"), "{}")),
    "reconcile_candidates": (reconcile_candidates, _reconcile_sql(("o_orderstatus", "customer"), "nullif(trim({}), '')")),
    "uniqueness": (uniqueness, "select count(*) \"rows\", count(distinct (l_orderkey, l_linenumber)) keys, count(*) = count(distinct (l_orderkey, l_linenumber)) is_unique from lineitem"),
    "ledger_append": (ledger_append, _with("select event_id, asset_id, run_id from ledger where usage_role = 'purchase'", "ledger")),
    "revert_preview": (revert_preview, _with("select manifest_id, coalesce(usage_role, 'unknown') as role, count(*) n from ledger where manifest_id in ('man_3', 'man_50') group by 1, 2", "ledger")),
    "revert_counts": (revert_counts, _with("select asset_id, count(*) usage_count from ledger where manifest_id not in ('man_3', 'man_50') group by 1", "ledger")),
    "event_summary": (event_summary, _with("select coalesce(usage_role, 'unknown') as role, count(*) n, count(distinct poi_id) places, count(distinct asset_id) assets from ledger group by 1", "ledger")),
    "resume_action": (resume_action, _with("select case usage_role when 'purchase' then 'skip' when 'click' then 'tail' else 'render' end as action, count(*) n from ledger group by 1", "ledger")),
    "receipt_summary": (receipt_summary, """select o_orderpriority, count(*) requested_videos, count_if(s in (0, 2) or o_orderkey // 2 % 3 = 0)::bigint rendered_videos, count_if(s = 1)::bigint failed_videos, count_if(o_orderkey // 3 % 2 = 0)::bigint manifest_found_videos, count_if(o_orderkey // 5 % 4 = 0)::bigint manifest_audited_videos,
  count_if(o_orderkey // 5 % 4 in (1, 2))::bigint manifest_audit_failed_videos, count_if(o_orderkey // 7 % 4 = 0)::bigint usage_written_videos, count_if(o_orderkey // 11 % 4 = 0)::bigint release_candidates_created, count_if(o_orderkey // 13 % 4 in (0, 1))::bigint drive_uploaded_videos, count_if(o_orderkey // 13 % 4 = 2)::bigint drive_upload_failed_videos,
  count_if(o_orderkey // 17 % 3 = 0)::bigint final_upscaled_videos, count_if(o_orderkey // 17 % 3 = 1)::bigint final_upscale_failed_videos, count_if(o_orderkey // 7 % 4 in (1, 2))::bigint usage_failed_videos, count_if(o_orderkey // 11 % 4 in (1, 2))::bigint release_candidate_failed_videos, count_if(s = 4)::bigint quarantined_skipped_videos
  from (select *, o_orderkey % 6 s from orders) group by 1"""),
    "assigned_union": (assigned_union, _with("select asset_id from ledger where usage_role = 'purchase' union select asset_id from catalog where usage_count = 0", "catalog", "ledger")),
    "latest_valid": (latest_valid, _with("select asset_id, created_at, event_id from ledger where try_cast(trim_start_sec as double) is not null qualify row_number() over (partition by asset_id order by created_at desc, event_id desc) = 1", "ledger")),
    "calibrated_rate": (calibrated_rate, _with("select poi_id, arg_max(rate, day) rate, max(day)::varchar as day from (select poi_id, created_at::date as day, round(avg(value), 4) rate from ledger where value > 20 and usage_role <> 'error' group by 1, 2) group by 1", "ledger")),
}
_ELIGIBLE = CATALOGUE["place_eligibility"][1]
CATALOGUE["select_places"] = (select_places, f"""select (row_number() over (order by cooldown, draw, poi_id))::int pick, poi_id, cooldown, case when cooldown then 'cooled_fallback' else 'fresh' end selected_as from (
  select *, md5(case when cooldown then '43:' else '42:' end || poi_id) draw from ({_ELIGIBLE}) where reason = 'eligible') order by cooldown, draw, poi_id limit 5""")
