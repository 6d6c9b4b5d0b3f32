"""Queries over embedding columns: scores, ranks, centroids, near-duplicates, diverse picks, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.operators import assignment as A
from frameloom.operators import vectors as V
from frameloom.plans.sequence_queries import FREE, MERGED, SOURCES, USED, merged_windows
from frameloom.sources.media import CTES, catalog, table, words

#: No pair within a label reaches the production threshold of 0.85 in these tables.
NEAR = 0.3


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries, the rows whose id is divisible by 20, and all rows."""
    rows = _rows(spark, d)
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows.select("vec_id", "v")


def _scored(spark: SparkSession, d: str, k: int) -> DataFrame:
    return V.scores(*_asked(spark, d), k)


SCORED = "scored as (select q.vec_id query_id, a.vec_id, list_cosine_similarity(q.embedding::double[], a.embedding::double[]) score from embeddings q, embeddings a where q.vec_id % 20 = 0)"
RANKED = "ranked as (select *, (row_number() over (partition by query_id order by round(score, 12) desc, vec_id))::int as rank from scored)"


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    return V.rank_per_query(_scored(spark, d, k), k).withColumn("score", F.round("score", 6))


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    """Each clip's largest score: a maximum in each block, then over blocks."""
    return V.scores(*_asked(spark, d), maximum="vec_id").groupBy("vec_id").agg(F.max("score").alias("relevance"))


def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of queries and rows, those of a block by their score, as equal scores beside each other take less space."""
    return V.all_scores(*_asked(spark, d)).withColumn("score", F.round("score", 6))


def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 6)


def rank_per_query(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with their ranks: the vectors go to the tasks that rank, not the pairs."""
    return V.all_ranks(*_asked(spark, d)).withColumn("score", F.round("score", 6))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.candidates(_scored(spark, d, 6), 6, 35).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def relevance_by_asset(spark: SparkSession, d: str) -> DataFrame:
    return _relevance(spark, d).withColumn("relevance", F.round("relevance", 6))


def pad_reserve(spark: SparkSession, d: str) -> DataFrame:
    """At most 35 candidates, filled up to 60 with the least used and longest other clips; none where the pool has less than 50."""
    clips = catalog(spark, d)
    first = V.candidates(_scored(spark, d, 6), 6, 35).select("vec_id", F.lit(0).alias("tier"))
    rest = clips.join(first, "vec_id", "left_anti").orderBy("usage_count", F.desc("duration_sec"), "clip_id").limit(60).select("vec_id", F.lit(1).alias("tier"))
    both = first.unionByName(rest).join(clips, "vec_id", "left").orderBy("tier", "usage_count", F.desc("duration_sec"), "clip_id").limit(60).select("vec_id", "tier")
    return both.join(clips.agg((F.count("*") >= 50).alias("enough")).where("enough").hint("broadcast"), F.lit(True), "left_semi")


def best_feasible(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best score among clips that cover eight seconds; others are left out in the block, before anything is shuffled."""
    rows = _rows(spark, d).join(catalog(spark, d).select("vec_id", "duration_sec"), "vec_id")
    queries = _rows(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(8.0).alias("span"))
    best = V.scores(queries, rows.select("vec_id", "v", "duration_sec"), weigh=A.covering, maximum="query_id")
    return best.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"))


def parse_vector(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("vec_id") % 7 == 0, F.lit("[1, 2.5]")).otherwise(F.to_json("v"))
    return _rows(spark, d).select("vec_id", F.size(V.parse_vector(text, 64)).alias("length"))


def unit_vector(spark: SparkSession, d: str) -> DataFrame:
    u = V.unit_vector(F.col("v"))
    return _rows(spark, d).select("vec_id", F.round(F.get(u, F.lit(0)), 6).alias("first"), F.round(F.get(u, F.lit(63)), 6).alias("last"))


def max_cos_to_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    best = V.max_cosine_to(rows, rows.where("vec_id % 20 = 0"), "label")
    return best.select("label", "vec_id", F.round("max_cosine", 6).alias("max_cosine"))


def centroid(spark: SparkSession, d: str) -> DataFrame:
    return V.centroid(_rows(spark, d), "label").select("label", "position", F.round("mean", 6).alias("mean"))


def whiten(spark: SparkSession, d: str) -> DataFrame:
    return V.whiten(_rows(spark, d), "label").select("label", "vec_id", F.round(F.get("w", F.lit(0)), 6).alias("first"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.near_dup_pairs(_rows(spark, d), "label", NEAR)


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by their score as it is returned: what six places round up to the threshold is in."""
    pairs = V.near_dup_pairs(_rows(spark, d), "label", NEAR - 1e-6)
    return pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= NEAR)


def diversity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("label").agg(F.count("*").alias("pairs"), F.count_if(F.col("score") >= 0.4).alias("close_pairs"), F.round(F.max("score"), 6).alias("worst"))


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.leader_clusters(_rows(spark, d), _pairs(spark, d), "label")


def maxmin_select(spark: SparkSession, d: str) -> DataFrame:
    return V.maxmin_select(_rows(spark, d), "label", 10)


def maxmin_medoid(spark: SparkSession, d: str) -> DataFrame:
    return V.maxmin_select(_rows(spark, d), "label", 10, medoid=True, stop=0.9)


def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    return V.diverse_selection(_rows(spark, d).join(_relevance(spark, d), "vec_id"), "label", 45, 30)


def kept_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return V.kept_redundancy(_rows(spark, d), "label", 0.2)


def _videos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beats, clips and shown windows of two places: every 20th vector is a beat, eight in a row a video; the others are the places' clips."""
    phase = F.element_at(F.array(*map(F.lit, ("early", "middle", "climax", "late peak", ""))), (F.pmod("vec_id", F.lit(5)) + 1).cast("int"))
    rows = _rows(spark, d).join(catalog(spark, d), "vec_id").withColumn("place", F.col("label") % 2)
    number = F.row_number().over(Window.partitionBy("place").orderBy("vec_id")) - 1
    beats = rows.where("vec_id % 20 = 0").withColumn("n", number)
    beats = beats.select((F.col("place") * 100_000 + F.floor(F.col("n") / 8)).cast("long").alias("video"), "place", (F.col("n") % 8).cast("long").alias("beat"), F.col("v").alias("q"), F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.col("duration_sec"))).alias("span"))
    looks = F.when(F.col("vec_id") % 11 != 0, V.unit_vector(F.col("v")))
    clips = rows.where("vec_id % 20 <> 0").select("place", "vec_id", "asset_id", "v", looks.alias("u"), "duration_sec", "category", phase.alias("phase"))
    return beats, clips, merged_windows(spark, d)


def assignment(spark: SparkSession, d: str) -> DataFrame:
    return A.global_pack(*_videos(spark, d), threshold=NEAR)


def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    return A.greedy_pack(*_videos(spark, d), threshold=NEAR)


def assignment_audit(spark: SparkSession, d: str) -> DataFrame:
    """Violations of assignments with planted faults of every kind."""
    w = words(spark, d)
    parts = w.groupBy("doc", "segment").agg(F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"), F.max("end").alias("end"), F.min("start").alias("start"))
    half = F.floor((F.col("first_word") + F.col("last_word")) / 2).cast("int")
    k = F.col("doc") * 3 + F.col("segment")
    two = parts.where("not (doc % 7 = 3 and segment = 1)").withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("last_word") > F.col("first_word"))
    first = F.when(F.col("place") == 0, F.col("first_word") + F.when(k % 17 == 1, 1).otherwise(0)).otherwise(half + 1 + F.when(k % 13 == 2, 1).otherwise(0))
    last = F.when(F.col("place") == 0, half).otherwise(F.col("last_word") + F.when(k % 19 == 3, 1).when(k % 11 == 4, -1).otherwise(0))
    number = F.when((k % 23 == 5) & (F.col("place") == 1), None).when(k % 29 == 6, 9_000_000 + k).otherwise((k * 2 + F.when(k % 31 == 7, 0).otherwise(F.col("place"))) % 150 + 1)
    span = F.least((F.col("end") - F.col("start")) / 2, F.lit(4.0))
    entries = two.select("doc", F.when(k % 37 == 8, 900).otherwise(F.col("segment")).alias("segment"), "place", number.cast("string").alias("clip_id"), first.alias("first_word"), last.alias("last_word"), F.when(k % 41 == 9, -0.5).otherwise(F.lit(0.5)).alias("trim"), span.alias("span"))
    return A.audit(entries, parts.select("doc", "segment", "first_word", "last_word"), catalog(spark, d).select("clip_id", "duration_sec"), w.groupBy("doc").agg(F.count("*").alias("n_words")))


#: Folds as recursive queries.
MAXMIN="""with recursive cosines as (select a.label, a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a join embeddings b on a.label = b.label),
  picks as (select label, 1 pick, min(vec_id) vec_id, [min(vec_id)] chosen from embeddings group by label
  union all select label, pick + 1, nxt, list_append(chosen, nxt) from (
    select label, pick, chosen, arg_min(a, (m, a)) nxt from (select p.label, p.pick, p.chosen, c.a, max(c.c) m from picks p join cosines c on c.label = p.label and list_contains(p.chosen, c.b) and not list_contains(p.chosen, c.a) where p.pick < 10 group by all) group by all))
  select label, pick::bigint pick, vec_id from picks"""
KEPT="""with recursive numbered as (select label, vec_id, embedding::double[] v, row_number() over (partition by label order by vec_id) n from embeddings),
  fold as (select label, n, [v] kept, 0 redundant from numbered where n = 1
  union all select f.label, x.n, case when near then kept else list_append(kept, x.v) end, redundant + near::int from (
    select f.*, x.v, x.n xn, list_max(list_transform(f.kept, lambda k: list_cosine_similarity(k, x.v))) >= 0.2 as near from fold f join numbered x on x.label = f.label and x.n = f.n + 1) f join numbered x on x.label = f.label and x.n = f.n + 1)
  select label, redundant::bigint redundant, len(kept)::bigint kept from fold qualify row_number() over (partition by label order by n desc) = 1"""

GREEDY = f"""with recursive {CTES["catalog"]}, {CTES["ledger"]}, {USED}, {MERGED}, {SOURCES}, {FREE},
  rows_ as (select e.vec_id, embedding::double[] v, label % 2 place, asset_id, duration_sec, category from embeddings e join catalog using (vec_id)),
  asked as (select place * 100000 + n // 8 as video, place, n % 8 as beat, v q, greatest(1.0, least(4.0, duration_sec)) span from (select *, row_number() over (partition by place order by vec_id) - 1 as n from rows_ where vec_id % 20 = 0)),
  pool as (select r.*, case when vec_id % 11 <> 0 then v end u, coalesce(longest, 0.0) longest from rows_ r left join (select asset_id, max("end" - start) longest from free_ group by 1) using (asset_id) where vec_id % 20 <> 0),
  picks as (select distinct video, -1::bigint as beat, []::bigint[] chosen, []::double[][] units, ''::varchar prev, null::bigint vec_id, null::double score, 0 as rung, 0.0::double span from asked
    union all select video, beat + 1, list_append(chosen, b.vec_id), case when b.u is null then units else list_append(units, b.u) end, case when b.category <> '' then b.category else prev end, b.vec_id, b.score, b.rung, span from (
      select video, beat, chosen, units, prev, span, arg_min({{'vec_id': vec_id, 'u': u, 'category': category, 'score': score, 'rung': rung}}, (rung, -round(score, 12), vec_id)) b from (
        select p.video, p.beat, p.chosen, p.units, p.prev, a.span, c.vec_id, c.u, c.category, list_cosine_similarity(a.q, c.v) score,
          case when c.longest < a.span then 4 else 2 * coalesce(list_max(list_transform(p.units, lambda x: list_cosine_similarity(x, c.u))) >= {NEAR}, false)::int + (p.prev <> '' and c.category = p.prev)::int end rung
        from picks p join asked a on a.video = p.video and a.beat = p.beat + 1 join pool c on c.place = a.place and c.duration_sec + 0.05 >= a.span and not list_contains(p.chosen, c.vec_id)) group by all)),
  placed as (select p.video, p.beat, p.vec_id, p.score, p.rung, p.span, c.asset_id, c.duration_sec, p.vec_id % 5 as phase, (select min({{'a': start, 'z': "end"}}) from free_ f where f.asset_id = c.asset_id and f."end" - f.start >= p.span) w from picks p join pool c using (vec_id) where p.beat >= 0),
  tried as (select video, beat, t, sum(coalesce(greatest(least(t + span, m."end") - greatest(t, m.start), 0.0), 0.0)) o from (
    select video, beat, span, asset_id, unnest([0.0, least(greatest(m."end", 0.0), greatest(0.0, duration_sec - span)), least(greatest(m.start - span, 0.0), greatest(0.0, duration_sec - span))]) t from placed join merged m using (asset_id) where w is null
    union select video, beat, span, asset_id, 0.0 from placed where w is null) left join merged m using (asset_id) group by 1, 2, 3)
  select video::bigint video, beat::bigint beat, vec_id, span, round(score, 4) score, round(case when w is null then (select arg_min(t, (o, t)) from tried where tried.video = placed.video and tried.beat = placed.beat)
    when w.z - w.a - span <= 0 then w.a when phase in (2, 3) then w.z - span when phase = 1 then w.a + (w.z - w.a - span) / 2 else w.a end, 3) trim_start, w is null exhausted, rung in (1, 3) same_category, rung in (2, 3) near_duplicate, 'ok' status from placed"""

CATALOGUE = {
    "cosine_scores": (cosine_scores, f"with {SCORED} select query_id, vec_id, round(score, 6) score from scored"),
    "topk_per_query": (topk_per_query, f"with {SCORED}, {RANKED} select query_id, vec_id, round(score, 6) score, rank from ranked where rank <= 6"),
    "rank_per_query": (rank_per_query, f"with {SCORED}, {RANKED} select query_id, vec_id, round(score, 6) score, rank from ranked"),
    "candidates": (candidates, f"with {SCORED}, {RANKED} select query_id, vec_id, rank, round(score, 6) score from ranked where rank <= 6 qualify row_number() over (partition by vec_id order by query_id, rank) = 1 order by query_id, rank limit 35"),
    "relevance_by_asset": (relevance_by_asset, f"with {SCORED} select vec_id, round(max(score), 6) relevance from scored group by 1"),
    "pad_reserve": (pad_reserve, f"""with {SCORED}, {RANKED}, {CTES["catalog"]}, firsts as (select query_id, vec_id, rank from ranked where rank <= 6 qualify row_number() over (partition by vec_id order by query_id, rank) = 1 order by query_id, rank limit 35)
  select vec_id, tier from (select vec_id, 0 tier from firsts union all (select vec_id, 1 from catalog where vec_id not in (select vec_id from firsts) order by usage_count, duration_sec desc, clip_id limit 60)) left join catalog using (vec_id)
  where (select count(*) from catalog) >= 50 order by tier, usage_count, duration_sec desc, clip_id limit 60"""),
    "best_feasible": (best_feasible, f"with {SCORED}, {CTES['catalog']} select query_id, round(max(score), 6) best from scored join catalog using (vec_id) where duration_sec + 0.05 >= 8.0 group by 1"),
    "parse_vector": (parse_vector, "select vec_id, case when vec_id % 7 = 0 then null else len(embedding)::int end length from embeddings"),
    "unit_vector": (unit_vector, "select vec_id, round(embedding[1]::double / n, 6) as first, round(embedding[64]::double / n, 6) as last from (select *, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) n from embeddings)"),
    "max_cos_to_set": (max_cos_to_set, "select a.label, a.vec_id, round(coalesce(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 0.0), 6) max_cosine from embeddings a left join (select * from embeddings where vec_id % 20 = 0) b on a.label = b.label group by 1, 2"),
    "centroid": (centroid, "select label, position, round(avg(x), 6) mean from (select label, unnest(embedding)::double x, (generate_subscripts(embedding, 1) - 1)::int position from embeddings) group by 1, 2"),
    "whiten": (whiten, """with m as (select label, position, avg(x) mean from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) position from embeddings) group by 1, 2),
  e as (select label, vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) position from embeddings)
  select label, vec_id, round(sum(case when position = 1 then x - mean end) / sqrt(sum((x - mean) * (x - mean))), 6) as first from e join m using (label, position) group by 1, 2"""),
    "near_dup_pairs": (near_dup_pairs, f"select * from (select a.label, a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) where score >= {NEAR}"),
    "diversity_metrics": (diversity_metrics, f"select label, count(*) pairs, count_if(score >= 0.4)::bigint close_pairs, round(max(score), 6) worst from (select a.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) where score >= {NEAR} group by 1"),
    "leader_clusters": (leader_clusters, f"select label, count_if(not exists(select 1 from embeddings a where a.label = b.label and a.vec_id < b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {NEAR}))::bigint clusters from embeddings b group by 1"),
    "maxmin_select": (maxmin_select, MAXMIN),
    "maxmin_medoid": (maxmin_medoid, None),
    "diverse_selection": (diverse_selection, None),
    "kept_redundancy": (kept_redundancy, KEPT),
    "assignment": (assignment, None),
    "greedy_pack": (greedy_pack, GREEDY),
    "assignment_audit": (assignment_audit, f"""with {CTES["words"]}, {CTES["catalog"]}, parts as (select doc, segment, min(word_idx) f, max(word_idx) l, max("end") e, min(start) s, doc * 3 + segment k from words group by 1, 2),
  entries as (select doc, case when k % 37 = 8 then 900 else segment end segment, p, case when k % 23 = 5 and p = 1 then null when k % 29 = 6 then (9000000 + k)::varchar else ((k * 2 + case when k % 31 = 7 then 0 else p end) % 150 + 1)::varchar end clip,
    case when p = 0 then f + (k % 17 = 1)::int else (f + l) // 2 + 1 + (k % 13 = 2)::int end a, case when p = 0 then (f + l) // 2 else l + case when k % 19 = 3 then 1 when k % 11 = 4 then -1 else 0 end end z, case when k % 41 = 9 then -0.5 else 0.5 end trim, least((e - s) / 2, 4.0) span
    from (select *, unnest([0, 1]) p from parts where not (doc % 7 = 3 and segment = 1) and l > f)),
  rows_ as (select e.*, case when length(clip) < 4 then lpad(clip, 4, '0') else clip end id, lag(z) over (partition by e.doc, e.segment order by p) prev, lead(p) over (partition by e.doc, e.segment order by p) is null final from entries e),
  joined as (select r.*, row_number() over (partition by r.doc, id order by r.segment, p) turn, b.f, b.l, n, (select max(duration_sec) from catalog where clip_id = id) dur from rows_ r left join parts b on b.doc = r.doc and b.segment = r.segment left join (select doc, count(*) n from words group by 1) c on c.doc = r.doc),
  found as (select doc, segment, p::bigint place, unnest([case when f is null then 'unknown_segment' end, case when a < 0 or z >= n or a > z then 'index_out_of_bounds' end, case when a <> coalesce(prev + 1, f) then 'gap' end, case when final and z <> l then 'short_of_segment' end, case when id is null then 'no_clip' end,
    case when id is not null and dur is null then 'unknown_clip' end, case when id is not null and turn > 1 then 'repeated_clip' end, case when trim < 0 then 'negative_trim' end, case when dur - trim + 0.05 < span then 'too_short' end]) violation from joined)
  select * from found where violation is not null union all select doc, segment, null, 'missing_segment' from parts where not exists(select 1 from entries e where e.doc = parts.doc and e.segment = parts.segment)"""),
}
