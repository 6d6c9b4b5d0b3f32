"""Media-library tables, read as Parquet or derived from the general tables of a folder.

A catalog clip is a part, its place the brand; a ledger event is an event, its place the user; a
narration segment is a conversation turn. What a general table lacks (sizes, trims, word times) is
computed from its keys, so every derived table is the same on each read. Each function has a
counterpart in SQL of the same name in ``CTES``, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import py_zfill


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a clip: ids, analysis fields, size, duration, use."""
    k = F.col("p_partkey")
    width = F.lit(640) + F.pmod(k * 37, F.lit(480))
    return table(spark, sf_dir, "part").select(
        k.alias("vec_id"),
        F.concat(F.lit("poi_b"), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("poi_id"),
        F.concat(F.lit("asset_"), k).alias("asset_id"),
        py_zfill(k, 4).alias("clip_id"),
        F.col("p_name").alias("scene_description"),
        F.when(F.pmod(k, F.lit(29)) == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"),
        (F.col("p_size") / 4.0).alias("duration_sec"),
        width.cast("int").alias("width"),
        F.floor(width * (F.lit(16) + F.pmod(k, F.lit(4))) / 10).cast("int").alias("height"),
        F.pmod(k, F.lit(7)).cast("int").alias("usage_count"),
        F.when(F.pmod(k, F.lit(17)) == 0, "archived").otherwise("active").alias("status"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a use of an asset: who, when, and which part of the source was shown."""
    e = F.col("event_id")
    start = F.pmod(F.floor(F.col("value") * 7), F.lit(60)).cast("double")
    shown = F.pmod(F.floor(F.col("value")), F.lit(5)) + 1
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"),
        F.concat(F.lit("poi_u"), F.col("user_id")).alias("poi_id"),
        F.concat(F.lit("asset_"), F.pmod(e, F.lit(1999))).alias("asset_id"),
        F.concat(F.when(F.pmod(e, F.lit(5)) == 0, "pgcXrun_").otherwise("pgc_run_"), F.pmod(e, F.lit(40))).alias("run_id"),
        F.concat(F.lit("man_"), F.pmod(e, F.lit(97))).alias("manifest_id"),
        F.when(F.pmod(e, F.lit(23)) == 0, None).otherwise(F.col("event_type")).alias("usage_role"),
        F.col("ts").alias("created_at"),
        F.when(F.pmod(e, F.lit(31)) == 0, "bad").otherwise((start - 2).cast("string")).alias("trim_start_sec"),
        F.lit(1.0).alias("display_start_sec"),
        (F.lit(1.0) + shown).cast("double").alias("display_end_sec"),
        F.lit(60.0).alias("source_duration_sec"),
        F.col("value"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a narration segment."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("segment"), "role", "text", (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))).cast("int").alias("pause_weight"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a spoken word: its place in the document and its times on a grid of 10 ms."""
    s = segments(spark, sf_dir)
    tokens = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    flat = s.select("doc", "segment", F.posexplode(tokens).alias("n", "word"))
    # A document's turns are few; its words are numbered by the words of the turns before.
    from pyspark.sql import Window

    before = s.select("doc", "segment", F.size(tokens).alias("size")).withColumn("base", F.coalesce(F.sum("size").over(Window.partitionBy("doc").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    at = (F.col("base") + F.col("n")).cast("int")
    tick = at * 35 + F.col("segment") * 60
    return flat.join(before, ["doc", "segment"]).select("doc", F.col("segment"), at.alias("word_idx"), "word", (tick / 100).alias("start"), ((tick + 30) / 100).alias("end"))


#: The same tables for DuckDB, by name.
CTES = {
    "catalog": """catalog as (select p_partkey vec_id, 'poi_b' || regexp_extract(p_brand, '([0-9]+)', 1) poi_id, 'asset_' || p_partkey asset_id,
  case when length(p_partkey::varchar) < 4 then lpad(p_partkey::varchar, 4, '0') else p_partkey::varchar end clip_id, p_name scene_description,
  case when p_partkey % 29 = 0 then '' else p_type end category, p_size / 4.0 duration_sec, (640 + (p_partkey * 37) % 480)::int width,
  floor((640 + (p_partkey * 37) % 480) * (16 + p_partkey % 4) / 10)::int height, (p_partkey % 7)::int usage_count,
  case when p_partkey % 17 = 0 then 'archived' else 'active' end status from part)""",
    "ledger": """ledger as (select event_id, 'poi_u' || user_id poi_id, 'asset_' || (event_id % 1999) asset_id,
  case when event_id % 5 = 0 then 'pgcXrun_' else 'pgc_run_' end || (event_id % 40) run_id, 'man_' || (event_id % 97) manifest_id,
  case when event_id % 23 = 0 then null else event_type end usage_role, ts created_at,
  case when event_id % 31 = 0 then 'bad' else ((floor(value * 7)::bigint % 60)::double - 2)::varchar end trim_start_sec, 1.0::double display_start_sec,
  (1.0 + floor(value)::bigint % 5 + 1)::double display_end_sec, 60.0::double source_duration_sec, value from events)""",
    "segments": "segments as (select conv_id doc, turn segment, role, text, ((conv_id + turn) % 4)::int pause_weight from conversations)",
    "words": """words as (select doc, segment, word_idx, word, (word_idx * 35 + segment * 60) / 100.0::double as start, (word_idx * 35 + segment * 60 + 30) / 100.0::double as "end" from (
  select doc, segment, word, (row_number() over (partition by doc order by segment, n) - 1)::int word_idx from (
    select conv_id doc, turn segment, unnest(w) word, generate_subscripts(w, 1) n from (select *, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') w from conversations))))""",
}
