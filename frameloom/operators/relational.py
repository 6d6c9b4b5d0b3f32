"""Catalog, ledger and audit operators: predicates, contracts, joins, roll-ups, idempotent writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- predicates and contracts -----------------------------------------------------------------


@dataclass(frozen=True)
class ResolutionPolicy:
    """best_available takes every size; min_width and width_band test the width, then the aspect."""

    mode: str = "best_available"
    width: int = 720
    tolerance: int = 40
    least_aspect: float = 1.70
    most_aspect: float = 1.86

    def __post_init__(self):
        if self.mode not in ("best_available", "min_width", "width_band"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.width <= 0 or self.tolerance < 0:
            raise ValueError("width must be positive, tolerance not negative")

    def predicate(self, width: Column, height: Column) -> Column:
        if self.mode == "best_available":
            return F.lit(True)
        fits = width >= self.width if self.mode == "min_width" else F.abs(width - self.width) <= self.tolerance
        aspect = height / F.nullif(width, F.lit(0))
        return F.coalesce((width > 0) & (height > 0) & fits & aspect.between(self.least_aspect, self.most_aspect), F.lit(False))


def violations(**rules: Column) -> Column:
    """Names of the rules that hold, a rule being true for a bad row; null counts as bad."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))


#: The bucket, and the forms of ids, hashes and paths.
BUCKET, HASH = "poi-assets", "^sha256:[0-9a-f]{64}$"
POI_ID, ASSET_ID, CLIP_ID, UUID = "^poi_[a-z0-9]+$", "^asset_[a-z0-9]+$", "^[0-9]{4}$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _not_positive(text: Column, kind: str = "double") -> Column:
    """Whether a value that may be missing is there but no positive number."""
    return text.isNotNull() & ~F.coalesce(text.cast("string").try_cast(kind) > 0, F.lit(False))


def row_contract(clips: DataFrame) -> DataFrame:
    """clips with the violations of the catalog's row contract: required texts, the forms of ids and hash, the bucket, the path that the ids give,
    the status (none counts as active), and numbers that are positive where they are there."""
    required = ("poi_id", "asset_id", "clip_id", "source_storage_bucket", "source_storage_path", "source_content_hash")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    path = F.col("source_storage_path")
    rules = {f"missing_{c}": blank(c) for c in required}
    rules |= {c: ~blank(c) & ~F.col(c).rlike(form) for c, form in (("poi_id", POI_ID), ("asset_id", ASSET_ID), ("clip_id", CLIP_ID), ("source_content_hash", HASH))}
    rules["bucket"] = ~blank("source_storage_bucket") & (F.col("source_storage_bucket") != BUCKET)
    rules["path_has_bucket"] = ~blank("source_storage_path") & path.startswith(f"{BUCKET}/")
    rules["path"] = ~blank("source_storage_path") & ~path.startswith(f"{BUCKET}/") & ~path.eqNullSafe(F.concat("poi_id", F.lit("/clips/"), "asset_id", F.lit(".mp4")))
    rules["status"] = F.col("status").isNotNull() & (F.col("status") != "active")
    rules |= {c: _not_positive(F.col(c)) for c in ("duration_sec", "fps")}
    rules |= {c: _not_positive(F.col(c), "bigint") for c in ("width", "height", "file_size_bytes")}
    return clips.withColumn("violations", violations(**{k: F.coalesce(bad, F.lit(False)) for k, bad in rules.items()}))


def music_contract(tracks: DataFrame, least: float) -> DataFrame:
    """tracks with violations: an id that is no UUID, a blank name or file, a length that is no positive number or below the least."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    seconds = F.col("duration_sec").cast("string").try_cast("double")
    bad = violations(id=~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), music_name=blank("music_name"), drive_file_id=blank("drive_file_id"), duration_sec=~F.coalesce(seconds > 0, F.lit(False)), short=F.coalesce((seconds > 0) & (seconds < least), F.lit(False)))
    return tracks.withColumn("violations", bad)


def assert_clean(checked: DataFrame) -> DataFrame:
    """The rows without violations, or an error that names the first bad ones when the plan runs."""
    bad = F.size("violations") > 0
    message = F.concat(F.lit("row contract: "), F.array_join("violations", ","))
    return checked.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).drop("violations")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error before planning where a column is missing; null values are fine."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


# ---- counts --------------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values with their number; null and empty count as unknown."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def duration_band(seconds: Column) -> Column:
    return F.when(seconds < 6, "<6s").when(seconds < 8, "6-8s").otherwise(">=8s")


def width_summary(clips: DataFrame) -> DataFrame:
    """Overlapping counters of widths in one row."""
    w = F.col("width")
    return clips.agg(
        F.count("*").alias("total"),
        F.count_if(w.isNull() | (w <= 0)).alias("unknown"),
        F.count_if(w.between(680, 760)).alias("around_720"),
        F.count_if(w.between(1040, 1120)).alias("around_1080"),
        F.count_if(w >= 720).alias("at_least_720"),
    )


# ---- place selection -------------------------------------------------------------------------------


def cooldown_set(ledger: DataFrame, cutoff: Column, prefix: str = "pgc_run_") -> DataFrame:
    """Places used by runs with the prefix since the cutoff. startswith is literal: no wildcard in the prefix matches."""
    return ledger.where((F.col("created_at") >= cutoff) & F.col("run_id").startswith(prefix)).select("poi_id").distinct()


def place_eligibility(clips: DataFrame, ready: DataFrame, claims: DataFrame, cooled: DataFrame, floor: int, policy: ResolutionPolicy, first_seen: list[str] | None = None, order: str = "clip_id") -> DataFrame:
    """Per place the counts, the widths of its fitting clips, attributes of its first clip in order, and the first reason that rules it out, or eligible; cooldown is a flag only."""
    active = clips.where(F.col("status") == "active").withColumn("fits", policy.predicate(F.col("width"), F.col("height")))
    marked = active.join(ready.select("asset_id", F.lit(True).alias("ready")), "asset_id", "left")
    w, fits = F.col("width"), F.col("fits")
    attributes = [F.min_by(c, order).alias(c) for c in first_seen or []]
    counts = marked.groupBy("poi_id").agg(
        F.countDistinct("asset_id").alias("active_assets"),
        F.countDistinct(F.when(fits, F.col("asset_id"))).alias("effective_assets"),
        F.countDistinct(F.when(fits & F.col("ready"), F.col("asset_id"))).alias("ready_assets"),
        F.count_if(fits).alias("fitting"),
        F.count_if(fits & (w.isNull() | (w <= 0))).alias("unknown_width"),
        F.count_if(fits & w.between(680, 760)).alias("around_720"),
        F.count_if(fits & w.between(1040, 1120)).alias("around_1080"),
        F.count_if(fits & (w >= 720)).alias("at_least_720"),
        *attributes,
    )
    flagged = counts.join(claims.select("poi_id", F.lit(True).alias("claimed")), "poi_id", "left").join(cooled.select("poi_id", F.lit(True).alias("cooled")), "poi_id", "left")
    short = "insufficient_candidate_ready_assets" if policy.mode == "best_available" else "insufficient_source_resolution_candidate_ready_assets"
    reason = (
        F.when(F.col("claimed"), "in_progress_lock")
        .when(F.col("active_assets") < floor, "insufficient_active_assets")
        .when(F.col("effective_assets") < floor, "insufficient_source_resolution_assets")
        .when(F.col("ready_assets") < floor, short)
        .otherwise("eligible")
    )
    return flagged.select(*counts.columns, reason.alias("reason"), F.coalesce("cooled", F.lit(False)).alias("cooldown"))


def active_claims(selections: DataFrame, receipts: DataFrame) -> DataFrame:
    """Places that a batch holds: until all its videos are complete, or if it has none. The first batch by name wins."""
    done = receipts.groupBy("batch").agg(F.bool_and(F.col("state") == "complete").alias("released"))
    held = selections.join(done, "batch", "left").where(~F.coalesce("released", F.lit(False)))
    return held.groupBy("poi_id").agg(F.min("batch").alias("batch"))


def select_places(eligible: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample without replacement: fresh places first, then cooled ones, each drawn by the hash of a seed of their own and the id."""
    draw = F.md5(F.concat(F.when(F.col("cooldown"), F.lit(f"{seed + 1}:")).otherwise(f"{seed}:"), F.col("poi_id")).cast("binary"))
    few = eligible.where(F.col("reason") == "eligible").withColumn("draw", draw).orderBy("cooldown", "draw", "poi_id").limit(n)
    picked = F.when(F.col("cooldown"), "cooled_fallback").otherwise("fresh")
    return few.select(F.row_number().over(Window.orderBy("cooldown", "draw", "poi_id")).alias("pick"), "poi_id", "cooldown", picked.alias("selected_as"))


# ---- joins and audits -------------------------------------------------------------------------------


def attach_vectors(meta: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """meta with a flag whether a usable vector exists; rows without are kept for the drop list."""
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(key, F.lit(True).alias("has_vector")).distinct()
    return meta.join(usable, key, "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))


def missing_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that are not known, each once."""
    return requested.select(key).distinct().join(known, key, "left_anti")


def reconcile(expected: DataFrame, observed: DataFrame, key: str, fields: list[str], blank_is_null: bool = False) -> DataFrame:
    """Rows (key, kind, field, expected, observed): missing keys, fields that differ as strings, duplicates observed."""
    text = (lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))) if blank_is_null else (lambda c: F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    e = expected.select(F.col(key), *(text(f).alias(f"e_{f}") for f in fields))
    o = observed.select(F.col(key), *(text(f).alias(f"o_{f}") for f in fields), F.lit(True).alias("seen"))
    both = e.join(o, key, "left")
    missing = both.where(F.col("seen").isNull()).select(key, F.lit("missing").alias("kind"), none.alias("field"), none.alias("expected"), none.alias("observed"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"o_{f}").alias("observed")) for f in fields))
    differing = both.where("seen").select(key, F.explode(F.filter(pairs, lambda p: ~p["expected"].eqNullSafe(p["observed"]))).alias("p"))
    mismatch = differing.select(key, F.lit("mismatch").alias("kind"), "p.field", "p.expected", "p.observed")
    twice = duplicates(observed, key).select(key, F.lit("duplicate").alias("kind"), none.alias("field"), none.alias("expected"), F.col("n").cast("string").alias("observed"))
    return missing.unionByName(mismatch).unionByName(twice)


def manifest_audit(manifests: DataFrame, outputs: DataFrame, assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Error rows (manifest_id, field, key) of manifests: their own texts, their lists, and what the lists' rows lack, repeat or refer to in vain.

    manifests: manifest_id, schema_version, run_id, poi_id, poi_name. outputs: manifest_id, n, variant, path, music_label. assets: manifest_id, n, asset_id.
    entries: manifest_id, n, variant, clip_id, occurrence_id, usage_role, segment, asset_id. n is a row's place in its list and the key of its
    errors; of repeated keys the first row by n is no error. References count only where there is something to refer to.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    number = F.col("variant").cast("string").try_cast("int")
    key = F.col("n").cast("string")

    def errors(rows: DataFrame, place: Column, rules: dict[str, Column]) -> DataFrame:
        names = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
        return rows.select("manifest_id", F.explode(names).alias("field"), place.alias("key"))

    none = F.lit(None).cast("string")
    good = F.coalesce(number > 0, F.lit(False))
    top = errors(manifests, none, {"schema_version": ~F.col("schema_version").eqNullSafe(F.lit(1)), "manifest_id": blank("manifest_id"), "run_id": blank("run_id"), "poi.poi_id": blank("poi_id"), "poi.display_name": blank("poi_name")})
    out = errors(outputs, key, {"outputs.variant_index": ~good, "outputs.output_path": blank("path"), "outputs.music_label": blank("music_label")})
    snapshot = errors(assets, key, {"asset_snapshot.asset_id": blank("asset_id")})
    timeline = errors(entries, key, {
        "timeline_entries.variant_index": ~good,
        "timeline_entries.clip_id": blank("clip_id"),
        "timeline_entries.occurrence_id": blank("occurrence_id"),
        "timeline_entries.usage_role": blank("usage_role"),
        "timeline_entries.segment": (F.col("usage_role") == "bridge_tail") & F.col("segment").isNotNull(),
        "timeline_entries.asset_id": blank("asset_id"),
    })

    # What rows are to each other: all lists' keys are shuffled once, by manifest, and the windows' groups lie within manifests.
    def listed(rows: DataFrame, kind: int, *own: str) -> DataFrame:
        fields = {"n": F.col("n"), "variant": F.when(good, number), "asset_id": F.when(~blank("asset_id"), F.col("asset_id").cast("string")), "occurrence_id": F.when(~blank("occurrence_id"), F.col("occurrence_id").cast("string"))}
        types = {"n": outputs.schema["n"].dataType, "variant": "int"}
        return rows.select("manifest_id", F.lit(kind).alias("kind"), *((fields[c] if c in own else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in fields))

    every = listed(manifests, 0).unionByName(listed(outputs, 1, "n", "variant")).unionByName(listed(assets, 2, "n", "asset_id")).unionByName(listed(entries, 3, "n", "variant", "asset_id", "occurrence_id"))
    every = every.repartition("manifest_id")
    for name, by, kind in (("made", "variant", 1), ("held", "asset_id", 2)):
        every = every.withColumn(f"again_{name}", F.row_number().over(Window.partitionBy("manifest_id", by, "kind").orderBy("n")) > 1)
        every = every.withColumn(name, F.max(F.col("kind") == kind).over(Window.partitionBy("manifest_id", by)))
    every = every.withColumn("again", F.row_number().over(Window.partitionBy("manifest_id", "occurrence_id", "kind").orderBy("n")) > 1)
    whole, named = Window.partitionBy("manifest_id"), F.col("manifest_id").isNotNull()
    some = lambda c: F.coalesce(F.max(c).over(whole), F.lit(False)) & named
    for name, c in {"outputs": F.col("kind") == 1, "assets": F.col("kind") == 2, "entries": F.col("kind") == 3, "any_made": (F.col("kind") == 1) & F.col("variant").isNotNull(), "any_held": (F.col("kind") == 2) & F.col("asset_id").isNotNull()}.items():
        every = every.withColumn(name, some(c))
    is_a, has = lambda kind: F.col("kind") == kind, lambda c: F.col(c).isNotNull()
    together = errors(every, key, {
        "outputs": is_a(0) & ~F.col("outputs"),
        "asset_snapshot": is_a(0) & ~F.col("assets"),
        "timeline_entries": is_a(0) & ~F.col("entries"),
        "outputs.variant_index.unique": is_a(1) & has("variant") & F.col("again_made"),
        "asset_snapshot.asset_id.unique": is_a(2) & has("asset_id") & F.col("again_held"),
        "timeline_entries.variant_index.reference": is_a(3) & has("variant") & F.col("any_made") & ~F.col("made"),
        "timeline_entries.occurrence_id.unique": is_a(3) & has("occurrence_id") & F.col("again"),
        "timeline_entries.asset_id.reference": is_a(3) & has("asset_id") & F.col("any_held") & ~F.col("held"),
    })
    return top.unionByName(out).unionByName(snapshot).unionByName(timeline).unionByName(together)


def orphans(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """Occurrences of entries without an output."""
    return entries.join(outputs.select("variant"), "variant", "left_anti").select(F.col("occurrence_id").alias("key"))


def receipt_summary(videos: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a batch's videos by the states of their steps; a video may count for several."""
    c, one = F.count_if, lambda name, *states: F.col(name).isin(*states)
    return videos.groupBy(*by).agg(
        F.count("*").alias("requested_videos"),
        c(F.coalesce(F.col("state").startswith("rendered"), F.lit(False)) | F.coalesce(F.col("return_code") == 0, F.lit(False))).alias("rendered_videos"),
        c(one("state", "render_failed")).alias("failed_videos"),
        c(one("manifest", "found")).alias("manifest_found_videos"),
        c(one("audit", "passed")).alias("manifest_audited_videos"),
        c(one("audit", "failed", "error")).alias("manifest_audit_failed_videos"),
        c(one("usage", "verified")).alias("usage_written_videos"),
        c(one("candidate", "verified")).alias("release_candidates_created"),
        c(one("upload", "verified", "verified_existing")).alias("drive_uploaded_videos"),
        c(one("upload", "failed")).alias("drive_upload_failed_videos"),
        c(one("upscale", "verified")).alias("final_upscaled_videos"),
        c(one("upscale", "failed")).alias("final_upscale_failed_videos"),
        c(one("usage", "failed", "verification_failed")).alias("usage_failed_videos"),
        c(one("candidate", "failed_retryable", "verification_failed")).alias("release_candidate_failed_videos"),
        c(one("state", "skipped_quarantined_poi")).alias("quarantined_skipped_videos"),
    )


def append_new(ledger: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """The events to append: one a key, and only keys that the ledger hasn't."""
    order = Window.partitionBy(key).orderBy(*[c for c in events.columns if c != key])
    once = events.withColumn("__turn", F.row_number().over(order)).where("__turn = 1").drop("__turn")
    return once.join(ledger.select(key), key, "left_anti")


def revert(ledger: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger without the manifests' events, and each asset's uses recounted from what remains."""
    rest = ledger.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_anti")
    return rest, rest.groupBy("asset_id").agg(F.count("*").alias("usage_count"))


def resume_action(state: Column) -> Column:
    return F.when(state.isin("complete", "skipped"), "skip").when(state.isin("rendered", "uploaded"), "tail").otherwise("render")


def latest_valid(docs: DataFrame, group: str, order: str, valid: Column) -> DataFrame:
    """Per group the newest row that is valid; invalid newer ones are passed over."""
    columns = [c for c in docs.columns if c != group]
    newest = docs.where(valid).groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("d"))
    return newest.select(group, *(f"d.{c}" for c in columns))
