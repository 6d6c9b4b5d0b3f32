"""Every reference query against its SQL over the smallest tables; the others against invariants."""

import numpy as np
import oracle
import pytest

from frameloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert not oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name])


def rows(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_beats_tile_each_document_within_the_ceiling(spark):
    found, words = rows(spark, "beats"), rows(spark, "word_ranges")
    for doc, beats in found.sort_values("beat").groupby("doc"):
        assert beats["first_word"].tolist() == [0, *(beats["last_word"] + 1).tolist()[:-1]]
        assert beats["last_word"].max() == words[words["doc"] == doc]["last_word"].max()


def test_beat_budget_is_kept_or_refused(spark):
    found, words = rows(spark, "beat_budget"), rows(spark, "word_ranges")
    planned = found[found["status"] == "ok"].groupby("doc").size()
    assert (planned <= 12).all() and set(found["doc"]) == set(words["doc"])


def test_caption_phrases_tile_and_stay_short(spark):
    for _, p in rows(spark, "caption_phrases").sort_values("phrase").groupby("doc"):
        assert p["first_word"].tolist() == [0, *(p["last_word"] + 1).tolist()[:-1]]
        assert (p["last_word"] - p["first_word"] < 8).all()


@pytest.mark.parametrize("name", ["assignment", "greedy_pack"])
def test_assignment_covers_spans_with_distinct_clips(spark, name):
    found = rows(spark, name)
    found = found[found["status"] == "ok"]
    assert len(found) and (found["trim_start"] >= 0).all() and (found["vec_id"] % 20 != 0).all()
    assert not found.duplicated(["video", "vec_id"]).any()


def test_diverse_selection_has_distinct_picks(spark):
    for name in ("maxmin_select", "maxmin_medoid", "diverse_selection"):
        found = rows(spark, name)
        assert len(found) and not found.duplicated(["label", "vec_id"]).any()


def test_kept_redundancy_counts_every_row(spark):
    assert rows(spark, "kept_redundancy")[["redundant", "kept"]].sum().sum() == 500


def test_bridges_fill_their_gaps(spark):
    found = rows(spark, "bridge_fill")
    assert (found["used"] > 0).all() and not found.duplicated(["doc", "clip"]).any()


def test_pause_budget_stays_under_the_cap(spark):
    found = rows(spark, "pause_budget")
    assert found["pause_ms"].between(0, 3000).all() and (found["pause_ms"] > 0).any()


def test_manifest_audit_shuffles_each_list_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["manifest_audit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_rest_run(spark):
    picks = rows(spark, "select_places")
    assert picks["pick"].tolist() == list(range(1, len(picks) + 1)) and picks["cooldown"].is_monotonic_increasing and picks["poi_id"].is_unique
    eligible = rows(spark, "place_eligibility")
    assert set(picks["poi_id"]) <= set(eligible[eligible["reason"] == "eligible"]["poi_id"])
    assert not rows(spark, "spoken_numbers")["spoken"].str.contains(r"[0-9]|-").any()


def test_medoid_picks_against_brute_force(spark):
    v = {(r.label, r.vec_id): np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = rows(spark, "maxmin_medoid").sort_values("pick").groupby("label")["vec_id"].apply(list).to_dict()
    for label in {k for k, _ in v}:
        ids = sorted(i for k, i in v if k == label)
        unit = np.array([v[label, i] / np.linalg.norm(v[label, i]) for i in ids])
        picks = [int(np.argmax(unit @ unit.sum(axis=0)))]
        while len(picks) < min(10, len(ids)):
            most = (unit @ unit[picks].T).max(axis=1)
            most[picks] = np.inf
            if most.min() >= 0.9:
                break
            picks.append(int(np.argmin(most)))
        assert found[label] == [ids[p] for p in picks]
