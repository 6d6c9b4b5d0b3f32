"""Rounding, order statistics, samples, allocations, tags, bridges and the metric index against plain Python."""

import collections
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import round_binary
from frameloom.operators import assignment as A
from frameloom.operators import selection as Q
from frameloom.operators import sequences as S
from frameloom.operators import vectors as V
from frameloom.plans.registry import QUERIES

# ---- rounding ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("places", [0, 3, 6])
def test_rounding_equals_the_languages_own(spark, places):
    rnd = np.random.default_rng(places)
    values = [2.675, 0.0005, 0.0015, 0.5, 1.5, 2.5, -2.675, -0.0005, 1e-300, 0.0, -0.0, 1e15 + 0.5, 9e15, 1e300, 5e-324, 0.1 + 0.2, float("inf"), float("-inf")]
    values += (rnd.random(120_000) * 10.0 ** rnd.integers(-6, 13, 120_000) * rnd.choice([-1, 1], 120_000)).tolist()
    values += (np.round(rnd.random(60_000) * 1000, places + 1)).tolist() + (rnd.integers(-(10**9), 10**9, 60_000) / 2 ** rnd.integers(1, 12, 60_000)).tolist()
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_binary(F.col("v"), places).alias("r")).collect()
    for r in found:
        want = r.v if math.isinf(r.v) else round(r.v, places)
        assert r.r == want and math.copysign(1, r.r) == math.copysign(1, want), r
    assert spark.createDataFrame([(None,)], "v double").select(round_binary(F.col("v"), 3).alias("r")).first().r is None


# ---- order statistics -------------------------------------------------------------------------------


def groups():
    rnd = random.Random(1)
    return {
        "one": [3.5], "two": [2.0, 1.0], "ten": [float(x) for x in range(10)], "eleven": [float(x * x) for x in range(11)], "same": [4.0] * 300,
        "ties": [float(rnd.randrange(5)) for _ in range(997)], "skewed": [2.0 ** rnd.randrange(-200, 200) for _ in range(1500)], None: [rnd.gauss(0, 1e6) for _ in range(2000)],
        "near": [1.0 + i * 2.0**-52 for i in range(700)], "nan": [float("nan"), 1.0, 2.0, None],
    }


@pytest.mark.parametrize(("few", "bins"), [(10_000, 64), (40, 8)])
def test_quantiles_by_the_exclusive_rule(spark, monkeypatch, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    data = groups()
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "g string, v double").repartition(4)
    points = {"median": (1, 2), "decile": (9, 10)}
    found = {r.g: r for r in Q.quantiles(df, "g", "v", points).collect()}
    assert set(found) == set(data)
    for g, values in data.items():
        values = [v for v in values if v is not None and not math.isnan(v)]
        assert found[g].n == len(values)
        for name, (i, m) in points.items():
            want = values[0] if len(values) == 1 else statistics.quantiles(values, n=m)[i - 1]
            assert found[g][name] == pytest.approx(want, rel=1e-12), (g, name)
        assert found[g].median == pytest.approx(statistics.median(values), rel=1e-12)


def test_order_statistics_beyond_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, v double")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 1)], "g string, rank int")
    assert sorted(map(tuple, Q.order_statistics(df, "g", "v", asked).collect())) == [("a", 1, 1.0), ("a", 2, 3.0)]


# ---- samples ----------------------------------------------------------------------------------------


def test_stratified_sample_is_drawn_by_hash(spark):
    rows = [(f"s{min(i % 7, i % 3)}", f"c{i:03d}") for i in range(400)]
    df = spark.createDataFrame(rows, "stratum string, id string").repartition(5)
    found = collections.defaultdict(list)
    for r in Q.stratified_sample(df, "stratum", "id", 60, 50, 3).orderBy("turn").collect():
        found[r.stratum].append(r.id)
    for stratum in {s for s, _ in rows}:
        own = sorted((hashlib.md5(f"3:{stratum}:{i}".encode()).hexdigest(), i) for s, i in rows if s == stratum)
        assert found[stratum] == [i for _, i in own[: len(found[stratum])]] and found[stratum]
    assert sum(map(len, found.values())) == 60
    assert Q.stratified_sample(df.where("id < 'c050'"), "stratum", "id", 60, 50, 3).count() == 50


# ---- words to segments ------------------------------------------------------------------------------


def test_words_are_allocated_by_count_or_by_characters(spark):
    rnd = random.Random(3)
    words, segments, batches, want = [], [], [], {}
    for doc in range(60):
        offset, segment = 0.0, 0
        for batch in range(rnd.randrange(1, 4)):
            n, t, timed = rnd.choice([0, 1, 5, 12]), 0.0, []
            for _ in range(n):
                start = t + rnd.random() / 3
                t = start + rnd.random()
                timed.append((start, t))
            words += [(doc, batch, i * 2, a, z) for i, (a, z) in enumerate(timed)]
            duration, silence = t + 0.1, rnd.choice([0.5, 0.25])
            batches.append((doc, batch, duration, silence))
            own = [(segment + i, rnd.choice([None, "", "ab", " long text with words "]), rnd.randrange(0, 4)) for i in range(rnd.randrange(1, 4))]
            if rnd.random() < 0.6 and n:  # as many declared as timed
                own[-1] = (own[-1][0], own[-1][1], max(0, n - sum(c for _, _, c in own[:-1])))
            segments += [(doc, batch, s, c, x) for s, x, c in own]
            moved = [(round(a + offset, 3), round(z + offset, 3)) for a, z in timed]
            chars, at, seen = [max(1, len((x or "").strip(" "))) for _, x, _ in own], 0, 0
            exact = sum(c for *_, c in own) == n > 0
            for i, (s, _, c) in enumerate(own):
                seen += chars[i]
                to = at + c if exact else n if i + 1 == len(own) else min(n, round(n * seen / sum(chars)))
                span = moved[at:to]
                a, z = (span[0][0], span[-1][1]) if span else (offset, offset)
                want[doc, s] = (round(a, 3), round(z, 3), len(span), round(round(z, 3) - round(a, 3), 3) if span else 0.0)
                at = to
            segment += len(own)
            offset += duration + silence
    found = S.allocate_words(
        spark.createDataFrame(words, "doc long, batch long, word_idx int, start double, end double"),
        spark.createDataFrame(segments, "doc long, batch long, segment int, word_count int, text string"),
        spark.createDataFrame(batches, "doc long, batch long, duration double, silence double"),
    )
    got = {(r.doc, r.segment): (r.start, r.end, r.word_count, r.duration) for r in found.collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1.1e-3) and got[key][2] == row[2], key  # sums of offsets may differ in the last bit


# ---- tags -------------------------------------------------------------------------------------------


def said(text):
    words, letters, depth = [], [], 0

    def flush():
        if letters:
            words.append((letters[0][0], letters[-1][0], "".join(c for _, c in letters)))
            letters.clear()

    for i, c in enumerate(text):
        if c == "<":
            flush()
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth and c.isspace():
            flush()
        elif not depth:
            letters.append((i, c))
    flush()
    return words


def test_words_beside_tags(spark):
    rnd = random.Random(9)
    texts = ["a<b <c> d>e f", "> x", "<never closed a b", "a<b>c<d>e", "<<a>>b>", ""] + ["".join(rnd.choice("ab <>\n") for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame([(i, p, c) for i, t in enumerate(texts) for p, c in enumerate(t)], "doc long, pos int, c string").repartition(3)
    found = collections.defaultdict(list)
    for r in S.spoken_words(df, ["doc"]).orderBy("first_pos").collect():
        found[r.doc].append((r.first_pos, r.last_pos, r.word))
    assert all(found[i] == said(t) for i, t in enumerate(texts))


# ---- bridges ----------------------------------------------------------------------------------------


def test_bridges_get_as_much_of_the_pool_as_they_need(spark):
    rnd = random.Random(4)
    clips = [(p, f"{p}{i:03d}", float(rnd.randrange(0, 30)) / 4) for p in range(3) for i in range(4 if p == 2 else 80)]
    entries = []
    for doc in range(40):
        t = 0.0
        for segment in range(rnd.randrange(1, 9)):
            place = doc % 3
            end = t + rnd.randrange(1, 40) / 4
            entries.append((doc, place, segment, rnd.choice([c for p, c, _ in clips if p == place]), t, rnd.choice([0.0, 1.0, 4.0]), 0.5, end))
            t = end
    e = spark.createDataFrame(entries, "doc long, place int, segment int, clip_id string, start double, source double, trim double, display_end double")
    c = spark.createDataFrame(clips, "place int, clip_id string, duration double")
    pools = A.bridge_pools(e, c).groupBy("doc").count().collect()
    assert min(r["count"] for r in pools) < 76  # a prefix, not the place
    want = []
    for doc in range(40):
        own = [x for x in entries if x[0] == doc and x[5] > 0]
        pool = sorted(((-d, i) for p, i, d in clips if p == doc % 3 and d > 0 and i not in {x[3] for x in own}))
        for _, _, segment, _, start, source, trim, end in own:
            cursor = start + max(source - trim, 0.0)
            while end - cursor > 0.05:
                if not pool:
                    want.append((doc, segment, None, cursor, end - cursor))
                    break
                d, i = pool.pop(0)
                use = min(end - cursor, -d)
                want.append((doc, segment, i, cursor, use))
                cursor += use
    assert sorted(map(tuple, A.bridge_fill(e, c).collect()), key=repr) == sorted(want, key=repr) and any(w[2] is None for w in want)


def test_bridges_of_documents_in_buckets(spark):
    """Buckets share a prefix of their place's clips; how documents are dealt to them changes nothing, nor do places unknown or without clips."""
    entries = [(d, None if d == 90 else d % 4, s, f"{d % 4}{(d * 3 + s) % 50:03d}", 3.0 * s, 1.0, 0.5, 3.0 * s + 3) for d in range(91) for s in range(3)]
    e = spark.createDataFrame(entries, "doc long, place int, segment int, clip_id string, start double, source double, trim double, display_end double")
    c = spark.createDataFrame([(p, f"{p}{i:03d}", (i * 7 % 11) / 4) for p in range(3) for i in range(50)], "place int, clip_id string, duration double")
    whole = sorted(map(tuple, A.bridge_fill(e, c).collect()), key=repr)
    assert whole == sorted(map(tuple, A.bridge_fill(e, c, docs=4).collect()), key=repr) and {r[0] for r in whole if r[2] is None} == {90, *range(3, 90, 4)}
    _, bounds, prefix = A.bridge_buckets(e, c, docs=10_000)
    assert prefix.count() <= 3 * 50 < A.bridge_pools(e, c).count() and bounds.count() == 68


# ---- the metric index -------------------------------------------------------------------------------


@pytest.mark.parametrize(("pivots", "rows", "least"), [(1, 4096, 0.85), (40, 16, 0.85), (25, 30, 0.2), (9, 50, 1.0)])
def test_near_pairs_by_a_metric_index(spark, monkeypatch, pivots, rows, least):
    monkeypatch.setattr(V, "ROWS", rows)
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 16)) * 0.25, np.zeros((2, 16)), np.tile(centres[:1], (3, 1))])
    data = [(int(i % 2), int(i), v[i].tolist()) for i in range(len(v))] + [(0, 9000, None), (1, 9001, [1.0])]
    df = spark.createDataFrame(data, "g int, vec_id long, v array<double>").repartition(5)
    found = {(r.g, r.a, r.b): r.score for r in V.near_dup_pairs(df, "g", least, pivots).collect()}
    unit = v / np.where((n := np.linalg.norm(v, axis=1)) > 0, n, 1)[:, None]
    cos = unit @ unit.T
    sure = {(a % 2, a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if (a - b) % 2 == 0 and cos[a, b] >= least + 1e-9 and n[a] and n[b]}
    maybe = {(a % 2, a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if (a - b) % 2 == 0 and cos[a, b] >= least - 1e-9}
    assert sure <= set(found) <= maybe and all(found[k] == pytest.approx(cos[k[1], k[2]], abs=1e-9) for k in found)


def test_near_pairs_with_tasks_of_their_own(spark):
    """Blocks meet also where shuffle partitions are not merged into one, as they are for small tables."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(20, 8)), 10, axis=0) + rng.normal(size=(200, 8)) * 0.1
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "g int, vec_id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a % 2, a, b) for a in range(200) for b in range(a + 2, 200, 2) if unit[a] @ unit[b] >= 0.9}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {(r.g, r.a, r.b) for r in V.near_dup_pairs(df, "g", 0.9).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == want and want


def test_near_pairs_are_taken_by_their_rounded_score(spark, tmp_path):
    """Scores of 0.2999996 and 0.2999994 to the first row: only the first rounds to the threshold."""
    v = [[1.0, 0.0], *([c, (1 - c * c) ** 0.5] for c in (0.2999996, 0.2999994))]
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted((r.a, r.b, r.score) for r in QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()) == [(0, 1, 0.3), (1, 2, 1.0)]
    assert QUERIES["diversity_metrics"](spark, str(tmp_path)).first().pairs == 1


def shuffled(spark, run):
    """Bytes that a call shuffles, and what it returns."""
    every = lambda: sum(x.totalShuffleWrite() for x in map(store.apply, range(store.size())))
    store = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before, out = every(), run()
    store = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return every() - before, out


def test_near_pairs_send_vectors_to_few_cells(spark, monkeypatch):
    """Where an index spares nothing, a vector goes to about as many cells as its group has blocks, and not to half of all."""
    monkeypatch.setattr(V, "ROWS", 200)
    v = np.random.default_rng(11).normal(size=(8000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i % 10, i, x.tolist()) for i, x in enumerate(v)], "g int, vec_id long, v array<float>").repartition(4)
    sent, found = shuffled(spark, lambda: V.near_dup_pairs(df, "g", 0.6).collect())
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    assert {(r.a, r.b) for r in found} == {(g + 10 * a, g + 10 * b) for g in range(10) for a, b in zip(*np.nonzero(np.triu(unit[g::10] @ unit[g::10].T >= 0.6, 1)), strict=True)}
    print(f"{sent} bytes shuffled, {v.nbytes} of vectors")
    assert sent < 12 * v.nbytes


def test_ranks_tie_at_twelve_places(spark):
    scored = spark.createDataFrame([(1, 5, 0.5 + 1e-15), (1, 3, 0.5), (1, 4, 0.5 - 1e-15), (1, 9, 0.6), (1, 1, 0.5 - 1e-9)], "query_id long, vec_id long, score double")
    assert [r.vec_id for r in V.rank_per_query(scored).orderBy("rank").collect()] == [9, 3, 4, 5, 1]


def test_all_scores_by_blocks(spark, monkeypatch):
    """The pairs and scores of ``scores``, with zero vectors, null components, other lengths, a null id and vectors that are null or empty."""
    rng = np.random.default_rng(8)
    v = [x.tolist() for x in rng.normal(size=(150, 5))] + [[0.0] * 5, [1.0, None, 2.0, 0.0, 1.0], None, [], [1.0, 2.0], [3.0, 4.0]]
    rows = spark.createDataFrame([*enumerate(v), (None, [1.0] * 5)], "vec_id long, v array<float>").repartition(3)
    queries = rows.where("vec_id % 3 = 0 or vec_id in (150, 151, 154)").select(F.col("vec_id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    known = rows.where("vec_id is not null")
    want = sorted(map(tuple, V.scores(queries, known).collect()))
    monkeypatch.setattr(V, "ROWS", 40)
    monkeypatch.setattr(V, "ASKED", 15)
    found = [tuple(r) for r in V.all_scores(queries, rows).collect()]
    assert sorted(r for r in found if r[1] is not None) == want and (150, 0, float("-inf")) in want and (154, 155, pytest.approx(11 / 125**0.5)) in want
    assert sum(r[1] is None for r in found) == len({r[0] for r in found if r[1] is not None} - {154})
    assert V.all_scores(queries, rows.where("false")).count() == V.all_scores(queries.where("false"), rows).count() == 0


def test_all_ranks_in_tasks_of_their_own(spark, monkeypatch, tmp_path):
    """The ranks of a window over ``all_scores``, with ties, a repeated id, zero vectors, null components, other lengths and null ids; no pair is shuffled."""
    rng = np.random.default_rng(8)
    v = [x.tolist() for x in rng.normal(size=(90, 5))] + [[0.0] * 5, [1.0, None, 2.0, 0.0, 1.0], None, [], [1.0, 2.0], [3.0, 4.0]]
    rows = spark.createDataFrame([*enumerate(v), *((i + 200, v[i]) for i in range(30)), (3, [1.0] * 5), (None, [1.0] * 5)], "vec_id long, v array<float>").repartition(3)
    queries = rows.where("vec_id % 3 = 0 or vec_id in (90, 91, 94)").select(F.col("vec_id").alias("query_id"), "v").withColumnRenamed("v", "q")
    order = [F.desc(F.round("score", 12)), F.col("vec_id").asc_nulls_last()]
    want = V.all_scores(queries, rows).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    want = sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in want.collect()), key=repr)
    for ranked in (700, 1, 1 << 24):
        monkeypatch.setattr(V, "RANKED", ranked)
        found = sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in V.all_ranks(queries, rows).collect()), key=repr)
        assert found == want and len({r[0] for r in found}) > 40
    assert V.all_ranks(queries, rows.where("false")).count() == V.all_ranks(queries.where("false"), rows).count() == 0
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(v[:40])], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = QUERIES["rank_per_query"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_cosine_scores_take_little_space(spark, tmp_path):
    """A row of the written result takes under seven bytes; in the order of ids its score alone takes eight."""
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(rng.normal(size=(8000, 64)))], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    QUERIES["cosine_scores"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400 * 8000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7 * 400 * 8000


def test_the_metric_index_spares_most_pairs_of_clusters(spark, monkeypatch):
    """Rows that meet in a cell, of all pairs: at 0.85 in 60 clusters under a tenth."""
    monkeypatch.setattr(V, "ROWS", 50)
    rng = np.random.default_rng(7)
    v = np.repeat(rng.normal(size=(60, 32)), 60, axis=0) + rng.normal(size=(3600, 32)) * 0.15
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "g int, vec_id long, v array<double>")
    reach = float(np.sqrt(2 - 2 * 0.85))
    placed = V.metric_cells(df, "g", V.pivots_of(df, 64), reach)
    cells = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"), F.max(F.when(F.col("home"), F.col("far"))).alias("radius"))
    kept = placed.join(cells, "cell").where(F.col("home") | (F.col("far") <= F.col("radius") + reach + V.SLACK)).groupBy("cell").agg(F.first("homes").alias("h"), F.count_if(~F.col("home")).alias("visitors"))
    pairs = sum(r.h * (r.h - 1) / 2 + r.h * r.visitors for r in kept.collect())
    share = pairs / (3600 * 3599 / 2)
    print(f"{share:.3f} of all pairs are compared")
    assert share < 0.1


def test_long_chains_of_near_rows_end(spark, monkeypatch):
    angles = np.arange(260) * 0.3
    df = spark.createDataFrame([(0, i, [float(np.cos(a)), float(np.sin(a))] if i < 12 else [0.0, 1.0, float(i)]) for i, a in enumerate(angles)], "g int, vec_id long, v array<double>").where("vec_id < 12")
    for fold in (0, 10**6):
        monkeypatch.setattr(V, "FOLD", fold)
        kept, near = [], 0
        for i in range(12):
            hit = any(np.cos(angles[i] - angles[k]) >= 0.9 for k in kept)
            near += hit
            kept += [] if hit else [i]
        r = V.kept_redundancy(df, "g", 0.9).collect()[0]
        assert (r.redundant, r.kept) == (near, len(kept))


@pytest.mark.parametrize(("first", "pairs"), [(30, 10**6), (60, 400)])
def test_redundancy_without_all_pairs(spark, monkeypatch, first, pairs):
    """Groups are settled by their first rows and what these keep: the same counts as row by row, and near pairs of few rows at a time."""
    monkeypatch.setattr(V, "FIRST", first, raising=False)
    monkeypatch.setattr(V, "MOST_PAIRS", pairs, raising=False)
    rng = np.random.default_rng(first)
    centres = rng.normal(size=(9, 6))
    data = {g: np.concatenate([centres[rng.integers(0, 9, n)] + rng.normal(size=(n, 6)) * 0.3, np.zeros((2, 6))]) for g, n in ((0, 400), (1, 90), (2, 1))}
    rows = [(g, int(i * 7 + g), x.tolist()) for g, v in data.items() for i, x in enumerate(v)] + [(1, 5000, None), (1, 5001, [1.0]), (4, 5002, None)]
    df = spark.createDataFrame(rows, "g int, vec_id long, v array<double>").repartition(3)
    seen, whole = [], V.near_dup_pairs
    monkeypatch.setattr(V, "near_dup_pairs", lambda some, *args: seen.append(some.count()) or whole(some, *args))
    found = {r.g: (r.redundant, r.kept) for r in V.kept_redundancy(df, "g", 0.6).collect()}
    want = {4: (0, 1)}
    for g, v in data.items():
        kept, near = [], 0
        for x in v:
            hit = any(x @ k >= 0.6 * np.linalg.norm(x) * np.linalg.norm(k) for k in kept) if x.any() else False
            near += hit
            kept += [] if hit or not x.any() else [x]
        want[g] = (near, len(v) - near + 2 * (g == 1))
    assert found == want and max(seen) < 250 and len(seen) > 1


def test_rounds_forget_the_estimates_of_their_plans(spark):
    """Joins multiply the estimated sizes of their sides; over rounds the digits of a checkpoint's estimate grew to millions."""
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    for _ in range(4):
        df = V._written(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", "x"))
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 and df.count() == 20


@pytest.mark.parametrize(("rows", "pivots", "medoid", "stop"), [(4096, 256, False, None), (9, 40, False, None), (9, 40, True, 0.6), (5, 1, True, None)])
def test_max_min_picks_by_blocks(spark, monkeypatch, rows, pivots, medoid, stop):
    monkeypatch.setattr(V, "ROWS", rows)
    rng = np.random.default_rng(rows)
    data = {g: np.concatenate([rng.normal(size=(n, 5)), np.tile(rng.normal(size=(1, 5)), (3, 1))]) for g, n in ((0, 60), (1, 37), (2, 1))}
    df = spark.createDataFrame([(g, int(i * 3 + g), x.tolist()) for g, v in data.items() for i, x in enumerate(v)], "g int, vec_id long, v array<double>").repartition(4)
    found = collections.defaultdict(list)
    for r in V.maxmin_select(df, "g", 9, medoid, stop, pivots).orderBy("pick").collect():
        found[r.g].append(r.vec_id)
    for g, v in data.items():
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        picks = [int(np.argmax(unit @ unit.sum(axis=0)))] if medoid else [0]
        while len(picks) < min(9, len(v)):
            most = (unit @ unit[picks].T).max(axis=1).round(12)
            most[picks] = np.inf
            if stop is not None and most.min() >= stop:
                break
            picks.append(int(np.argmin(most)))
        assert found[g] == [i * 3 + g for i in picks]
