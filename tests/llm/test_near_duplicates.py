"""Links of crowded groups, and near-duplicates among groups of variants, against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from frameloom.llm import common, simhash
from frameloom.llm.components import components


def shared(spark):
    return common.shared_dir(spark, "test")


@pytest.mark.parametrize(("group", "n"), [(600, 290), (600, 320), (600, 640), (600, 1000), (600, 2500)])
def test_crowded_keys_told_by_a_sample_keep_their_links(spark, monkeypatch, group, n):
    """One key of n fingerprints, half of them at 4 bits of the other half; keys are told to be crowded by every second fingerprint."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(n)
    low = 22 + 11  # the first two bands are the same for all
    values = []
    for _ in range(n // 2):
        base = rnd.getrandbits(64 - 22) << 22 | 0x155
        values += [base, base ^ sum(1 << b for b in rnd.sample(range(low, 64), 4))]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    keyed = spark.createDataFrame([(7, v) for v in set(signed)], "key long, fp long")
    links = simhash._dealt(keyed, shared(spark)).mapInArrow(simhash._join_groups(simhash.trie_join), "u long, v long")
    found = {r.node: r.component for r in components(links, shared(spark)).collect()}
    assert group // 300 == 2
    assert all(found.get(a, a) == found.get(b, b) for a, b in zip(signed[::2], signed[1::2], strict=True))


def words_of(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def shingles(w):
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def truth(texts):
    """Pairs by similarity, and the component of each text by links of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    near = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    pairs = {(i, j): similarity(sets[i], sets[j]) for i, j in near}
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, j), s in pairs.items():
        if s >= 0.8:
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return {k: s for k, s in pairs.items() if s >= 0.8}, [find(i) for i in range(len(texts))]


def measured(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.similar(df, shared(spark)).collect()}
    pairs, label = truth(texts)
    assert all(label[i] == label[c] for i, c in found.items())  # nothing is joined that true links don't join
    joined = [found[i] == found[j] for i, j in pairs]
    high = [found[i] == found[j] for (i, j), s in pairs.items() if s >= 0.9]
    gone = [found[i] != i for i in range(len(texts)) if label[i] != i]
    return np.mean(joined), np.mean(high) if high else 1.0, np.mean(gone), len(pairs)


def variants(rnd, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(1, most)):
            w[rnd.randrange(len(w))] = f"new{rnd.random()}"
        out.append(w)
    return out


def test_recall_in_groups_of_variants(spark):
    """60 groups of 12 variants; pairs from far below the threshold to nearly the same."""
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        base = words_of(rnd, rnd.randrange(150, 500))
        texts += variants(rnd, base, 12, max(3, len(base) // 25))
    joined, high, gone, n = measured(spark, texts)
    print(f"joined {joined:.3f} of {n} pairs, {high:.3f} at 0.9 or more, {gone:.3f} of the documents that should go")
    assert n > 500 and joined >= 0.9 and high >= 0.97 and gone >= 0.9


@pytest.mark.parametrize("cluster", [48])
def test_recall_in_a_crowd(spark, monkeypatch, cluster):
    """400 variants of one text, most of which are linked by the text alone, beside others."""
    monkeypatch.setattr(simhash, "CLUSTER", cluster)
    rnd = random.Random(6)
    base = words_of(rnd, 300)
    texts = [words_of(rnd, 200) for _ in range(100)] + variants(rnd, base, 200, 8) + [base] + variants(rnd, base, 200, 8)
    joined, high, gone, n = measured(spark, texts)
    print(f"joined {joined:.3f} of {n} pairs, {gone:.3f} gone")
    assert n > 1000 and joined >= 0.9 and gone >= 0.9


@pytest.mark.parametrize("seed", range(3))
def test_between_gives_the_nearest_of_the_nearest_components(seed):
    rnd = random.Random(seed)
    centre = rnd.getrandbits(64)
    fp = np.array(sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))) for _ in range(120)} | {rnd.getrandbits(64) for _ in range(40)}), np.uint64)
    group = np.sort(np.random.default_rng(seed).integers(0, 2, len(fp)))
    order = np.lexsort((fp, group))
    fp, group = fp[order], group[order]
    component = np.array([rnd.randrange(30) for _ in fp])
    for most in (1, 3, 1000):
        x, y = simhash.between(group, fp, fp, component, most)
        found = collections.defaultdict(set)
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            found[a].add(int(np.bitwise_count(fp[a] ^ fp[b])))
            assert group[a] == group[b] and component[a] != component[b]
        for a in range(len(fp)):
            best = collections.defaultdict(lambda: 99)
            for b in range(len(fp)):
                if group[a] == group[b] and component[a] != component[b]:
                    best[component[b]] = min(best[component[b]], int(np.bitwise_count(fp[a] ^ fp[b])))
            want = sorted(v for v in best.values() if v <= simhash.WIDE_BUDGET)[:most]
            assert sorted(found[a]) == sorted(set(want)) and np.sum(x == a) == len(want)


def candidates(texts):
    """Pairs within the budgets that share a sample of bits, which are all that the stage may compare."""
    fp, other = np.array([simhash.two_fingerprints(" ".join(t), 5) for t in texts], np.uint64).T
    masks = simhash.bit_samples(len(set(fp.tolist()))).view(np.uint64)
    apart = fp[:, None] ^ fp
    met = np.zeros(apart.shape, bool)
    for m in masks:
        met |= apart & m == 0
    return met & (np.bitwise_count(apart) <= simhash.WIDE_BUDGET) & (np.bitwise_count(other[:, None] ^ other) <= simhash.SECOND)


@pytest.mark.parametrize(("group", "cells"), [(20_000, 1 << 21), (300, 1000)])
def test_no_candidate_of_a_crowd_is_given_up(spark, monkeypatch, group, cells):
    """700 variants that are near in bits and mostly under 0.8, and pairs among them that are just over: every link joins."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "CELLS", cells, raising=False)
    monkeypatch.setattr(simhash, "VALUES", cells, raising=False)
    rnd = random.Random(8)
    base = words_of(rnd, 400)
    texts = []
    for _ in range(600):
        w = list(base)
        for k in range(7):
            w[57 * k + rnd.randrange(50)] = f"new{rnd.random()}"
        texts.append(w)
    for origin in texts[:100]:
        w = list(origin)
        for k in range(8):
            w[50 * k + rnd.randrange(40)] = f"new{rnd.random()}"
        texts.append(w)
    rnd.shuffle(texts)
    sets, near = [shingles(t) for t in texts], candidates(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near[i, j] and similarity(sets[i], sets[j]) >= 0.8]
    label = simhash.least_labels(len(texts), *np.array(links).T, np.arange(len(texts)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.similar(df, shared(spark)).collect()}
    print(f"{near.sum() // 2} candidates, {len(links)} links, {len(set(label.tolist()))} components, {len(set(found.values()))} found")
    assert near.sum() > 20_000 and len(set(label.tolist())) > 50 and found == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_links_of_one_crowd_join_what_all_pairs_join(seed):
    """A group of fingerprints around one with random sets, against all pairs of it, with pairs of earlier samples left out."""
    rnd = np.random.default_rng(seed)
    n, least = 150, 0.8
    fp, other = (np.array([sum(1 << b for b in rnd.choice(64, 6, replace=False).tolist()) for _ in range(n)], np.uint64) for _ in range(2))
    origins = [rnd.choice(100_000, 40, replace=False) for _ in range(30)]
    sets = [np.unique(np.r_[o[rnd.random(40) < 0.95], rnd.choice(100_000, rnd.integers(3))]).astype(np.int32) for o in (origins[k] for k in rnd.integers(0, 30, n))]
    label = rnd.integers(0, 100, n)
    masks = np.array([0b1111 << 20, 0b1111 << 40], np.uint64)
    ends = np.r_[0, np.cumsum([len(x) for x in sets])]
    x, y = simhash.crowd_links(fp, other, label, masks, np.concatenate(sets), ends, least)
    apart = fp[:, None] ^ fp
    near = (np.bitwise_count(apart) <= simhash.WIDE_BUDGET) & (np.bitwise_count(other[:, None] ^ other) <= simhash.SECOND)
    near &= (apart & masks[0] != 0) & (apart & masks[1] != 0)
    score = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    start = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    i, j = np.nonzero(near & (score >= least))
    assert (score[x, y] >= least).all() and len(i) > 20
    # Nearest first may link pairs that earlier samples hold as well; nothing else is joined beside what all pairs join.
    every = np.nonzero((np.bitwise_count(apart) <= simhash.WIDE_BUDGET) & (np.bitwise_count(other[:, None] ^ other) <= simhash.SECOND) & (score >= least))
    mine, wide = simhash.least_labels(n, x, y, start), simhash.least_labels(n, *every, start)
    assert (mine[i] == mine[j]).all() and (wide == wide[mine]).all()


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    from frameloom.llm import components as C

    monkeypatch.setattr(C, "FEW", few)
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(-5, 3), (3, -5), (9, 9)]
    rnd.shuffle(links)
    found = {r.node: r.component for r in C.components(spark.createDataFrame(links, "u long, v long").repartition(3), shared(spark)).collect()}
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {x: c for x, c in label.items() if x != c}
    assert C.components(spark.createDataFrame([], "u long, v long"), shared(spark)).isEmpty()


def test_rows_of_a_cluster_grow_with_its_texts(spark):
    """40 fingerprints within few bits, in two groups alike: a row each leaves each group, not a row for each pair."""
    rnd = random.Random(11)
    fp = np.array(sorted({sum(1 << b for b in rnd.sample(range(64), 3)) for _ in range(40)}), np.uint64).view(np.int64)
    n = len(fp)
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 2], n)), pa.array(np.r_[fp, fp]), pa.array(np.r_[fp, fp])], names=["key", "fp", "other"])
    rows = pa.Table.from_batches(simhash._join_wide([batch])).to_pylist()
    assert len(rows) == 2 * n and len({r["cluster"] for r in rows}) == 1 and {r["u"] for r in rows} == set(fp.tolist())
    for r in rows:
        assert r["bits"] == bin((r["u"] ^ r["v"]) % (1 << 64)).count("1") == min(bin((r["u"] ^ x) % (1 << 64)).count("1") for x in fp.tolist() if x != r["u"])


def test_no_link_of_small_clusters_is_given_up(spark):
    """40 groups of 20 variants that are mostly under 0.8 and some just over: every candidate link joins."""
    rnd = random.Random(12)
    texts = []
    for _ in range(40):
        base = words_of(rnd, 300)
        for k in range(20):
            w = list(texts[-1]) if k % 4 == 3 else list(base)
            for j in range(6):
                w[50 * j + rnd.randrange(40)] = f"new{rnd.random()}"
            texts.append(w)
    sets, near = [shingles(t) for t in texts], candidates(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near[i, j] and similarity(sets[i], sets[j]) >= 0.8]
    label = simhash.least_labels(len(texts), *np.array(links).T, np.arange(len(texts)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.similar(df, shared(spark)).collect()}
    print(f"{near.sum() // 2} candidates, {len(links)} links, {len(set(label.tolist()))} components, {len(set(found.values()))} found")
    assert near.sum() > 4000 and found == dict(enumerate(label.tolist()))


def test_texts_of_one_fingerprint_are_all_compared(spark):
    """Three contents have the same fingerprint; the last two are alike, and only they. A pair that was tried is left out."""
    nodes = spark.createDataFrame([(1, 5, 5, None), (2, 5, 5, None), (3, 5, 5, None), (4, 9, 9, None), (6, 8, 8, None)], "node long, fp long, other long, component long")
    members = spark.createDataFrame([(70, 5), (71, 9), (71, 8)], "cluster long, fp long")
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [5, 6, 7]), (3, [5, 6, 7]), (4, [8, 9]), (6, [8, 9])], "node long, s array<int>")
    tried = spark.createDataFrame([(4, 6), (1, 2), (1, 3)], "a long, b long")
    found = simhash._cluster_links(members, nodes, tried, sets, simhash.bit_samples(100), 0.8, shared(spark)).collect()
    assert [(r.a, r.b) for r in found] == [(2, 3)]
