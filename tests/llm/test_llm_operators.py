"""Each operator against brute force on a small corpus with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import oracle
import pytest
import xxhash

from frameloom.llm import ann, bpe, common, deal, kneser_ney, langid, licenses, packing, pii, quality, repeats, simhash
from frameloom.llm import registry as llm

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, n_words string, extra int"


def corpus():
    """Real documents, and the awkward ones: (doc_id, text, lang)."""
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by 1").fetchall()
    long = " ".join(t for _, t, _ in docs[:40]) * 3
    notice = "Copy of it: Licensed under CC BY-NC 4.0. ALL RIGHTS RESERVED all rights reserved."
    odd = [None, "", "   \n\t ", "x", long, docs[0][1], docs[0][1], docs[1][1][:80] + " new end", "a" * 3000, "la " * 900, notice, "Kontakt: an.na+x@mail7.example.com, 1.2.3.256, 10.0.0.255 or +1 (017) 555-7713 4539578763621486 é"]
    extra = [(10_000 + i, t, None) for i, t in enumerate(odd)]
    return docs + extra + [(10_005, docs[0][1], None), (None, docs[2][1], None), (None, None, "en")]


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, 0.5, "clash", 7) for i, t, lang in docs], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shared(spark, name="test"):
    return common.shared_dir(spark, name)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- op1 -------------------------------------------------------------------------------------------


def check_packing(pieces, ids, size):
    by_sequence, by_doc = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id] += p.length
        assert p.length > 0 and any(len(a) == p.doc_tokens and zlib.crc32(np.array(a[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for a in ids[p.doc_id])
    assert by_doc == {i: sum(map(len, a)) for i, a in ids.items()}
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total)


def token_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.defaultdict(list)
    for i, text, *_ in docs:
        ids[i].append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    return ids


@pytest.mark.parametrize(("size", "windows"), [(4096, 64), (64, 3)])
def test_packing_keeps_every_id_once(spark, frame, docs, size, windows):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_texts(frame, path, shared(spark), size=size, windows=windows).collect()
    assert check_packing(out, token_ids(docs), size) < (0.02 if size == 4096 else 0.2)


def test_packing_of_nothing(spark, empty):
    import public_tokenizers

    assert packing.pack_texts(empty, public_tokenizers.path("word_bpe_49k.json"), shared(spark)).count() == 0


def test_leftovers_end_in_powers_of_two():
    out = packing.fill([(0, 10), (1, 7), (2, 4)], 16)
    assert [sum(n for _, _, n in s) for s in out] == [16, 4, 1]
    assert [(i, a, n) for s in out for i, a, n in s] == [(0, 0, 10), (1, 0, 6), (1, 6, 1), (2, 0, 3), (2, 3, 1)]


# ---- op2 -------------------------------------------------------------------------------------------


def test_license_scan_base(frame, docs, empty):
    def expected(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})))

    out = licenses.scan(frame).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out if r.doc_id is not None) == sorted((i, *expected(t)) for i, t, _ in docs if i is not None) or {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == {(i, *expected(t)) for i, t, _ in docs}
    notice = next(r for r in out if r.doc_id == 10_010)
    assert notice.n_base == 3 and "cc-by-nc-4.0" in notice.labels and notice.score == 1.0
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert licenses.scan(empty).count() == 0


def test_license_words_alone_are_no_notice(spark):
    rows = [(1, "license apache version the licensed"), (2, "x y. Licensed under the Apache License, Version 2.0 z"), (3, "the Apache License, Version 2.0")]
    out = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "", 2: "apache-2.0", 3: ""}


NOTICE_BSD = next(notice for label, notice, _ in licenses.NOTICES if label == "bsd")


def test_license_notices_do_not_displace_each_other(spark):
    rows = [(k, f"a {NOTICE_BSD}. And {notice}; so it is") for k, (_, notice, _) in enumerate(licenses.NOTICES)]
    rows.append((100, " and ".join(notice for _, notice, _ in licenses.NOTICES)))
    out = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({"bsd", label} <= out[k] for k, (label, _, _) in enumerate(licenses.NOTICES))
    assert out[100] >= {label for label, _, _ in licenses.NOTICES}


def test_license_notices_hold_with_words_put_in_or_left_out(spark):
    bsd = next(n for label, n, _ in licenses.NOTICES if label == "bsd")
    moved = bsd.replace("redistribution and use", "redistribution and any use").replace("conditions are met", "conditions all are met")
    gpl = next(n for label, n, _ in licenses.NOTICES if label == "lgpl").split()
    rows = [moved, bsd.replace(" with or without", ""), " ".join(gpl[:3] + gpl[4:]), bsd.replace("source and binary", "source or binary"), "x y " + moved.upper() + " z", bsd.replace("source", "\u017fource").replace("binary", "bin"), bsd.replace("redistribution", " ".join("abcdefgh"))]
    found = [r.labels for r in licenses.scan(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert found == ["bsd", "bsd", "gpl,lgpl", "", "bsd", "", "bsd"]
    kelvin = next(n for label, n, _ in licenses.NOTICES if label == "mit" and "hereby" in n).replace("hereby granted free of charge", "hereby granted free of char\u212age")
    assert licenses.scan(spark.createDataFrame([(1, kelvin)], "doc_id long, text string")).first().labels == ""


def test_license_notices_hold_without_their_rarest_words(spark):
    cases = []
    for label, notice, key in licenses.NOTICES:
        w, start = notice.split(), len(notice[: notice.index(key)].split())
        lacking = max(m for m in range(len(w)) if (len(w) - m) / len(w) >= licenses.COVERED)
        free = [q for q in range(len(w)) if not start <= q < start + len(key.split())]
        free.sort(key=lambda q: (w[q] in licenses.COMMON, w[q]))  # licence words go first
        cases.append((label, " ".join("x" if q in free[:lacking] else x for q, x in enumerate(w))))
    out = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert all(label in out[k] for k, (label, _) in enumerate(cases))


# ---- op3 -------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_components(spark, frame, docs, empty):
    fp = [brute_fingerprint(t) for _, t, _ in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    expected = collections.Counter((i, fp[k] - (1 << 64) * (fp[k] >> 63), least.get(find(k))) for k, (i, *_) in enumerate(docs))
    out = collections.Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame, shared(spark)).collect())
    assert out == expected
    assert simhash.near_duplicates(empty, shared(spark)).count() == 0


def shingles(text, n=5):
    w = words(lower(text))
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else {""}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(text, rnd, share):
    """text with words replaced so that about that share of its 5-word shingles goes."""
    w = text.split()
    for _ in range(max(1, round(share * len(w) / 5))):
        w[rnd.randrange(len(w))] = f"new{rnd.random()}"
    return " ".join(w)


def test_similar_texts(spark, frame, docs, empty):
    kept = simhash.deduplicate(frame, shared(spark))
    assert kept.columns == frame.columns and simhash.deduplicate(empty, shared(spark)).count() == 0
    rows, out = [(i, t) for i, t, _ in docs], kept.collect()
    assert sum(r.doc_id is None for r in out) == sum(i is None for i, _ in rows)
    stay = {r.doc_id for r in out} - {None}
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for i in {i for i, _ in rows if i is not None} - stay:  # each has a similar text with another id
        assert all(any(similarity(x, y) >= 0.8 for j, ys in texts.items() if j is not None and j != i for y in ys) for x in texts[i])
    distinct = {i: texts[i][0] for i in stay if len(texts[i]) == 1}
    near = [(i, j) for i in distinct for j in distinct if i < j and similarity(distinct[i], distinct[j]) >= 0.9]
    assert not near


@pytest.mark.parametrize(("share", "least", "low", "high"), [(0.04, 0.9, 0.97, 1.0), (0.09, 0.8, 0.8, 1.0), (0.5, 0.0, 0.0, 0.0)])
def test_recall_of_similar_texts(spark, share, least, low, high):
    rnd = random.Random(8)
    base = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(rnd.randrange(200, 600))) for _ in range(150)]
    pairs = [(t, changed(t, rnd, share)) for t in base]
    rows = [(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)]
    stay = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), shared(spark)).collect()}
    wanted = [k for k, (a, b) in enumerate(pairs) if similarity(a, b) >= least]
    caught = [k for k in wanted if 2 * k + 1 not in stay]
    assert all(2 * k in stay for k in range(len(pairs))) and len(wanted) > 100
    assert low <= len(caught) / len(wanted) <= high
    assert all(similarity(*pairs[k]) >= 0.8 for k in range(len(pairs)) if 2 * k + 1 not in stay)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_links_whatever_brute_force_links(seed):
    rnd = random.Random(seed)
    centre = rnd.getrandbits(64)
    near = {centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (1 << 64) - 1 for _ in range(150)}
    fp = np.array(sorted(near | {rnd.getrandbits(64) for _ in range(150)}), np.uint64)
    x, y = simhash.trie_join(np.zeros(len(fp), np.int64), fp)
    assert (np.bitwise_count(fp[x] ^ fp[y]) >= 0).all() and len(x) < len(fp)

    def groups(links):
        label = list(range(len(fp)))
        for a, b in links:
            la, lb = label[a], label[b]
            label = [min(la, lb) if z in (la, lb) else z for z in label]
        return label

    brute = [(a, b) for a in range(len(fp)) for b in range(a) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4]
    assert groups(zip(x.tolist(), y.tolist(), strict=True)) == groups(brute)


def test_crowded_groups_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    values = [0, 1, 3, 7, 15, 31, 63, 127, 255, 511] + [1 << 40 | x for x in range(40)]
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), shared(spark))
    from frameloom.llm.components import components

    out = components(links, shared(spark))
    assert {(r.node, r.component) for r in out.collect()} == {(v, 0) for v in values if v}


# ---- op4 -------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "BLOCK", 60)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 16))
    v[100:300] = v[100]  # a vector that many rows repeat
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (950, []), (1000, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [None] * 16), (1150, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<double>, score string")
    out = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), shared(spark)).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.id, r.score))
    assert sorted(out) == list(range(0, 700, 50))
    unit, hits = v / np.sqrt((v * v).sum(axis=1, keepdims=True)), 0
    for q, found in out.items():
        cos = unit @ unit[q]
        cos[q] = -2
        kth = np.sort(cos)[-5]
        assert len(found) == 5 and all(abs(s - cos[i]) < 1e-12 for i, s in found)
        hits += sum(s >= kth - 1e-12 for _, s in found)
    assert hits >= 0.9 * 5 * len(out)
    assert [i for i, _ in out[100]] == [101, 102, 103, 104, 105] and [i for i, _ in out[150]] == [100, 101, 102, 103, 104]


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = ann.nearest(df, df.where("vec_id % 50 = 0"), shared(spark)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.id) for r in out] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.nearest(df.limit(0), df.limit(0), shared(spark)).count() == 0


def test_nearest_of_repeated_ids_and_vectors(spark):
    rows = [(0, [1.0, 0.0])] * 8 + [(7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, df.where("vec_id = 0"), shared(spark)).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out] == [(7, 1.0), (8, 1.0), (8, 1.0), (9, 0.0)]


def test_nearest_of_many_lengths(spark):
    rnd = random.Random(4)
    rows = [(100 * n + i, [rnd.gauss(0, 1) for _ in range(n)]) for n in range(2, 122) for i in (0, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), shared(spark)).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.id)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    vectors = dict(rows)
    assert dict(out) == {q: sorted((q + 1, q + 2), key=lambda i, q=q: -cos(vectors[i], vectors[q])) for q in vectors if q % 100 == 0}


def recall(spark, v, queries, uri):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    out = ann.nearest(df, df.where(f"vec_id % {queries} = 0"), uri).collect()
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    hits, verified = 0, {r.query_id: r.verified for r in out}
    for q in verified:
        c = unit @ unit[q]
        c[q] = -2
        hits += sum(r.score >= np.sort(c)[-5] - 1e-12 for r in out if r.query_id == q)
    assert len(out) == 5 * len(verified) == 5 * len(range(0, len(v), queries))
    return hits / len(out), sum(verified.values()) / len(verified) / len(v)


def test_nearest_prunes_clusters(spark, monkeypatch):
    for name, value in (("CELL", 100), ("BLOCK", 150), ("MAX_CELLS", 8), ("LEAF", 32)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 32))
    found, share = recall(spark, v, 200, shared(spark))
    assert found >= 0.9 and share < 0.1


def test_recall_on_the_registered_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    unit = {i: x / np.sqrt(x @ x) for i, x in v.items()}
    out = llm.queries()["op4_nearest"](spark, d).collect()
    hits = 0
    for r in out:
        kth = sorted((unit[i] @ unit[r.query_id] for i in v if i != r.query_id), reverse=True)[4]
        hits += r.score >= kth - 1e-9
    assert len(out) == 5 * sum(i % 50 == 0 for i in v) and hits >= 0.9 * len(out)


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


# ---- op5 -------------------------------------------------------------------------------------------


def brute_repeats(docs, length=50):
    first = {}
    for i, text, *_ in docs:
        b, i = (text or "").encode(), repeats.NO_ID if i is None else i
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, text, *_ in docs:
        b, own = (text or "").encode(), repeats.NO_ID if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < own:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize(("frequent", "fan"), [(16, 256), (2, 3)])
def test_repeats_against_brute_force(spark, frame, docs, monkeypatch, frequent, fan):
    monkeypatch.setattr(deal, "FAN", fan)
    for name, value in (("CHUNK_ROWS", 23), ("CHUNK_BYTES", 50_000), ("BLOCK", 20_000), ("RANGE", 500), ("SHARE", 300), ("FREQUENT", frequent)):
        monkeypatch.setattr(repeats, name, value)
    out = repeats.remove_repeats(frame, shared(spark))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == brute_repeats(docs)
    assert set(frame.columns) <= set(out.columns) and out.where("text is null").count() == 2


def texts_with_a_phrase(seed, shared_parts):
    """Random texts with a phrase of 24 bytes in each, and passages of 50 to 90 bytes that pairs of them share, some at an end."""
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [[some(rnd.randrange(0, 200)), " and so on and so forth, ", some(rnd.randrange(0, 200))] for _ in range(300)]
    for _ in range(shared_parts):
        passage = some(rnd.randrange(50, 91))
        for t in rnd.sample(texts, 2):
            t.insert(rnd.randrange(4), passage)
    return ["".join(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_anchors_of_equal_strings_meet_on_a_side(seed):
    data = [t.encode() for t in texts_with_a_phrase(seed, 40)]
    joined, ends = np.frombuffer(b"".join(data) + bytes(repeats.WIDE), np.uint8), np.cumsum([len(t) for t in data])
    h, a, b, place = repeats._anchors(joined[: ends[-1]], ends)
    row = np.searchsorted(ends, a, "right")
    met = repeats._met(repeats.side_keys(joined, h, a, b, place), row, row)
    holders = collections.defaultdict(set)
    windows = [(k, s, joined[s : s + 50].tobytes()) for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) for s in range(x, y + 1)]
    for k, _, w in windows:
        holders[w].add(row[k])
    needed = {k for k, _, w in windows if len(holders[w]) > 1}
    assert len(needed) > 60 and met[list(needed)].all() and met.sum() < 1.3 * len(needed)


def test_anchors_that_repeat_by_chance_send_no_spans(spark, monkeypatch):
    texts = texts_with_a_phrase(9, 0)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 20)
    uri = shared(spark)
    docs = list(enumerate(texts))
    out = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), uri)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == brute_repeats(docs)
    # 300 anchors; a few pairs share the few bits of a side's hash.
    assert (spark.read.parquet(f"{uri}/marks").agg({"entries": "sum"}).first()[0] or 0) < 20


def test_repeats_of_nothing(spark, empty):
    assert repeats.remove_repeats(empty, shared(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_deep_shallow_sorts(seed):
    rnd = random.Random(seed)
    text = bytes(rnd.choice(b"ab") for _ in range(400)) + b"a" * 200 + bytes(rnd.choice(b"ab") for _ in range(300)) * 2
    data = np.frombuffer(text + bytes(16), np.uint8)
    starts = np.arange(len(text) - 50)
    order, new = repeats.deep_shallow(data, starts)
    strings = [text[s : s + 50] for s in starts[order]]
    assert strings == sorted(strings)
    assert new.tolist() == [i for i in range(len(strings)) if i == 0 or strings[i] != strings[i - 1]]


# ---- op6 -------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in llm.queries()["op6_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark, frame, empty):
    model = langid.fit_sample(frame)
    out = {r.doc_id: r for r in langid.predict(frame, model, label_col="lang", score_col="score").collect()}
    assert all(out[i].lang == "und" and out[i].score == 0 for i in (10_000, 10_001, 10_002)) and out[10_004].lang != "und"
    assert out[0].n_words == "clash"
    assert langid.predict(empty, model).count() == 0
    none = langid.fit_sample(empty)
    assert {r.lang_pred for r in langid.predict(frame, none).collect()} == {"und"}


def test_ridge_on_landmarks_solves_the_kernel_equations():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdef" if k % 2 else "defghi") for _ in range(30)) for k in range(20)]
    labels = ["x" if k % 2 else "y" for k in range(20)]
    model = langid.fit(texts, labels, ridge=1e-2)  # every text is a landmark
    sets = [set(langid.grams(t).tolist()) for t in texts]
    K = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    Y = np.array([[1.0 if t == n else -1.0 for n in ("x", "y")] for t in labels])
    alpha = np.linalg.solve(K + 1e-2 * 20 * np.eye(20), Y)  # plain kernel ridge regression
    assert np.abs(model.kernels(texts) @ model.weights - K @ alpha).max() < 1e-3


def test_no_label_is_left_out(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} " * 5, f"l{k:03d}") for k in range(260) for _ in range(2)]
    df = spark.createDataFrame(rows + [(None, "zz zz", "l000")] * 3, "doc_id long, text string, lang string")
    assert len(langid.fit_sample(df).labels) == 260
    monkeypatch.setattr(langid, "LANDMARK_CELLS", 2000)
    small = langid.fit_sample(df)
    assert len(small.labels) == 260 and small.landmarks.size <= 2000 and len(small.predict(["aaaaaaa"])[0]) == 1


def test_the_sample_is_the_same_rows_whatever_the_split(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = langid.fit_sample(df.repartition(1)), langid.fit_sample(df.repartition(7))
    assert a.labels == b.labels and np.array_equal(a.weights, b.weights)


def test_kernel_is_shared_presence_over_root_of_sizes():
    model = langid.fit(["abcd", "wxyz"], ["a", "b"], ridge=1e-3)
    a, b = (set(langid.grams(x).tolist()) for x in ("abcd", "bcde"))
    assert model.kernels(["bcde"])[0, 0] == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b)), rel=1e-5)
    assert model.predict(["abc", "xyz", None, "12"])[0] == ["a", "b", "und", "und"]


# ---- op7 -------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        checked = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
        return (True, all(int(x) <= 255 for x in s.split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and checked, 8 <= len(d) <= 15)[kind]

    return [(name, m.start(), m.end()) for k, name in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[k], text or "") if good(k, m.group())]


def test_base_spans_equal_the_plain_patterns(docs):
    rnd = random.Random(5)
    texts = [t for _, t, _ in docs] + ["".join(rnd.choice("a1@.-+ (%4)9\n") for _ in range(60)) for _ in range(3000)] + ["4" * 5000, "a@" * 400, "1." * 900 + "@x.y"]
    for t in texts:
        assert pii.base_spans(t or "") == brute_spans(t)


def test_revealing_terms(spark):
    filler = "common words stand around here and there in every single sentence"
    rows = [(i, f"{filler} number {chr(97 + i)}{chr(97 + i)}{chr(97 + i)} Zorblatt writes zorblatt@mail.example.com {'xyz' * (i + 1)} today") for i in range(6)]
    rows += [(100 + i, f"{filler} writes someone{i}@mail.example.com today") for i in range(40)] + [(200 + i, f"{filler} number") for i in range(20)] + [(300, None), (301, "")]
    rows += [rows[0], (500, "unique wondrous words near lonely@mail.example.com once"), (501, "unique wondrous words near lonely@mail.example.com once"), (502, "unique wondrous words near lonely@mail.example.com once")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kind int")
    out = pii.find_pii(df, shared(spark)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    text = rows[2][1]
    terms = {text[s.start : s.end] for s in by_id[2].terms}
    assert "Zorblatt" in terms and not terms & {"writes", "common", "sentence", "number"}
    assert all(not by_id[i].terms for i in (100, 200, 300, 301, 500, 501))
    clean = {r.doc_id: r.text for r in pii.sanitise(df, shared(spark)).collect()}
    assert "[EMAIL]" in clean[2] and "Zorblatt" not in clean[2] and clean[300] is None and clean[200] == f"{filler} number"
    assert pii.sanitise(df, shared(spark)).columns == df.columns


def test_copies_and_shared_lines_count_alike_in_disclosure(spark):
    rows = [(10 * k + c, f"page {'abc'[k] * 4} by Quibbleford at quib@mail.example.com {'xyz'[k] * 4}") for k in range(3) for c in range(10)]
    rows += [(100 + k, f"essay {chr(97 + k) * 5} stands here\nreach Wimbledorf at wim@mail.example.com") for k in range(5)]
    rows += [(200 + k, f"page by person{k}@mail.example.com") for k in range(40)] + [(300 + k, "lonely Hapaxim at hap@mail.example.com") for k in range(9)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), shared(spark)).collect()
    texts = dict(rows)
    terms = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms if s.kind == "removed"} for r in out}
    assert all("Quibbleford" in terms[k] for k in range(30)) and all("Wimbledorf" in terms[100 + k] for k in range(5))
    assert all(not terms[300 + k] for k in range(9))


def test_revealing_terms_go_wherever_they_stand(spark):
    far = " ".join(["common words stand around here"] * 20)
    rows = [(k, f"Dear Quibbleford\n{far} {'abc'[k % 3] * 4}{'xyz'[k // 3] * 4}\nreach quib@mail.example.com, says QUIBBLEFORD") for k in range(9)]
    rows += [(20, f"Quibbleford and {far}")] + [(200 + k, f"{far} by person{k}@mail.example.com") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df, shared(spark)).collect()}
    assert not any("quibbleford" in t.lower() for t in clean.values())
    assert all("common words stand around here" in t for t in clean.values()) and clean[20].endswith(f" and {far}")


def test_disclosures_against_brute_force(spark):
    rnd = random.Random(6)
    names = [f"name{chr(97 + k)}" for k in range(12)]
    rows = []
    for i in range(400):
        k = rnd.randrange(12)
        w = [rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)] + ([names[k]] if rnd.random() < 0.9 else []) + ([names[(k + 1) % 12]] if rnd.random() < 0.03 else [])
        rows.append((i, " ".join(w) + (f" x{k % 9}@mail.example.com" if rnd.random() < 0.7 else "") + f" {i}"))
    rows += rows[:30]
    entity, df, joint, texts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, t in rows:
        found = {t[a:z] for _, a, z in brute_spans(t)}
        terms = {m.group().lower() for m in pii.WORD.finditer(t)}
        outside = {m.group().lower() for m in pii.terms_outside(t, brute_spans(t))} if found else set()
        df.update(terms)
        for e in found:
            entity[e] += 1
            texts[e].add(t)
            for x in outside:
                joint[x, e] += 1
                texts[x, e].add(t)
    total, expected = sum(entity.values()), {}
    for (x, e), n in joint.items():
        if len(texts[x, e]) >= 3 and df[x] >= 3:
            share = entity[e] / total
            value = math.log(n / df[x] / share) / -math.log(share)
            if value >= pii.GENERALISE:
                expected[pii._term_hash(x)] = max(value, expected.get(pii._term_hash(x), 0))
    out = pii.strong_terms(spark.createDataFrame(rows, "doc_id long, text string"), shared(spark)).collect()
    assert expected and {r.hash: r.disclosure for r in out} == pytest.approx(expected)


def test_terms_are_generalised_to_their_class():
    assert pii.replace_spans("ask Anna of NATO about cats", [("term", 4, 8), ("term", 12, 16), ("term", 23, 27)]) == "ask [NAME] of [ACRONYM] about [TERM]"


def test_pii_of_nothing(spark, empty):
    assert pii.find_pii(empty, shared(spark)).count() == 0


def test_op7_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in llm.queries()["op7_pii"](spark, SF).collect():
        spans = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == pii.digest(spans) and r.spans.startswith(",".join(f"{k}:{a}:{z}" for k, a, z in spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)


# ---- op8 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(frame, docs, tiktoken_encoding, empty):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(frame, path, pattern), path, pattern).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.ids == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, path, pattern).count() == 0


def test_bpe_of_odd_characters(tiktoken_encoding):
    import public_tokenizers

    codec, rnd = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(1)
    letters = " \n\t　 ab'sL9é.,\x1c\x85²½Ⅷ中_<|\U0001f600"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(30)))
        assert codec.encode(text) == tiktoken_encoding.encode_ordinary(text)


# ---- op9 -------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts = collections.Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed)


def test_quality_counts(frame, docs, empty):
    out = quality.quality_rules(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in out) == collections.Counter((i, *brute_quality(t)) for i, t, _ in docs)
    assert not any(r.kept and r.base_failed for r in out) and quality.quality_rules(empty).count() == 0


def test_compression_bands():
    rnd = random.Random(2)
    prose = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(900))
    noise = " ".join(base64.b64encode(rnd.randbytes(9)).decode() for _ in range(900))
    dull = " ".join(f"item {i % 7} of the list" for i in range(900))
    mixed = prose[:3000] + " " + dull[:9000]
    assert [quality.judge([t])[-1][0] for t in (prose, noise, dull, mixed)] == [True, False, False, False]


# ---- op10 ------------------------------------------------------------------------------------------


def brute_kneser_ney(train, order, end=b"\n"):
    """p(u, v, w) by dictionaries."""
    T = lambda x: [*(x or "").encode().lower().split(), end]
    triples = collections.Counter((u, v, w) for t in train for u, v, w in zip([end, end, *T(t)], [end, *T(t)], T(t), strict=False))
    c = collections.Counter(w for t in train for w in T(t))
    if order < 3:
        grams = collections.Counter()
        for (_, v, w), n in triples.items():
            grams[(end, v, w)] += n
        triples = grams
    pairs = collections.Counter()
    for (_, v, w), n in triples.items():
        pairs[v, w] += n if v == end else 1
    left = collections.Counter(w for _, w in pairs) if order > 1 else c
    of = lambda values: [0.0, *kneser_ney.discounts(*(sum(x == i for x in values) for i in (1, 2, 3, 4)))]
    high, mid, low, V, every = of(triples.values()), of(pairs.values()), of(left.values()), len(c), sum(left.values())
    mass = sum(low[min(x, 3)] for x in left.values()) / every

    def contexts(grams):
        total, kinds = collections.Counter(), collections.defaultdict(collections.Counter)
        for g, n in grams.items():
            total[g[:-1]] += n
            kinds[g[:-1]][min(n, 3)] += 1
        return total, kinds

    of_two, of_one = contexts(triples), contexts(pairs)

    def mixed(n, d, context, sums, lower):
        total, kinds = sums
        if not total[context]:
            return lower
        return (n - d[min(n, 3)]) / total[context] + sum(d[k] * kinds[context][k] for k in (1, 2, 3)) / total[context] * lower

    def p(u, v, w):
        out = (left[w] - low[min(left[w], 3)]) / every + mass / (V + 1)
        if order == 3:
            out = mixed(pairs[v, w], mid, (v,), of_one, out)
        return mixed(triples[u, v, w], high, (u, v), of_two, out) if order > 1 else out

    return c, p, T


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_against_dictionaries(spark, frame, docs, monkeypatch, order):
    for name, value in (("PART_WORDS", 700), ("SHARD_TOKENS", 700)):
        monkeypatch.setattr(kneser_ney, name, value)
    monkeypatch.setattr(deal, "FAN", 3)
    train = [t for i, t, _ in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c, p, T = brute_kneser_ney(train, order)
    N, V, end = sum(c.values()), len(c), b"\n"
    assert max(c.values()) > 700  # some words are hot
    seen = (end, T(train[0])[0])
    for u, v in ((end, end), seen if order == 3 else (end, seen[1])):
        assert sum(p(u, v, w) for w in c) + p(u, v, b"??") == pytest.approx(1.0)
    uri = shared(spark)
    kneser_ney.train(frame.where(common.crc_mod("doc_id", 10) != 0), uri, order=order)
    out = kneser_ney.score(frame, uri).collect()
    assert len(out) == len(docs)
    for r in out:
        t = T(r.text)
        assert (r.n_tokens, r.n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (N + 0.1 * (V + 1))) for w in t))
        before = [end, *t], [end, end, *t]
        assert r.score == pytest.approx(sum(math.log10(p(end if order == 2 else u, v, w)) for u, v, w in zip(before[1], before[0], t, strict=False)))


def test_entries_are_dealt_out_in_levels(spark, monkeypatch):
    monkeypatch.setattr(deal, "FAN", 3)
    rnd = np.random.default_rng(1)
    targets, values = rnd.integers(0, 40, 500), rnd.integers(0, 1 << 40, 500)
    rows = [x for k in range(5) for x in zip(*deal.cut(targets[k::5], [values[k::5]], deal.width(40)), strict=True)]
    out = deal.deal(spark.createDataFrame(rows, deal.SCHEMA), 40).collect()
    found = sorted((r.key, v) for r in out for v in deal.gather([bytes(r.block)])[0].tolist())
    assert found == sorted(zip(targets.tolist(), values.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1, 300])
def test_blocks_give_their_columns_again(n):
    rnd = np.random.default_rng(n)
    rows = rnd.integers(0, 2, (n, 85)).astype(np.uint8)
    rows[:, 0] = rnd.integers(0, 85, n)
    rows[:, 1:][np.arange(84) >= rows[:, :1]] = 0
    columns = [np.arange(n), rows, rnd.integers(-(1 << 62), 1 << 62, n), np.full(n, 7)]
    for made, given in zip(deal.unpack(deal.pack(columns)), columns, strict=True):
        assert made.shape == given.shape and (made == given).all()


def test_tables_that_are_read_are_let_go(spark, monkeypatch):
    uri, h = shared(spark), np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(3):
        kneser_ney.put_table(f"{uri}/t-{k:07d}", h, np.arange(1, 200) + 1000 * k)
    plain = kneser_ney.get_array
    monkeypatch.setattr(kneser_ney, "get_array", lambda path, dtype: np.array(plain(path, dtype)))
    monkeypatch.setattr(kneser_ney, "READ_BYTES", 100)
    tables = kneser_ney.Tables(uri)
    for k in (0, 1, 2, 1, 0):
        assert (tables.find("t", k, h, 1)[:, 0] == np.arange(1, 200) + 1000 * k).all() and len(tables.open) == 1
    assert not tables.find("t", 9, h, 1).any() and not tables.find("t", 0, h ^ np.uint64(1 << 40), 1).any()


def test_kneser_ney_without_training_texts(spark, frame, empty):
    uri = shared(spark)
    kneser_ney.train(empty, uri)
    assert all(r.score == 0 and r.n_known == 0 for r in kneser_ney.score(frame, uri).collect())
    assert kneser_ney.score(empty, uri).count() == 0


# ---- the pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    uri, names = shared(spark), df.columns
    for k, (name, stage) in enumerate(p.STAGES):
        out = common.keep(stage(spark, df, SF), f"{uri}/{k}")
        before, after = {r.doc_id: r for r in df.collect()}, {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == names
        if name == "language":
            assert set(after) == {i for i, r in before.items() if r.text and any(map(str.isalpha, r.text))}
        elif name == "near_duplicates":
            assert all(any(similarity(before[i].text, before[j].text) >= 0.8 for j in before if j != i) for i in set(before) - set(after))
            assert not any(similarity(after[i].text, after[j].text) >= 0.9 for i in after for j in after if i < j)
        elif name == "repeated_passages":
            assert set(after) == set(before) and sum(r.n_chars for r in after.values()) < sum(len(r.text) for r in before.values())
            kept = {i: r.text for i, r in after.items()}
            for i, *_, digest in brute_repeats([(i, r.text) for i, r in before.items()]):
                if kept[i].isascii():
                    assert hashlib.sha256(kept[i].encode()).hexdigest() == digest or not before[i].text.isascii()
        elif name == "personal_data":
            assert not any(brute_spans(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            check_packing(out.collect(), token_ids([(i, r.text) for i, r in before.items()]), 4096)
        df = out


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in llm.queries() if n.startswith("op")] == list(range(1, 14)) and "pipeline" in llm.queries()


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_operator_equals_its_sql(spark, frame, empty, tmp_path, name):
    for k, rows in enumerate((frame, empty)):
        rows.drop("n_words").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/{k}/documents.parquet/*.parquet'")
        assert not oracle.differences(llm.queries()[name](spark, f"{tmp_path}/{k}"), con, llm.oracles()[name])
    assert not oracle.differences(llm.queries()[name](spark, SF), oracle.connect(SF), llm.oracles()[name])
