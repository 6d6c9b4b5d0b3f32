"""Collocations, alignment of tokenizers and token counts against brute force on small corpora."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from frameloom.llm import alignment, common, phrases, prefixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n string, segment string, profile int"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def corpus():
    """Awkward texts: (doc_id, text, lang)."""
    rnd = random.Random(3)
    alphabet = "aeti nsr  \t\n();\r\n=/* é日0123.<>_'s’\xa0 \x85\x1c　"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 80))) for _ in range(120)]
    parts = ["x ", "y ", "z\t", "É ", "X. ", "\n", "q\r", "\x0b", "w"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(200))) for _ in range(150)]
    texts += ["", " ", "\n", "x ▁ y", "▁", "<|endoftext|> <s> </s><0x0A><unk>", "x" * 5000, "\x00 a\x00", "日本語テキスト 🎉🎉 é é", "//" * 60 + "====" * 70, "the same. " * 50, "the same. " * 50, ";\r\n\r x", None]
    return [(None if i % 50 == 9 else i // 2, t, rnd.choice(["a", "b", None])) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", 7) for i, t, lang in docs], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shared(spark):
    return common.shared_dir(spark, "test")


# ---- collocations -------------------------------------------------------------------------------


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute_collocations(docs, least=30, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    wanted = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, q[i : i + k]) for (lang, q), a in wanted.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 80 * f[lang, q[i : i + k]]}
    rows = collections.defaultdict(list)
    for (lang, q), a in wanted.items():
        if (lang, q) not in gone:
            cuts = [(2000000 * a // (f[lang, q[:k]] + f[lang, q[k:]]), k, f[lang, q[:k]], f[lang, q[k:]]) for k in range(1, len(q))]
            score, _, left, right = min(cuts)
            rows[lang].append((-score, -a, " ".join(q).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in rows.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("shard", "ranges", "fan", "top"), [(700, 300, 256, 2000), (150, 40, 3, 7)])
def test_collocations_against_brute_force(spark, frame, docs, monkeypatch, shard, ranges, fan, top):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "RANGE", ranges)
    monkeypatch.setattr(phrases.deal, "FAN", fan)
    uri = shared(spark)
    words, found = phrases.counted(frame, uri)
    rows = phrases.ranked(phrases.collocations(words, found, uri), top).select("lang", "rank", "phrase", "a", "l", "r", "score")
    want = [(*x[:6], x[7]) for x in brute_collocations(docs, top=top)]
    assert sorted(map(tuple, rows.collect())) == want and len(want) > 15


def test_collocations_of_nothing(spark, empty):
    for df in (empty, spark.createDataFrame([(1, None, None), (2, " .\n", "x")], "doc_id long, text string, lang string")):
        uri = shared(spark)
        words, found = phrases.counted(df, uri)
        assert words.isEmpty() and phrases.ranked(phrases.collocations(words, found, uri)).isEmpty()


def test_collocations_equal_their_sql_and_brute_force(spark):
    assert not oracle.differences(phrases.op11_collocations(spark, SF), oracle.connect(SF), phrases.ORACLE_SQL)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = phrases.op11_collocations(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_states_are_classes_of_end_positions(seed):
    rnd = random.Random(seed)
    ids = np.array([0] + [rnd.choice([0, 1, 1, 2, 3][: 3 + seed % 3]) for _ in range(200)])
    depth = 5
    automaton = phrases.Automaton(ids, phrases._depth(ids, depth))
    ends = collections.defaultdict(set)
    for i in range(len(ids)):
        for k in range(1, depth + 1):
            if i - k + 1 >= 0 and (ids[i - k + 1 : i + 1] > 0).all():
                ends[tuple(ids[i - k + 1 : i + 1].tolist())].add(i)
    assert {tuple(w): n for w, n in automaton.substrings()} == {w: len(x) for w, x in ends.items()}
    classes = collections.defaultdict(list)
    for w, x in ends.items():
        classes[frozenset(x)].append(w)
    assert len(automaton.count) == len(classes)
    words = lambda s: tuple(ids[automaton.end[s] - automaton.length[s] + 1 : automaton.end[s] + 1].tolist())
    for s in range(len(automaton.count)):
        same = classes[frozenset(ends[words(s)])]
        assert words(s) == max(same, key=len)
        shorter = min(same, key=len)[1:]
        assert (automaton.link[s] == -1) == (not shorter)
        assert not shorter or words(automaton.link[s]) == max(classes[frozenset(ends[shorter])], key=len)


# ---- alignment ----------------------------------------------------------------------------------


def brute_alignment(docs):
    """Whole texts, tokenised each time: doc_id, the six numbers, the groups as text."""
    a_model, b_model, pair = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment.Pair(A_PATH, B_PATH)
    a_model.encode_special_tokens = True
    rows, times = [], collections.Counter()
    for doc, text, _ in docs:
        if not text or "▁" in text:
            rows.append((doc, 0, 0, [], []))
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        parts = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        assert b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode()
        owner = [np.repeat(np.arange(len(p)), list(map(len, p))) for p in parts]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*(x.tolist() for x in owner), strict=True)))]
        a_ends, b_ends = ([0, *itertools.accumulate(map(len, p))] for p in parts)
        common_ends = sorted({*a_ends} & {*b_ends})
        groups = [(a[a_ends.index(x) : a_ends.index(y)], b[b_ends.index(x) : b_ends.index(y)]) for x, y in itertools.pairwise(common_ends)]
        times.update(links)
        rows.append((doc, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    write = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [(doc, a, b, len(groups), len(links), sum(times[x] == most[x[1]] for x in links), sum(times[x] for x in links), write(groups)) for doc, a, b, groups, links in rows], times


@pytest.mark.parametrize(("block", "ranges", "fan"), [(16 << 20, 250_000, 256), (300, 100, 3)])
def test_alignment_against_brute_force(spark, frame, docs, monkeypatch, block, ranges, fan):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "RANGE", ranges)
    monkeypatch.setattr(alignment.deal, "FAN", fan)
    found, counts = alignment.align(frame, A_PATH, B_PATH, shared(spark))
    want, times = brute_alignment(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["pair"] >> 32, r["pair"] & (1 << 32) - 1): r["n"] for r in counts.collect()} == times


def test_alignment_digests(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[1] else "") for x in brute_alignment(rows)[0]]
    assert sorted(map(tuple, alignment.op12_alignment(spark, SF).collect())) == sorted(want)


def test_alignment_of_nothing(spark, empty):
    found, counts = alignment.align(empty, A_PATH, B_PATH, shared(spark))
    assert found.isEmpty() and counts.isEmpty()


def test_cuts_are_where_no_token_joins():
    assert set(alignment.Pair(A_PATH, B_PATH).cuts) == set(" \t\n\x0b\x0c")  # a piece holds ";\r"
    assert alignment.whitespace([b"a b", b" \n", b"\xc2\xa0\t", b"x\n"]) == "\t\x0b\x0c\r"
    assert "".join(alignment.segmenter(" \n")(" a\r b \n\xa0c  d ")) == " a\r b \n\xa0c  d "
    assert alignment.segmenter(" \n")(" a\r b \n\xa0c  d ") == [" a\r b", " \n\xa0c", "  d", " "]


def test_a_vocabulary_that_loses_bytes_is_refused():
    pair = alignment.Pair(A_PATH, B_PATH)
    assert pair.align([" the", "\nx"]).groups == ["262|272", "198|13;87|28744"]
    pair.b_bytes = {**pair.b_bytes, pair.b.encode(" the")[0]: b" tha"}
    with pytest.raises(ValueError, match="bytes"):
        pair.align([" the"])


# ---- token counts -------------------------------------------------------------------------------


def test_counts_at_every_prefix(docs):
    model, program = sentencepiece.SentencePieceProcessor(model_file=B_PATH), prefixes.Program(B_PATH)
    for _, text, _ in docs:
        text = (text or "")[:400]
        assert np.r_[0, np.cumsum(program.profile(text), dtype=int)].tolist() == [len(model.encode(text[:k])) for k in range(len(text) + 1)], text


def test_counts_with_full_caches(docs, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    for name, value in (("PREFIXES", 20), ("PAIRS", 5), ("KEPT", 3)):
        monkeypatch.setattr(prefixes, name, value)
    program = prefixes.Program(B_PATH)
    for _, text, _ in docs:
        assert int(program.profile(text or "").sum(dtype=int)) == len(model.encode(text or ""))


def test_questions_are_answered_from_profiles(spark, frame, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    profiled = prefixes.prefix_counts(frame, B_PATH)
    asked = prefixes.longest_within(prefixes.tokens_before(profiled, "9"), "6")
    asked = prefixes.tokens_before(asked, "if(doc_id % 2 = 0, null, 1000000)", out_col="odd")
    assert profiled.columns == ["doc_id", "text", "lang", "n", "segment", "profile", "n_tokens"]
    rows = asked.collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = r.text or ""
        counts = [len(model.encode(text[:k])) for k in range(len(text) + 1)] if len(text) < 500 else None
        assert r.n_tokens == len(model.encode(text)) and r.tokens_before == len(model.encode(text[:9]))
        assert r.odd == (r.n_tokens if r.doc_id is not None and r.doc_id % 2 else None if r.doc_id is not None else r.n_tokens)
        assert counts is None or r.chars_within == max(k for k, c in enumerate(counts) if c <= 6)


def test_token_counts_of_the_table(spark, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = prefixes.op13_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    assert prefixes.prefix_counts(empty, B_PATH).isEmpty()


def test_learning_words_does_not_walk_through_the_cache():
    """What a batch costs grows with its own words, not with those that the worker holds."""
    from frameloom.llm.packing import Tokenizer

    class Walked(Tokenizer):
        def keys(self):
            raise AssertionError("the whole cache is read")

    words = Walked(public_tokenizers.path("word_bpe_49k.json"))
    first = words.encode_all(["one two. three", ""])
    assert [x.tolist() for x in words.encode_all(["one two. three", ""])] == [x.tolist() for x in first] and len(first[0]) and not len(first[1])
