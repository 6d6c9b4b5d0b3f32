"""Phrase collocations per language, by generalised suffix automata of shards.

Texts are cut into pieces and pieces into words. A shard holds some millions of words of a task's
texts, as numbers of its own vocabulary, in a file of the shared folder. Phrases of up to DEPTH
words are wanted with exact counts, where they occur LEAST times or more over all shards:

1. Words are counted in Spark, by language.
2. In two rounds, for phrases of two and of three words, each shard sends the hashes of its phrases
   with their counts to ranges of hashes, and a range answers which of them reach LEAST in sum.
   A phrase can't be wanted unless all shorter phrases in it are, so each round is for phrases whose
   parts are left. Hashes may collide, which leaves a phrase too many, never one too few.
3. What is left of a shard are runs of words, a small part of the text. Their generalised suffix
   automaton (``Automaton``) enumerates the phrases of two words or more, with its endpos counts,
   and these are summed up over the shards by the phrases themselves.
4. A phrase that is subsumed by a longer one is subsumed by one a single word longer: counts fall
   from each to the next, and all phrases between are wanted too. These are the ones whose suffix
   link leads to it, and the ones that it begins.

The automaton is bounded in depth and built from its tree of suffix links: a node stands for a
substring, its parent for the substring without the first word, and nodes of equal count on one path
have the same end positions, so they are one state. Sorting finds the nodes level by level.

Null texts are empty, a null language counts as ``und``. Repeated rows count each time; ids are not
used, extra columns are ignored. Long texts are taken whole; a shard takes the whole text that passes
its size. Without words there are no rows. Ties in rank are broken by count, then by the phrase's bytes.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm import deal
from frameloom.llm.common import get_array, give_back, keep, put_array, shared_dir, small_batches, small_side, table

DEPTH, LEAST, TOP, SHARE = 4, 30, 2000, 80
UNKNOWN = "und"
#: Words of a shard, entries of a range of hashes, bits of a hash.
SHARD, RANGE, BITS = 2_000_000, 3_000_000, 48
#: What ends a piece.
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
SALTS = 64


# ---- the automaton ------------------------------------------------------------------------------


class Automaton:
    """The generalised suffix automaton of runs of numbers, 0 between runs, for substrings of bounded length.

    deepest gives, for each position, the greatest length of a substring ending there that is taken
    in; it rises by one at most from a position to the next. A state has the greatest ``length`` of its
    substrings, their common ``count`` of end positions, one ``end``, and a ``link`` to the state of
    the longest suffix that has other end positions (-1: the empty one).
    """

    def __init__(self, ids: np.ndarray, deepest: np.ndarray):
        self.ids = ids
        #: By level: the positions, and the number of each one's node.
        self.at: list[np.ndarray] = []
        self.node: list[np.ndarray] = []
        parents, counts, ends, depths = [], [], [], []
        wide, total = int(ids.max(initial=0)) + 1, 0
        here = np.full(len(ids), -1)
        for d in range(1, int(deepest.max(initial=0)) + 1):
            at = np.flatnonzero(deepest >= d)
            before = here[at]
            _, first, node, times = np.unique((before + 1) * wide + ids[at - d + 1], return_index=True, return_inverse=True, return_counts=True)
            parents.append(before[first])
            counts.append(times)
            ends.append(at[first])
            depths.append(np.full(len(times), d))
            here[at] = node + total
            self.at.append(at)
            self.node.append(node + total)
            total += len(times)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        #: By node.
        self.parents, self.counts, self.ends, self.depths = map(join, (parents, counts, ends, depths))
        # A node whose longer neighbour has its count is no state of its own.
        inner = np.zeros(total, bool)
        has = self.parents >= 0
        inner[self.parents[has][self.counts[self.parents[has]] == self.counts[has]]] = True
        top = np.arange(total)  # the shortest node of each node's state, whose parent is in the linked state
        for d in range(2, len(self.at) + 1):
            same = np.flatnonzero((self.depths == d) & has)
            same = same[self.counts[same] == self.counts[self.parents[same]]]
            top[same] = top[self.parents[same]]
        state, longest = np.cumsum(~inner) - 1, np.flatnonzero(~inner)
        self.length, self.count, self.end = self.depths[longest], self.counts[longest], self.ends[longest]
        above = self.parents[top[longest]]
        self.link = np.where(above >= 0, state[above], -1)

    def substrings(self, shortest: int = 1) -> Iterator[tuple[list[int], int]]:
        """Every substring of at least that length, with its number of occurrences."""
        low = np.where(self.link >= 0, self.length[self.link], 0) + 1
        wanted = np.flatnonzero(self.length >= shortest)
        for length, least, times, end in zip(self.length[wanted].tolist(), np.maximum(low, shortest)[wanted].tolist(), self.count[wanted].tolist(), self.end[wanted].tolist(), strict=True):
            words = self.ids[end - length + 1 : end + 1].tolist()
            for n in range(least, length + 1):
                yield words[length - n :], times


def hashed(ids: np.ndarray, hashes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words up to each end, from the words' hashes."""
    h = np.zeros(len(ends), np.uint64)
    for back in range(k - 1, -1, -1):
        h = (h ^ hashes[ids[ends - back]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


# ---- shards -------------------------------------------------------------------------------------


class Shard:
    """A stored shard: numbers of words with 0 between pieces, and by number hash, language and word."""

    def __init__(self, uri: str):
        give_back()
        columns = deal.unpack(get_array(uri, np.uint8).tobytes())
        self.ids, self.hashes, self.lang = columns[0], columns[1].view(np.uint64), columns[2]
        self.words = columns[3].astype(np.uint8).tobytes().decode().split("\n")
        self.langs = json.loads(columns[4].astype(np.uint8).tobytes())


def _store(uri: str, ids: np.ndarray, hashes: np.ndarray, lang: np.ndarray, words: list[str], langs: list[str]) -> None:
    text = [np.frombuffer("\n".join(words).encode(), np.uint8), np.frombuffer(json.dumps(langs).encode(), np.uint8)]
    put_array(uri, np.frombuffer(deal.pack([ids, hashes.view(np.int64), lang, *text]), np.uint8))


SHARDS = "shard long, file string, size long, lang string, words array<string>, times array<long>"


def _write_shards(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, first = 0, TaskContext.get().partitionId() << 32
        ids: list[int] = [0]
        numbers: dict[str, defaultdict[bytes, int]] = {}
        number = count(1)

        def out() -> pa.RecordBatch:
            name = f"{uri}/shards/{first + turn:016x}-{uuid.uuid4().hex[:8]}"  # an attempt's own: its rows name it
            flat = np.array(ids, np.int64)
            words, lang, hashes = [""], [np.zeros(1, np.int64)], [0]
            for i, (name_of, found) in enumerate(numbers.items()):
                seed = xxhash.xxh64_intdigest(name_of)
                lang.append(np.full(len(found), i))
                words += [w.decode() for w in found]
                hashes += [xxhash.xxh64_intdigest(w, seed) for w in found]
            # Numbers were given as words came, in all languages; here they follow the languages.
            order = np.array([0, *(n for found in numbers.values() for n in found.values())])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            flat = place[flat]
            times = np.bincount(flat, minlength=len(order))
            lang = np.concatenate(lang)
            _store(name, flat, np.array(hashes, np.uint64), lang, words, list(numbers))
            rows = [(first + turn, name, int((flat > 0).sum()), None, None, None)]
            at = 1
            for lang_name, found in numbers.items():
                rows.append((None, None, None, lang_name, words[at : at + len(found)], times[at : at + len(found)]))
                at += len(found)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "file", "size", "lang", "words", "times"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in numbers:
                    numbers[lang] = defaultdict(number.__next__)
                give = numbers[lang].__getitem__
                for piece in text.lower().translate(BREAKS).split(b"\n"):
                    words = piece.split()
                    if words:
                        ids += map(give, words)
                        ids.append(0)
                if len(ids) >= SHARD:
                    yield out()
                    turn, ids, numbers, number = turn + 1, [0], {}, count(1)
        if len(ids) > 1:
            yield out()

    return run


# ---- rounds -------------------------------------------------------------------------------------


def _shard_key(key: int, most: int) -> int:
    return (key // most) << 32 | key % most


def _send(shard: Shard, automaton: Automaton, k: int, ranges: int, key: int) -> pa.Table:
    """The shard's phrases of k words as blocks of hashes, counts, and their place among the shard's hashes."""
    level = automaton.depths == k
    h, times = hashed(shard.ids, shard.hashes, automaton.ends[level], k), automaton.counts[level]
    order = np.argsort(h, kind="stable")
    h, times = h[order], times[order]
    targets = (h.astype(np.float64) * (ranges / (1 << BITS))).astype(np.int64).clip(0, ranges - 1)
    keys, blocks = deal.cut(targets, [h, times, np.full(len(h), key), np.arange(len(h))], deal.width(ranges))
    return pa.table([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])


def _marked(shard: Shard, automaton: Automaton, k: int, group: pa.Table) -> np.ndarray:
    """For each position whether the phrase of k words that ends there is left, by the answers in a group of rows."""
    places = [deal.unpack(b)[1] for b in group.column("block").to_pylist() if b]
    level = np.flatnonzero(automaton.depths == k)
    left = np.zeros(len(automaton.depths), bool)
    left[level[np.argsort(hashed(shard.ids, shard.hashes, automaton.ends[level], k), kind="stable")[np.concatenate(places)]] if places else []] = True
    mark = np.zeros(len(shard.ids), bool)
    if len(automaton.at) >= k:
        mark[automaton.at[k - 1]] = left[automaton.node[k - 1]]
    return mark


def _depth(ids: np.ndarray, k: int) -> np.ndarray:
    """How many words of its run end at each position, k at most."""
    at = np.arange(len(ids))
    return np.minimum(at - np.maximum.accumulate(np.where(ids == 0, at, -1)), k)


def _file(group: pa.Table) -> str:
    return next(x for x in group.column("file").to_pylist() if x)


def _first_round(ranges: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = Shard(_file(group))
        return _send(shard, Automaton(shard.ids, _depth(shard.ids, 2)), 2, ranges, key[0].as_py())

    return run


def _second_round(ranges: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = Shard(_file(group))
        mark = _marked(shard, Automaton(shard.ids, _depth(shard.ids, 2)), 2, group)
        # Runs: words whose neighbour makes a phrase that is left; a 0 comes where two of them don't.
        word = mark | np.r_[mark[1:], False]
        at = np.flatnonzero(word)
        runs = np.zeros(len(at) + int((~mark[at]).sum()) + 1, np.int64)
        runs[np.arange(len(at)) + np.cumsum(~mark[at])] = shard.ids[at]
        used = np.unique(runs)
        used = used if len(used) and used[0] == 0 else np.r_[0, used]
        shard.ids, shard.hashes, shard.lang = np.searchsorted(used, runs), shard.hashes[used], shard.lang[used]
        _store(f"{_file(group)}.runs", shard.ids, shard.hashes, shard.lang, [shard.words[i] for i in used.tolist()], shard.langs)
        return _send(shard, Automaton(shard.ids, _depth(shard.ids, 3)), 3, ranges, key[0].as_py())

    return run


FOUND = "lang string, phrase string, n long"


def _left(group: pa.Table) -> Iterator[tuple[str, str, int]]:
    """The phrases that are left of a shard, with their counts."""
    shard = Shard(f"{_file(group)}.runs")
    depth = _depth(shard.ids, DEPTH)
    three = _marked(shard, Automaton(shard.ids, np.minimum(depth, 3)), 3, group)
    depth = np.where(three, np.where(np.r_[False, three[:-1]], depth, np.minimum(depth, 3)), np.minimum(depth, 2))
    words = shard.words
    for ids, n in Automaton(shard.ids, depth).substrings(2):
        yield shard.langs[shard.lang[ids[0]]], " ".join([words[i] for i in ids]), n


def _enumerate(ranges: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """The phrases that are left of a shard, for ranges of their hashes: language, line break and phrase, and the count."""
        found = [(f"{lang}\n{phrase}".encode(), n) for lang, phrase, n in _left(group)]
        targets = np.fromiter((xxhash.xxh32_intdigest(x) % ranges for x, _ in found), np.int64, len(found))
        keys, blocks = deal.cut(targets, [deal.strings(x for x, _ in found), np.array([n for _, n in found], np.int64)], deal.width(ranges))
        return pa.table([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])

    return run


def _sum_up(least: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """The phrases of a range that occur least times or more in all shards."""
        sums: dict[bytes, int] = {}
        for block in group.column("block").to_pylist():
            _, phrases, times = deal.unpack(block)
            for x, n in zip(phrases, times.tolist(), strict=True):
                sums[x] = sums.get(x, 0) + n
        rows = [(*x.decode().rsplit("\n", 1), n) for x, n in sums.items() if n >= least]  # words hold no line break
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "n"])

    return run


def _answer(targets: int, least: int):
    wide = deal.width(targets)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        """For shards: the places of the phrases of a range whose counts reach the least in sum."""
        h, times, shard, place = deal.gather(group.column("block").to_pylist())
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
        total = np.add.reduceat(times[order], new)
        left = order[np.repeat(total >= least, np.diff(np.r_[new, len(h)]))]
        left = left[np.lexsort((place[left], shard[left]))]
        keys, blocks = deal.cut(shard[left], [place[left]], wide)
        return pa.table([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])

    return run


# ---- the whole ----------------------------------------------------------------------------------


def counted(docs: DataFrame, uri: str, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The words (lang, phrase, n), all of them, and the phrases of 2 to DEPTH words that occur least times or more."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    written = keep(source.mapInArrow(_write_shards(uri), SHARDS), f"{uri}/written")
    vocabulary = written.where(F.col("lang").isNotNull()).select("lang", F.explode(F.arrays_zip("words", "times")).alias("w"))
    words = keep(vocabulary.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.times").alias("n")), f"{uri}/words")
    part, turn = F.shiftright("shard", 32), F.col("shard").bitwiseAND(F.lit((1 << 32) - 1))
    shards = written.where(F.col("file").isNotNull())
    total = shards.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max(part).alias("last"), F.max(turn).alias("turn")).first()
    if not total["n"]:
        return words, spark.createDataFrame([], FOUND)
    number, most = total["n"], total["turn"] + 1
    targets, ranges = (total["last"] + 1) * most, max(1, round(total["size"] / RANGE))
    named = shards.select((part * most + turn).alias("key"), F.lit(None).cast("binary").alias("block"), "file")
    rows = named
    for k, send in enumerate((_first_round(ranges), _second_round(ranges)), 2):
        sent = rows.repartition(number, "key").groupBy("key").applyInArrow(send, deal.SCHEMA)
        dealt = deal.deal(sent, ranges).repartition(ranges, "key")
        answers = keep(dealt.groupBy("key").applyInArrow(_answer(targets, least), deal.SCHEMA), f"{uri}/answers-{k}")
        rows = deal.deal(answers, targets).withColumn("file", F.lit(None).cast("string")).unionByName(named)
    found = deal.deal(rows.repartition(number, "key").groupBy("key").applyInArrow(_enumerate(ranges), deal.SCHEMA), ranges)
    phrases = found.repartition(ranges, "key").groupBy("key").applyInArrow(_sum_up(least), FOUND)
    return words, keep(phrases, f"{uri}/phrases")


def collocations(words: DataFrame, phrases: DataFrame, uri: str, share: int = SHARE) -> DataFrame:
    """Of the phrases of counted() those that no longer one subsumes: lang, phrase, a, l, r, score."""
    size = F.size(F.split("phrase", " "))
    # A longer phrase points to what its suffix link leads to and to what it begins with.
    link = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    begin = F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
    longer = phrases.where(size > 2).select("lang", F.explode(F.array(link, begin)).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ((100 * F.col("longer").cast("decimal(20,0)")) < share * F.col("n").cast("decimal(20,0)")))
    cuts = free.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    # Parts of a phrase occur as often as it does.
    least = phrases.agg(F.min("n")).first()[0] or 0
    parts = keep(words.where(F.col("n") >= least).unionByName(phrases), f"{uri}/parts")
    sides = {side: parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r"))}
    cuts = cuts.join(sides["left"], ["lang", "left"]).join(sides["right"], ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each lang by score, a and phrase, with their rank; first within parts of a lang, so none is sorted whole."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language."""
    small_batches(spark)
    uri = shared_dir(spark, "phrases")
    words, phrases = counted(table(spark, sf_dir, "documents"), uri)
    n = small_side(keep(words.groupBy("lang").agg(F.sum("n").alias("words")), f"{uri}/languages"))
    found = ranked(keep(collocations(words, phrases, uri), f"{uri}/found"))
    return found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


#: The rows of op11_collocations in DuckDB SQL: every phrase counted, every longer candidate looked at.
ORACLE_SQL = rf"""with texts as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
  pieces as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts)),
  starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest(range(1, {DEPTH + 1})) as k)),
  f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as n from starts group by 1, 2, 3),
  totals as (select lang, sum(n) as n from f where k = 1 group by 1),
  candidates as (select lang, k, phrase, string_split(phrase, ' ') as w, n as a from f where k > 1 and n >= {LEAST}),
  inner_sizes as (select lang, k, w, a, unnest(range(2, k)) as j from candidates),
  inner_starts as (select lang, w, a, j, unnest(range(1, k - j + 2)) as i from inner_sizes),
  longer as (select lang, array_to_string(w[i:i + j - 1], ' ') as phrase, max(a) as most from inner_starts group by 1, 2),
  free as (select c.* from candidates c left join longer o on c.lang = o.lang and c.phrase = o.phrase where o.most is null or 100 * o.most < {SHARE} * c.a),
  cuts as (select lang, phrase, a, array_to_string(w[1:c], ' ') as head, array_to_string(w[c + 1:k], ' ') as tail, c from (select *, unnest(range(1, k)) as c from free)),
  scored as (select cuts.*, x.n as l, y.n as r, (2000000::hugeint * a) // (x.n + y.n) as score from cuts join f x on cuts.lang = x.lang and head = x.phrase join f y on cuts.lang = y.lang and tail = y.phrase),
  best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
  ranks as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
  select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n::bigint as n, score::bigint as score from ranks join totals t using (lang) where rank <= {TOP}"""
