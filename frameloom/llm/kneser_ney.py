"""Interpolated modified Kneser-Ney n-grams of order 1 to 3, counted in Spark, stored as sorted hash arrays.

Counting runs in Spark jobs over all training texts or over what an earlier job gave:

1. words: every task counts the 64-bit hashes of its words, Spark adds the counts up and one
   task per range of hashes writes its part of the vocabulary, hashes ascending. A word's id is
   its rank over all parts.
2. grams: every task counts triples of ids (u, v, w). They are dealt out by the place of v in
   0..total, ``before[v] + count[v] / 2``, so that all triples of v meet in one shard of about
   SHARD_TOKENS tokens. There the context sums of (u, v) and the left neighbours of (v, w) are
   complete. A v that has more tokens than a shard is hot: its triples are spread by a hash of
   (u, w), and its sums are added up by
3. a job over the hot words' partial sums, dealt out by a hash of (u, v) and of (v, w).
4. contexts: sums by v, and numbers of distinct left neighbours of w, as dense arrays by id.

A shard is three tables of sorted hashes: the upper bits of a hash name a bucket of about 16
entries, the next 32 bits are stored, so a gram that was never counted is taken for another with a
chance of about 4e-9. Contexts that occur once have no entry: their sums follow from the pair.
Scoring tasks memory-map the tables. Every file is written as a whole and is the same whichever
executor writes it, so lost executors cost repeated tasks only. Nothing is pruned: the size grows
with the corpus. Where the shared folder is no mounted one, files are read, and at most READ_BYTES
of them are kept.

Tokens are runs without ASCII white space, A-Z lower-cased, then one end, which also stands
(twice) before the first word; pairs that begin with it keep their plain counts, as nothing can
stand before them. At order 2 u is left out, at order 1 words stand alone. A null text is empty and
scores its end alone. Without training texts every probability is that of one unknown word, 1. Long
texts are read whole, repeated rows count each time; there are no ties. Other columns are carried,
those named like a new one are replaced.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import deal
from frameloom.llm.common import crc_mod, get_array, id_text, keep, open_fs, per_text, put_array, put_bytes, shared_dir, small_batches, table

ORDER = 3
#: Words of a vocabulary part and tokens of a shard, about.
PART_WORDS, SHARD_TOKENS = 1 << 20, 1 << 21
#: Tokens a task holds before it adds them up.
FLUSH = 1 << 21
#: Bytes of words that are hashed at a time.
WORD_BYTES = 1 << 22
#: Bytes of files that a worker keeps in memory where the shared folder isn't mounted.
READ_BYTES = 1 << 28
#: Texts in one batch of scoring.
SCORE_ROWS = 512
ADD = 0.1


# ---- tokens ---------------------------------------------------------------------------------

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_ROOT = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """1, r, r**2, .. modulo 2**64, n at least."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _ROOT, np.uint64)])
    return _POWERS[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each word, A-Z lower-cased: a polynomial of its bytes, mixed with its size."""
    h, total = np.empty(len(starts), np.uint64), np.cumsum(sizes)
    a = 0
    while a < len(starts):  # so many words at a time that their bytes take few MB; a longer word is by itself
        z = max(a + 1, int(np.searchsorted(total, total[a] - sizes[a] + WORD_BYTES, "right")))
        first = total[a:z] - sizes[a:z] - (total[a] - sizes[a])
        place = np.arange(int(sizes[a:z].sum())) - np.repeat(first, sizes[a:z])
        letters = _LOWER[data[place + np.repeat(starts[a:z], sizes[a:z])]]
        h[a:z] = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes[a:z].max()))[place], first)
        a = z
    return gram_hash(h, sizes).view(np.int64)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts that follow each other, ends included; and how many each text has."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    source = texts.buffers()[2]
    data = np.frombuffer(source, np.uint8)[: bounds[-1]] if source and bounds[-1] else np.empty(0, np.uint8)
    word = ~_SPACE[data]
    word[: bounds[0]] = False
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    # A text's first byte starts a word, and its last ends one, whatever stands beside them.
    full = bounds[1:] > bounds[:-1]
    low, high = bounds[:-1][full], bounds[1:][full] - 1
    start[low] |= word[low]
    end[high] |= word[high]
    starts = np.flatnonzero(start)
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    h = np.full(len(starts) + len(counts), END_HASH)
    place = np.ones(len(h), bool)
    place[np.cumsum(counts + 1) - 1] = False
    h[place] = word_hashes(data, starts, np.flatnonzero(end) - starts + 1)
    return h, counts + 1


def gram_hash(*ids: np.ndarray) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x165667B19E3779F9)
        h = h ^ h >> np.uint64(29)
    return h


#: The hash of the end of a text, which is no word's: words have one byte at least.
END_HASH = gram_hash(np.zeros(1, np.uint64), np.zeros(1, np.int64)).view(np.int64)[0]


# ---- the vocabulary -------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(h)
        new = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        return h[order][new], np.add.reduceat(n[order], new)

    def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.unique(token_hashes(batch.column(0))[0], return_counts=True))
        if sum(len(h) for h, _ in held) > FLUSH:
            h, n = add()
            if len(h) > FLUSH // 2:
                yield out(h, n)
            else:
                held.append((h, n))
    if held:
        yield out(*add())


def _write_words(uri: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        h, n = group.column("h").to_numpy(), group.column("n").to_numpy()
        order = np.argsort(h)
        put_array(f"{uri}/words-{part:06d}.hash", h[order])
        put_array(f"{uri}/words-{part:06d}.count", n[order])
        hot = int(n[n > SHARD_TOKENS].sum())
        return pa.table([pa.array([x], pa.int64()) for x in (part, len(h), int(n.sum()), hot)], names=["part", "words", "tokens", "hot"])

    return run


class Vocabulary:
    """The words' sorted hashes, and their counts, over all parts; mapped, not read."""

    def __init__(self, uri: str):
        self.meta = _meta(uri, "words")
        parts = self.meta["parts"]
        self.first = np.cumsum([0, *(p[1] for p in parts)])
        self.before = np.cumsum([0, *(p[2] for p in parts)])
        self.hash = [get_array(f"{uri}/words-{p[0]:06d}.hash", np.int64) for p in parts]
        self.count = [get_array(f"{uri}/words-{p[0]:06d}.count", np.int64) for p in parts]
        self.lows = np.array([h[0] for h in self.hash], np.int64)
        self.end = int(self.find(np.array([END_HASH]))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        which = np.searchsorted(self.lows, h, "right") - 1
        for p, own in _groups(which):
            if p >= 0:
                at = np.minimum(np.searchsorted(self.hash[p], h[own]), len(self.hash[p]) - 1)
                out[own] = np.where(self.hash[p][at] == h[own], self.first[p] + at, -1)
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the hashes of tokens."""
        if not len(hashes):
            return np.empty(0, np.int64)
        new, which = np.unique(hashes, return_inverse=True)
        return self.find(new)[which]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return dense(self.count, self.first, ids)


def _groups(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number with the places where it stands."""
    if not len(numbers):
        return
    low = int(numbers.min())
    small = (numbers - low).astype(np.uint16) if int(numbers.max()) - low < 1 << 16 else numbers
    order = np.argsort(small, kind="stable")
    ends = np.flatnonzero(np.r_[True, np.diff(numbers[order]) != 0, True])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(numbers[order[a]]), order[a:b]


def dense(parts: list[np.ndarray], first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Values (or rows) at ids of arrays that follow each other; 0 at -1."""
    shape = parts[0].shape[1:] if parts else ()
    out = np.zeros((len(ids), *shape), parts[0].dtype if parts else np.int64)
    for p, own in _groups(np.searchsorted(first, ids, "right") - 1):
        if p >= 0:
            out[own] = parts[p][ids[own] - first[p]]
    return out


def _meta(uri: str, name: str) -> dict:
    filesystem, path = open_fs(f"{uri}/{name}.json")
    with filesystem.open_input_file(path) as source:
        return json.loads(source.read())


@lru_cache(maxsize=1)
def vocabulary(uri: str) -> Vocabulary:
    return Vocabulary(uri)


def count_words(texts: DataFrame, uri: str) -> dict:
    """Write the vocabulary of a column of texts; its parts (number, words, tokens), words, tokens, and tokens of hot words."""
    counted = texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = keep(counted, f"{uri}/word_counts")
    parts = max(1, -(-counted.count() // PART_WORDS))
    # Hashes are even over 64 bits, so equal ranges of their upper 32 bits hold about as many words each.
    part = ((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(parts) / F.lit(1 << 32)).cast("int")
    written = counted.withColumn("part", part).groupBy("part").applyInArrow(_write_words(uri), "part long, words long, tokens long, hot long")
    rows = sorted(tuple(r) for r in keep(written, f"{uri}/word_parts").collect())
    words, seen, hot = (sum(r[i] for r in rows) for i in (1, 2, 3))
    if words >= 1 << 31:
        raise ValueError("more than 2**31 words")
    meta = {"parts": [r[:3] for r in rows], "words": words, "tokens": seen, "hot": hot}
    put_bytes(f"{uri}/words.json", json.dumps(meta).encode())
    return meta


# ---- tables of hashes -----------------------------------------------------------------------


def put_table(base: str, h: np.ndarray, values: np.ndarray) -> None:
    """Rows of small counts by hash: bucket bounds, 32 bits of each hash, counts of one byte, and the larger counts."""
    order = np.argsort(h)
    h, values = h[order], values[order]
    bits = max(1, len(h).bit_length() - 4)
    flat = np.ascontiguousarray(values, np.int64).ravel()
    many = np.flatnonzero(flat >= 255)
    put_array(f"{base}.bounds", np.searchsorted(h >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)).astype(np.uint32))
    put_array(f"{base}.hash", (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32))
    put_array(f"{base}.count", np.minimum(flat, 255).astype(np.uint8))
    put_array(f"{base}.many", np.stack([many, flat[many]]))


class Table:
    """A stored table of hashes."""

    def __init__(self, base: str, width: int):
        self.bounds, self.hash = (get_array(f"{base}.{name}", np.uint32) for name in ("bounds", "hash"))
        self.count = get_array(f"{base}.count", np.uint8).reshape(-1, width)
        self.many = get_array(f"{base}.many", np.int64).reshape(2, -1)
        self.bits, self.width = max(1, (len(self.bounds) - 1).bit_length() - 1), width
        self.steps = int(np.diff(self.bounds.astype(np.int64)).max(initial=0)).bit_length()
        self.bytes = sum(0 if isinstance(a.base, np.memmap) else a.nbytes for a in (self.bounds, self.hash, self.count, self.many))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The counts of each hash, 0 where it has none."""
        out = np.zeros((len(h), self.width), np.int64)
        if not len(self.hash):
            return out
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        want = (h << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
        low, end = self.bounds[bucket].astype(np.int64), self.bounds[bucket + 1].astype(np.int64)
        high = end
        for _ in range(self.steps):
            mid = (low + high) >> 1
            less = (low < high) & (self.hash[np.minimum(mid, len(self.hash) - 1)] < want)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        at = np.minimum(low, len(self.hash) - 1)
        hit = np.flatnonzero((low < end) & (self.hash[at] == want))
        own = self.count[at[hit]].astype(np.int64)
        rows, columns = np.nonzero(own == 255)
        if len(rows):
            own[rows, columns] = self.many[1][np.searchsorted(self.many[0], at[hit][rows] * self.width + columns)]
        out[hit] = own
        return out


class Tables:
    """The tables of a model by name and shard; those that had to be read are kept up to READ_BYTES."""

    def __init__(self, uri: str):
        self.uri, self.open, self.bytes = uri, OrderedDict(), 0

    def find(self, name: str, shard: int, h: np.ndarray, width: int) -> np.ndarray:
        key = (name, shard)
        if key not in self.open:
            base = f"{self.uri}/{name}-{shard:07d}"
            filesystem, path = open_fs(f"{base}.bounds")
            self.open[key] = Table(base, width) if filesystem.get_file_info(path).is_file else None
            self.bytes += self.open[key].bytes if self.open[key] else 0
        self.open.move_to_end(key)
        while self.bytes > READ_BYTES and len(self.open) > 1:
            old = self.open.popitem(last=False)[1]
            self.bytes -= old.bytes if old else 0
        found = self.open[key]
        return found.find(h) if found else np.zeros((len(h), width), np.int64)


# ---- counting grams -------------------------------------------------------------------------


class Layout:
    """Which shard a triple of ids, and a hot word's sums, are stored in."""

    def __init__(self, words: Vocabulary):
        self.words, self.total = words, words.meta["tokens"]
        self.shards = max(1, -(-self.total // SHARD_TOKENS))
        self.hot_shards = max(1, -(-words.meta["hot"] // SHARD_TOKENS))
        self.known: dict[int, np.ndarray] = {}

    def _tokens(self, p: int) -> np.ndarray:
        """Of the words of a part the tokens before each, and its own; computed once a worker and part."""
        if p not in self.known:
            c = self.words.count[p]
            self.known[p] = np.stack([np.cumsum(c) - c + self.words.before[p], c], axis=1).astype(np.float64)
        return self.known[p]

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each triple, and whether v is hot."""
        place = np.zeros((len(v), 2))
        for p, own in _groups(np.searchsorted(self.words.first, v, "right") - 1):
            place[own] = self._tokens(p)[v[own] - self.words.first[p]]
        hot, share = place[:, 1] > SHARD_TOKENS, np.full(len(v), 0.5)
        share[hot] = gram_hash(u[hot], w[hot]) / 2.0**64
        at = (place[:, 0] + place[:, 1] * share) * (self.shards / self.total)
        return np.minimum(at, self.shards - 1).astype(np.int64), hot

    def hot_shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.hot_shards) >> np.uint64(32)).astype(np.int64)


@lru_cache(maxsize=1)
def layout(uri: str) -> Layout:
    return Layout(vocabulary(uri))


def _added(first: np.ndarray, second: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (first, second) below 2**32 each, once each in ascending order, with the sums of their values."""
    key = first << 32 | second
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sums = [np.add.reduceat(x[order], new) if len(new) else x[:0] for x in values]
    return [key[new] >> 32, key[new] & 0xFFFFFFFF, *sums]


def _kinds(n: np.ndarray) -> list[np.ndarray]:
    """Of counts: themselves, and whether they are 1, 2, 3 or more."""
    return [n, *(x.astype(np.int64) for x in (n == 1, n == 2, n >= 3))]


def _by(ids: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of values by id."""
    return [x for i, x in enumerate(_added(np.zeros_like(ids), ids, values)) if i > 0]


def _add_triples(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Triples once each, ordered by v and u, with their counts; and the number of their context (u, v)."""
    key = v << 32 | u
    contexts, at = np.unique(key, return_inverse=True)
    at, w, n = _added(at.astype(np.int64), w, [n])
    return [contexts[at] & 0xFFFFFFFF, contexts[at] >> 32, w, n, at]


def _count_grams(uri: str, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, places = vocabulary(uri), layout(uri)
        wide = deal.width(places.shards)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            u, v, w, n, _ = _add_triples(*_triples(ids, lengths, words.end, order), np.ones(len(ids), np.int64))
            return deal.batch(*deal.cut(places.shard(u, v, w)[0], [v, u, w, n], wide))

        for batch in batches:
            if batch.num_rows:
                hashes, lengths = token_hashes(batch.column(0))
                held.append((words.ids(hashes), lengths))
            if sum(len(x) for x, _ in held) > FLUSH:
                yield out()
        if held:
            yield out()

    return run


def _triples(w: np.ndarray, lengths: np.ndarray, end: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) of every token of texts that follow each other; what the order leaves out is the end."""
    starts = np.cumsum(lengths) - lengths
    v = np.r_[end, w[:-1]]
    v[starts] = end
    u = np.r_[end, v[:-1]]
    u[starts] = end
    return (np.full(len(w), end), v, w) if order == 2 else (u, v, w)


#: Rows of the counting jobs: kind 0 has numbers of counts 1 to 4 (grams', then pairs'); 1 and 2 are hot words' partial sums of contexts
#: and pairs, dealt out to hot shards; 3 and 4 are sums by v and left neighbours by w, dealt out to parts of the vocabulary.
_ROWS = "kind int, key long, block binary"


class _Out:
    """Collects the rows of a counting task."""

    def __init__(self, places: Layout):
        self.places, self.kind, self.key, self.block = places, [], [], []

    def add(self, kind: int, targets: np.ndarray, columns: list[np.ndarray], n: int) -> None:
        keys, blocks = deal.cut(targets, columns, deal.width(n))
        self.kind += [kind] * len(keys)
        self.key += keys
        self.block += blocks

    def lower(self, v: np.ndarray, w: np.ndarray, left: np.ndarray) -> None:
        """Complete pairs: their sums by v, and left neighbours by w."""
        first, parts = self.places.words.first, len(self.places.words.hash)
        part = lambda ids: np.searchsorted(first, ids, "right") - 1
        by_v, *sums = _by(v, _kinds(left))
        self.add(3, part(by_v), [by_v, *sums], parts)
        by_w, n = _by(w, [np.ones(len(w), np.int64)])
        self.add(4, part(by_w), [by_w, n], parts)

    def numbers(self, grams: np.ndarray, pairs: np.ndarray) -> None:
        self.kind.append(0)
        self.key.append(0)
        self.block.append(np.array([int((x == i).sum()) for x in (grams, pairs) for i in (1, 2, 3, 4)], np.int64).tobytes())

    def table(self) -> pa.Table:
        return pa.table([pa.array(self.kind, pa.int32()), pa.array(self.key, pa.int64()), pa.array(self.block, pa.binary())], names=["kind", "key", "block"])


def _put_sums(base: str, u: np.ndarray, v: np.ndarray, sums: list[np.ndarray]) -> None:
    """Store the sums of contexts; those that occur once are left out."""
    more = sums[0] > 1
    put_table(base, gram_hash(v[more], u[more]), np.stack([x[more] for x in sums], axis=1))


def _write_grams(uri: str, order: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, places = key[0].as_py(), layout(uri)
        v, u, w, n = deal.gather(group.column("block").to_pylist())
        u, v, w, n, at = _add_triples(u, v, w, n)
        put_table(f"{uri}/grams-{shard:07d}", gram_hash(u, v, w), n)
        out, hot = _Out(places), places.shard(u, v, w)[1]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums = [np.add.reduceat(x, new) for x in _kinds(n)]
        cu, cv, often = u[new], v[new], hot[new]
        _put_sums(f"{uri}/contexts-{shard:07d}", cu[~often], cv[~often], [x[~often] for x in sums])
        out.add(1, places.hot_shard(gram_hash(cv[often], cu[often])), [cv[often], cu[often], *(x[often] for x in sums)], places.hot_shards)
        # A pair that begins with the end keeps its count; any other counts what stands before it.
        pv, pw, left = _added(v, w, [np.where(v == places.words.end, n, 1)])
        often = np.isin(pv, v[hot])
        if order == 3:
            put_table(f"{uri}/pairs-{shard:07d}", gram_hash(pv[~often], pw[~often]), left[~often])
        out.lower(pv[~often], pw[~often], left[~often])
        out.add(2, places.hot_shard(gram_hash(pv[often], pw[often])), [pv[often], pw[often], left[often]], places.hot_shards)
        out.numbers(n, left[~often])
        return out.table()

    return run


def _write_hot(uri: str, order: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        pairs, shard, places = key[0].as_py() == 2, key[1].as_py(), layout(uri)
        v, x, *sums = deal.gather(group.column("block").to_pylist())
        v, x, *sums = _added(v, x, sums)
        out = _Out(places)
        if pairs:
            if order == 3:
                put_table(f"{uri}/hot_pairs-{shard:07d}", gram_hash(v, x), sums[0])
            out.lower(v, x, sums[0])
            out.numbers(sums[0][:0], sums[0])
        else:
            _put_sums(f"{uri}/hot_contexts-{shard:07d}", x, v, sums)
        return out.table()

    return run


def _write_contexts(uri: str, first: list[int]):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lefts, part = key[0].as_py() == 4, key[1].as_py()
        low, size = first[part], first[part + 1] - first[part]
        ids, *sums = deal.gather(group.column("block").to_pylist())
        rows = np.zeros((size, len(sums)), np.int64)
        for k, x in enumerate(sums):
            np.add.at(rows[:, k], ids - low, x)
        put_array(f"{uri}/{'lefts' if lefts else 'sums'}-{part:06d}", rows)
        numbers = [int(rows.sum()), *(int((rows == i).sum()) for i in (1, 2, 3, 4))] if lefts else [0] * 5
        return pa.table([pa.array([x], pa.int64()) for x in numbers], names=["pairs", "n1", "n2", "n3", "n4"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many counts are 1 to 4; 0.5, 1, 1.5 where these are too few."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), c - 0.05) for c, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train(docs: DataFrame, uri: str, text_col: str = "text", order: int = ORDER) -> None:
    """Count the texts of docs and store the model of that order in the shared folder uri."""
    if order not in (1, 2, 3):
        raise ValueError("the order is 1, 2 or 3")
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    meta = count_words(texts, uri)
    model = {"order": order, "pairs": 0, "grams": discounts(0, 0, 0, 0), "pair": discounts(0, 0, 0, 0), "low": discounts(0, 0, 0, 0), "one": 0, "two": 0}
    if meta["tokens"]:
        lowest, high = (_unigrams if order == 1 else _grams)(texts, uri, meta, order)
        model |= {"pairs": lowest[0], "low": discounts(*lowest[1:]), "one": lowest[1], "two": lowest[2], "grams": discounts(*high[:4]), "pair": discounts(*high[4:])}
    put_bytes(f"{uri}/model.json", json.dumps(model).encode())


def _unigrams(texts: DataFrame, uri: str, meta: dict, order: int) -> tuple[list[int], list[int]]:
    """Sum of the words' counts, and how many are 1 to 4."""
    n = F.col("n")
    row = texts.sparkSession.read.parquet(f"{uri}/word_counts").agg(F.sum(n), *(F.count_if(n == i) for i in (1, 2, 3, 4))).first()
    return list(row), [0] * 8


def _dealt(rows: DataFrame, kind: int, n: int) -> DataFrame:
    """The blocks of a kind, dealt out to n targets."""
    return deal.deal(rows.where(F.col("kind") == kind).select("key", "block"), n).withColumn("kind", F.lit(kind))


def _grams(texts: DataFrame, uri: str, meta: dict, order: int) -> tuple[list[int], list[int]]:
    """Write the tables; number of pairs and how many words have 1 to 4 left neighbours; numbers of counts 1 to 4 of grams and pairs."""
    shards = max(1, -(-meta["tokens"] // SHARD_TOKENS))
    hot_shards = max(1, -(-meta["hot"] // SHARD_TOKENS))
    first = [int(x) for x in np.cumsum([0, *(p[1] for p in meta["parts"])])]
    dealt = deal.deal(texts.mapInArrow(_count_grams(uri, order), deal.SCHEMA), shards)
    rows = keep(dealt.groupBy("key").applyInArrow(_write_grams(uri, order), _ROWS), f"{uri}/counted")
    if meta["hot"]:
        hot = _dealt(rows, 1, hot_shards).unionByName(_dealt(rows, 2, hot_shards))
        rows = rows.unionByName(keep(hot.groupBy("kind", "key").applyInArrow(_write_hot(uri, order), _ROWS), f"{uri}/counted_hot"))
    lower = _dealt(rows, 3, len(meta["parts"])).unionByName(_dealt(rows, 4, len(meta["parts"])))
    written = keep(lower.groupBy("kind", "key").applyInArrow(_write_contexts(uri, first), "pairs long, n1 long, n2 long, n3 long, n4 long"), f"{uri}/lower")
    lowest = written.agg(*(F.sum(c) for c in written.columns)).first()

    def numbers(blocks: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b, np.int64).tolist() for b in blocks.to_pylist()], pa.list_(pa.int64()))

    counts = rows.where("kind = 0").select(F.arrow_udf(numbers, "array<long>")("block").alias("c"))
    high = counts.agg(*(F.sum(F.get("c", F.lit(i))) for i in range(8))).first()
    return list(lowest), list(high)


# ---- scoring --------------------------------------------------------------------------------


class Model:
    """The stored model, mapped by a worker."""

    def __init__(self, uri: str):
        self.uri, self.words, self.meta = uri, vocabulary(uri), _meta(uri, "model")
        self.layout, self.tables = layout(uri), Tables(uri)
        m, n = self.meta, self.words.meta["words"]
        parts = range(len(self.words.hash)) if m["pairs"] and m["order"] > 1 else ()
        self.sums = [get_array(f"{uri}/sums-{p:06d}", np.int64).reshape(-1, 4) for p in parts]
        self.lefts = [get_array(f"{uri}/lefts-{p:06d}", np.int64) for p in parts] if m["order"] > 1 else self.words.count
        d = m["low"]
        self.low_mass = (d[0] * m["one"] + d[1] * m["two"] + d[2] * (n - m["one"] - m["two"])) / m["pairs"] if m["pairs"] else 1.0

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text: tokens, known tokens, log10 of the base and of the model's probability."""
        hashes, lengths = token_hashes(texts)
        w = self.words.ids(hashes)
        starts = np.cumsum(lengths) - lengths
        c = self.words.counts(w)
        base = np.log10((c + ADD) / (self.words.meta["tokens"] + ADD * (self.words.meta["words"] + 1)))
        logs = np.log10(self._probability(w, lengths))
        add = lambda x: np.add.reduceat(x, starts)
        return [lengths, add((c > 0).astype(np.int64)), add(base), add(logs)]

    def _probability(self, w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m, uniform = self.meta, 1 / (self.words.meta["words"] + 1)
        if not m["pairs"]:
            return np.full(len(w), uniform)
        left = dense(self.lefts, self.words.first, w)
        p = (left - np.array([0.0, *m["low"]])[np.minimum(left, 3)]) / m["pairs"] + self.low_mass * uniform
        if m["order"] == 1:
            return p
        u, v, w = _triples(w, lengths, self.words.end, m["order"])
        n, sums, pairs = self._look_up(u, v, w)
        seen = v >= 0
        if m["order"] == 3:
            p = self._interpolate(pairs, dense(self.sums, self.words.first, v), m["pair"], p)
            # The pair (u, v) is that of the token before; the first token of a text follows two ends.
            seen = np.r_[True, pairs[:-1] > 0]
            seen[np.cumsum(lengths) - lengths] = True
        once = seen & (sums[:, 0] == 0)
        sums[once, :2] = 1
        return self._interpolate(n, sums, m["grams"], p)

    @staticmethod
    def _interpolate(n: np.ndarray, sums: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
        """The counts' discounted share of their context, and the lower order for what is left; the lower order where the context is new."""
        total = sums[:, 0].astype(np.float64)
        known = total > 0
        total[~known] = 1.0
        high = (n - np.array([0.0, *d])[np.minimum(n, 3)]) / total + (sums[:, 1:] @ np.array(d)) / total * lower
        return np.where(known, high, lower)

    def _look_up(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of triples, sums of their contexts (0 for what occurs once), left neighbours of pairs."""
        n, sums, pairs = np.zeros(len(w), np.int64), np.zeros((len(w), 4), np.int64), np.zeros(len(w), np.int64)
        both = np.flatnonzero((v >= 0) & (w >= 0))
        context = np.flatnonzero((u >= 0) & (v >= 0))
        every = np.flatnonzero(v >= 0)
        shard, hot = np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        shard[every], hot[every] = self.layout.shard(u[every], v[every], w[every])
        whole = both[u[both] >= 0]
        self._each("grams", shard[whole], gram_hash(u[whole], v[whole], w[whole]), n, whole)
        for rare in (True, False):
            own = context[hot[context] != rare]
            h = gram_hash(v[own], u[own])
            self._each("contexts" if rare else "hot_contexts", shard[own] if rare else self.layout.hot_shard(h), h, sums, own)
            if self.meta["order"] == 3:
                own = both[hot[both] != rare]
                h = gram_hash(v[own], w[own])
                self._each("pairs" if rare else "hot_pairs", shard[own] if rare else self.layout.hot_shard(h), h, pairs, own)
        return n, sums, pairs

    def _each(self, name: str, shard: np.ndarray, h: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        """Put what the table of that name has for hashes into rows of out, shard by shard."""
        for s, own in _groups(shard):
            found = self.tables.find(name, s, h[own], 1 if out.ndim == 1 else out.shape[1])
            out[rows[own]] = found[:, 0] if out.ndim == 1 else found


@lru_cache(maxsize=1)
def model(uri: str) -> Model:
    return Model(uri)


def score(docs: DataFrame, uri: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score and score by the stored model."""

    def work(texts: pa.Array) -> list:
        return [pa.array(x) for x in model(uri).score(texts)] if len(texts) else [[], [], [], []]

    return per_text(docs, "n_tokens long, n_known long, base_score double, score double", work, text_col, arrow_texts=True)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the nine tenths that aren't held out."""
    small_batches(spark, SCORE_ROWS)
    docs = id_text(table(spark, sf_dir, "documents")).withColumn("held_out", crc_mod("doc_id", 10) == 0)
    uri = shared_dir(spark, "kneser-ney")
    train(docs.where(~F.col("held_out")), uri)
    tokens_seen = _meta(uri, "words")["tokens"]
    scored = score(docs, uri).withColumn("train_tokens", F.lit(tokens_seen).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
