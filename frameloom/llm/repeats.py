"""Suffix-array deduplication of repeated passages, by deep-shallow sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
id. Every start of LENGTH bytes is a suffix here, and suffixes are sorted by their first LENGTH
bytes: multikey quicksort, 8 bytes a key, orders them down to a shallow depth of 16 bytes (only what ties in
one key is sorted by the next), and what still ties is ordered by blind tries, which look only at the bytes where members go apart. Equal
suffixes are then neighbours, and the smallest id among them tells which ones repeat.

Only suffixes that may have an equal are sorted. Each is given to an anchor, the GRAM bytes with
the least hash among those inside its first LENGTH bytes, so equal suffixes have equal anchors at
equal places. The steps, each a Spark job whose result is a table in the shared folder:

1. documents are written as chunk files, text and all, of at most CHUNK_BYTES of text or one document each;
2. each chunk gives the sorted hashes of its anchors and of the HALF bytes before and after each, dealt by the anchor's hash; a
   task per range of hashes answers which of them other chunks have with the same bytes before or after. Of the
   LENGTH - GRAM bytes that equal suffixes have around an anchor, HALF at least stand on one side of it, so no others can have an equal;
   anchors that repeat by chance, whose number grows faster than the texts', end here;
3. each chunk gives the bytes around its repeated anchors (a span, up to 84 bytes, for all suffixes
   of an anchor), equal spans of a chunk once, for their smallest id, dealt by the anchor's hash;
   an anchor with very many spans is dealt by its suffixes' own hashes instead, so that no task
   gets all places of a frequent string;
4. a task per share of the hashes sorts the suffixes and answers which ones repeat;
5. each chunk takes the answers and cuts its texts.

Hashes only deal out work; equality is that of bytes. Texts never go through a shuffle. What goes
to ranges and shares and back to chunks is dealt out in levels (deal.py), so rows of the shuffles
grow with the entries. Tasks write whole files with the same content whichever executor runs them.

Null texts are empty and stay null in texts that are returned; texts under LENGTH bytes lose
nothing. Rows that repeat an id don't count as copies of each other; null ids count as larger
than all others. An empty table stays empty. Columns of docs are carried, those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.llm import deal
from frameloom.llm.common import give_back, keep, open_fs, pack, put_bytes, shared_dir, small_batches, table, unpack

LENGTH, GRAM = 50, 16
#: Bytes of text and rows of a chunk file; bytes whose anchors are looked for at a time.
CHUNK_BYTES, CHUNK_ROWS, BLOCK = 6 << 20, 4000, 1 << 19
#: Anchors of a range of hashes in step 2 and of a share in step 4, about.
RANGE, SHARE = 500_000, 60_000
#: Bytes on one side of an anchor that step 2 compares, and the bits of a key there: 32 of the anchor's hash, then those of the bytes after and
#: before (0: not in the span). Two anchors taken for one only give spans that have no equal.
HALF, AFTER, BEFORE = (LENGTH - GRAM + 1) // 2, np.uint64(16), np.uint64(15)
#: An anchor with so many spans, each chunk's different ones counted, is frequent.
FREQUENT = 2000
NO_ID = (1 << 63) - 1
#: Bytes of the longest span; spans that are cut out at a time.
WIDE, PART = 2 * LENGTH - GRAM, 1 << 18


# ---- anchors ----------------------------------------------------------------------------------


def _words(data: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The 8 bytes from each place on, as numbers; a view."""
    return np.ndarray((len(data) - 7,), dtype, data.data, 0, (1,))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += y
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


def window_hash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH bytes from each start."""
    w, h = _words(data), np.zeros(len(starts), np.uint64)
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        h = _mix(h + w[starts + at], np.uint64(at))
    return h


def span_hash(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans, which are at least LENGTH and less than twice LENGTH bytes long."""
    return _mix(_mix(window_hash(data, first), window_hash(data, first + size - LENGTH)), size.astype(np.uint64))


def side_hash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the HALF bytes from each start."""
    w, h = _words(data), np.zeros(len(starts), np.uint64)
    for at in (*range(0, HALF - 7, 8), HALF - 8):
        h = _mix(h + w[starts + at], np.uint64(at))
    return h


def side_keys(data: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of anchors with these hashes at these places: their hash, and those of the bytes after and before as far as the span holds them."""
    def part(starts: np.ndarray, inside: np.ndarray, bits: np.uint64) -> np.ndarray:
        found = np.zeros(len(starts), np.uint64)
        found[inside] = np.maximum(side_hash(data, starts[inside]) >> np.uint64(64) - bits, np.uint64(1))
        return found

    after = part(place + GRAM, last + LENGTH >= place + GRAM + HALF, AFTER)
    before = part(place - HALF, place - first >= HALF, BEFORE)
    return (h >> np.uint64(32) << AFTER | after) << BEFORE | before


def _sides(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys the anchor's hash; with the bytes after, and with those before; and which of the two there are, as two rows."""
    h, before = keys >> AFTER + BEFORE, keys & (np.uint64(1) << BEFORE) - np.uint64(1)
    after = keys >> BEFORE
    return h, after, h << BEFORE | before, np.stack([after & (np.uint64(1) << AFTER) - np.uint64(1) > 0, before > 0])


def _met(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which keys share their anchor, and the bytes on a side of it, with one of another place; each is at places from low to high."""
    _, *sides, there = _sides(keys)
    met = np.zeros(len(keys), bool)
    for side, held in zip(sides, there, strict=True):
        some = np.flatnonzero(held)
        some = some[np.argsort(side[some])]
        if not len(some):
            continue
        new = np.flatnonzero(np.r_[True, side[some[1:]] != side[some[:-1]]])
        apart = np.minimum.reduceat(low[some], new) != np.maximum.reduceat(high[some], new)
        met[some] |= np.repeat(apart, np.diff(np.r_[new, len(some)]))
    return met


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that end at ends: anchor hashes, the first and last start of the suffixes of each, and its place."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    w = _words(data)
    h = _mix(w[: n - GRAM + 1], w[8 : n - GRAM + 9])
    bits = np.uint64(max(1, int(n).bit_length()))
    least = h >> bits << bits | np.arange(len(h), dtype=np.uint64)  # ties go to the first place
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # A suffix must not go beyond its text.
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    place = (least[at] & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.empty(0, np.int64)
    last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
    # Anchors have small hashes, being the least; mixed once more, the hashes deal them out evenly.
    return _mix(h[place[new]], np.uint64(LENGTH)), at[new], at[last], place[new]


class Chunk:
    """The texts of a chunk file, one after the other, and their anchors."""

    def __init__(self, uri: str, number: int, anchors: bool = True):
        filesystem, path = open_fs(_chunk_file(uri, number))
        self.table = pq.read_table(path, filesystem=filesystem)
        column = self.table.column("__bytes").combine_chunks()
        texts = column.to_pylist()
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        self.starts = self.ends - [len(x) for x in texts] if texts else self.ends
        self.data = np.frombuffer(b"".join(texts) + bytes(WIDE), np.uint8)
        self.ids = np.array([NO_ID if x is None else x for x in self.table.column("__id").to_pylist()], np.int64)
        if not anchors:
            return
        found, row = [(np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)], 0
        while row < len(texts):
            low = int(self.starts[row])
            after = max(row + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            h, *places = _anchors(self.data[low : int(self.ends[after - 1])], self.ends[row:after] - low)
            found.append((h, *(x + low for x in places)))
            row = after
        self.h, self.a, self.b, place = (np.concatenate(x) for x in zip(*found, strict=True))
        self.keys = side_keys(self.data, self.h, self.a, self.b, place)
        self.row = np.searchsorted(self.ends, self.a, "right")


# ---- step 1: chunk files ------------------------------------------------------------------------


def _chunk_file(uri: str, number: int) -> str:
    return f"{uri}/chunks/{number:016x}"


def _write_chunks(uri: str):
    """Each task writes its rows as chunk files, named by its number and a count; rows (chunk, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def out() -> pa.RecordBatch:
            nonlocal number, size, rows
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_batches(held), sink, compression="zstd")
            put_bytes(_chunk_file(uri, number), sink.getvalue())
            made = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size])], names=["chunk", "bytes"])
            held.clear()
            number, size, rows = number + 1, 0, 0
            return made

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index("__bytes"))).to_pylist()
            start = 0
            for i, n in enumerate(lengths):
                if rows and (size + n > CHUNK_BYTES or rows >= CHUNK_ROWS):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield out()
                    start = i
                size, rows = size + n, rows + 1
            if len(lengths) > start:
                held.append(batch.slice(start))
        if held:
            yield out()

    return run


# ---- step 2: which anchors repeat ---------------------------------------------------------------


def _deal(h: np.ndarray, shares: int) -> np.ndarray:
    """The share of each hash, ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _chunk_at(at: int, most: int) -> int:
    """The number of the chunk that is target at of a deal, where a task has written most chunks at most."""
    return at // most << 32 | at % most


def _entries(group: pa.Table, n: int) -> list[np.ndarray]:
    """The n columns of a group's blocks."""
    blocks = [x for x in group.column("block").to_pylist() if x]
    return deal.gather(blocks) if blocks else [np.empty(0, np.int64)] * n


def _dealt(targets: np.ndarray, columns: list[np.ndarray], wide: int) -> pa.Table:
    """Blocks of entries for ranges of so many targets, and how many entries each has."""
    keys, blocks = deal.cut(targets, columns, wide)
    sizes = np.unique(targets // wide, return_counts=True)[1]
    return pa.table({"key": pa.array(keys, pa.int64()), "block": pa.array(blocks, pa.binary()), "entries": pa.array(sizes, pa.int64())})


DEALT = "key long, block binary, entries long"


def _give_hashes(uri: str, ranges: int, most: int):
    wide = deal.width(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                give_back()
                chunk = Chunk(uri, _chunk_at(at, most))
                # Of each key its number and how many different spans it has here; equal spans have one key.
                _, first = np.unique(_mix(chunk.h, span_hash(chunk.data, chunk.a, chunk.b - chunk.a + LENGTH)), return_index=True)
                keys, n = np.unique(chunk.keys[first], return_counts=True)
                h = keys >> AFTER + BEFORE << np.uint64(32)
                yield from _dealt(_deal(h, ranges), [keys.view(np.int64), n, np.arange(len(keys)), np.full(len(keys), at)], wide).to_batches()

    return run


def _answer_hashes(targets: int):
    wide = deal.width(targets)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        """For chunks: 1 for a key that meets one of another chunk, 2 if its anchor is frequent."""
        give_back()
        keys, n, number, at = _entries(group, 4)
        keys = keys.view(np.uint64)
        some = np.flatnonzero(_met(keys, at, at))
        _, which = np.unique(_sides(keys)[0], return_inverse=True)
        many = np.bincount(which, n)[which[some]] >= FREQUENT
        some, many = some[order := np.lexsort((number[some], at[some]))], many[order]
        return _dealt(at[some], [number[some], 1 + many.astype(np.int64)], wide)

    return run


# ---- step 3: spans ------------------------------------------------------------------------------


def _give_spans(uri: str, shares: int, most: int):
    wide = deal.width(shares)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        give_back()
        c = _chunk_at(key[0].as_py(), most)
        chunk = Chunk(uri, c)
        keys, at, which = np.unique(chunk.keys, return_index=True, return_inverse=True)
        number, given = _entries(group, 2)
        marks = np.zeros(len(keys), np.uint8)
        marks[number] = given
        # Keys of two documents of this chunk meet as well. An anchor is frequent for all its keys here or for none, as these may meet.
        last = np.empty(len(keys), np.int64)
        last[which] = np.arange(len(which))
        needed = (marks > 0) | _met(keys, chunk.row[at], chunk.row[last])
        _, anchor = np.unique(_sides(keys)[0], return_inverse=True)
        frequent = (np.bincount(anchor, marks == 2) > 0)[anchor]
        mark = (needed * (1 + frequent))[which]
        some, often = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        # Suffixes of frequent anchors are spans of their own.
        count = chunk.b[often] - chunk.a[often] + 1
        single = np.repeat(chunk.a[often] - np.r_[0, np.cumsum(count)[:-1]] if len(often) else count, count) + np.arange(count.sum())
        first = np.concatenate([chunk.a[some], single])
        size = np.concatenate([chunk.b[some] - chunk.a[some] + LENGTH, np.full(len(single), LENGTH)]).astype(np.int64)
        row = np.concatenate([chunk.row[some], np.repeat(chunk.row[often], count)])
        h = np.concatenate([chunk.h[some], window_hash(chunk.data, single)])
        # Equal spans next to each other, the smallest id first; entry numbers a span's content.
        content = span_hash(chunk.data, first, size)
        order = np.lexsort((chunk.ids[row], content))
        new = np.ones(len(order), bool)
        new[1:] = content[order[1:]] != content[order[:-1]]
        leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        new |= ~_equal_spans(chunk.data, first, size, order, order[leader])  # a hash that means two contents
        entry = np.cumsum(new) - 1
        lead = order[new]  # the first place of each entry; entries are numbered as they stand in the texts
        by_place = np.argsort(first[lead])
        rank = np.empty(len(lead), np.int64)
        rank[by_place] = np.arange(len(lead))
        lead, entry = lead[by_place], rank[entry]
        own = chunk.ids[row[order]] == chunk.ids[row[lead[entry]]]
        asked, sure = order[own], np.sort(order[~own])
        by_place = np.argsort(first[asked])
        asked, entry = asked[by_place], entry[own][by_place]
        put_bytes(f"{uri}/local/{c:016x}", _pack_all([entry, first[asked], size[asked], first[sure], size[sure]]))
        # Of each entry the size and the bytes, so many entries at a time.
        made, views = [], np.lib.stride_tricks.sliding_window_view(chunk.data, WIDE)
        for low in range(0, max(1, len(lead)), PART):
            part = lead[low : low + PART]
            spans = np.column_stack([size[part].astype(np.uint8), views[first[part]]])
            spans[:, 1:][np.arange(WIDE) >= spans[:, :1]] = 0
            columns = [spans, chunk.ids[row[part]], np.full(len(part), key[0].as_py()), np.arange(low, low + len(part))]
            made.append(_dealt(_deal(h[part], shares), columns, wide))
        return pa.concat_tables(made)

    return run


def _equal_spans(data: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans a and b (their numbers) hold the same bytes; a span is shorter than two suffixes."""
    w, same = _words(data), size[a] == size[b]
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= w[first[a] + at] == w[first[b] + at]
        same &= w[first[a] + size[a] - LENGTH + at] == w[first[b] + size[b] - LENGTH + at]
    return same


def _pack_all(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any lengths in one compressed block."""
    blobs = [pack(x) for x in arrays]
    return np.array([len(arrays), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)


def _unpack_all(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    cuts = np.cumsum([8 * (n + 1), *np.frombuffer(data, np.int64, n, 8)])
    return [unpack(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


# ---- step 4: deep-shallow sorting ---------------------------------------------------------------


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of length bytes from starts: their order, and where in it a new string begins.

    data goes on for 8 bytes after the last string at least.
    """
    words = _words(data, ">u8")
    offsets = [*range(0, length - 7, 8), length - 8]
    # Shallow: multikey quicksort. Quicksort by the first 8 bytes; the groups that tie, and only those, by the next 8.
    key = words[starts].astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    tied = np.flatnonzero(~new | ~np.r_[new[1:], True]) if len(order) else order
    if len(tied):
        group = np.cumsum(new)[tied]
        key = words[starts[order[tied]] + offsets[1]].astype(np.uint64)
        at = np.lexsort((key, group))
        order[tied], key = order[tied[at]], key[at]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    # Deep: a blind trie for each group that is left. Its members are compared with one of them; the
    # least common prefix is where the trie branches, bytes before it are never looked at again.
    group = np.cumsum(new) - 1
    todo = np.flatnonzero(np.bincount(group, minlength=len(order))[group] > 1) if len(order) else group
    while len(todo):
        first = np.flatnonzero(np.r_[True, group[todo[1:]] != group[todo[:-1]]])
        sizes = np.diff(np.r_[first, len(todo)])
        mine, leader = starts[order[todo]], np.repeat(starts[order[todo[first]]], sizes)
        common = np.full(len(todo), length)
        for at in reversed(offsets[2:]):
            x = words[mine + at].astype(np.uint64) ^ words[leader + at].astype(np.uint64)
            apart = x != 0
            common[apart] = at + _leading_bytes(x[apart])
        branch = np.minimum.reduceat(common, first)
        split = np.repeat(branch < length, sizes)
        todo = todo[split]
        if not len(todo):
            break
        byte = data[mine[split] + np.repeat(branch, sizes)[split]]
        at = np.lexsort((byte, group[todo]))
        order[todo] = order[todo[at]]
        byte = byte[at]
        new[todo[1:]] |= (byte[1:] != byte[:-1]) & (todo[1:] == todo[:-1] + 1)
        group = np.cumsum(new) - 1
        todo = todo[np.bincount(group)[group[todo]] > 1]
    return order, np.flatnonzero(new)


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of nonzero 64-bit numbers."""
    count = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        zero = x >> np.uint64(64 - bits) == 0
        count += zero * (bits // 8)
        x = np.where(zero, x << np.uint64(bits), x)
    return count


def _answer_spans(targets: int):
    wide = deal.width(targets)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        """For chunks: a mask of the suffixes of their spans that also start in a document with a smaller id, where there are any."""
        give_back()
        spans, ids, at, number = _entries(group, 4)
        data = np.concatenate([spans.ravel(), np.zeros(16, np.uint8)])
        size = spans[:, 0].astype(np.int64)
        count = size - LENGTH + 1
        before = np.cumsum(count) - count
        inner = np.arange(count.sum()) - np.repeat(before, count)
        starts = np.repeat(np.arange(len(size)) * (WIDE + 1) + 1, count) + inner
        own = np.repeat(ids, count)
        order, new = deep_shallow(data, starts)
        least = np.minimum.reduceat(own[order], new)
        repeats = np.empty(len(order), bool)
        repeats[order] = np.repeat(least, np.diff(np.r_[new, len(order)])) < own[order]
        masks = np.add.reduceat(np.where(repeats, np.int64(1) << inner, 0), before)
        some = masks > 0
        return _dealt(at[some], [number[some], masks[some]], wide)

    return run


# ---- step 5: cutting ----------------------------------------------------------------------------


def _cut(uri: str, columns: list[str], text_col: str, most: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        give_back()
        c = _chunk_at(key[0].as_py(), most)
        chunk = Chunk(uri, c, anchors=False)
        filesystem, path = open_fs(f"{uri}/local/{c:016x}")
        with filesystem.open_input_file(path) as source:
            entry, first, _, sure, sure_size = _unpack_all(source.read())
        number, found = _entries(group, 2)
        masks = np.zeros(int(entry.max(initial=-1)) + 1, np.int64)
        masks[number] = found
        masks = masks[entry]
        change = np.zeros(len(chunk.data) + 1, np.int32)
        np.add.at(change, sure, 1)
        np.add.at(change, sure + sure_size, -1)
        for k in range(LENGTH - GRAM + 1):
            hit = first[masks >> k & 1 == 1] + k
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LENGTH, -1)
        gone = np.cumsum(change[: len(chunk.data)], dtype=np.int32) > 0
        removed, spans, kept = [], [], []
        for a, z in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            g = gone[a:z]
            n = int(g.sum())
            removed.append(n)
            spans.append(int(g[0]) + int((g[1:] > g[:-1]).sum()) if n else 0)
            kept.append((chunk.data[a:z][~g] if n else chunk.data[a:z]).tobytes())
        out = {name: chunk.table.column(name) for name in columns}
        if text_col in out:
            texts = chunk.table.column(text_col).to_pylist()
            out[text_col] = pa.array([None if x is None else k.decode(errors="ignore") for x, k in zip(texts, kept, strict=True)], pa.string())
        out |= {"n_bytes": pa.array(chunk.ends - chunk.starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return run


NEW = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text, and n_bytes, n_removed, n_spans, kept_sha256.

    The text is what is left of the bytes, without parts of characters that a cut has split;
    kept_sha256 is that of the bytes. Files go to the shared folder uri.
    """
    spark = docs.sparkSession
    new = StructType.fromDDL(NEW)
    columns = [c for c in docs.columns if c not in new.names]
    source = docs.select(*columns, F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__bytes"))
    if text_col in columns:
        source = source.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.lit("")))  # its bytes are in __bytes
    every = keep(source.mapInArrow(_write_chunks(uri), "chunk long, bytes long"), f"{uri}/chunk_list")
    part, turn = F.shiftright("chunk", 32), F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))
    total = every.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max(part).alias("last"), F.max(turn).alias("turn")).first()
    schema = StructType([source.schema[c] for c in columns] + list(new))
    if not total["n"]:
        return spark.createDataFrame([], schema)
    size, number, most = total["bytes"] or 0, total["n"], total["turn"] + 1
    targets = (total["last"] + 1) * most
    # Each chunk has a row of its own, so that chunks without marks or answers are seen as well.
    chunks = every.select((part * most + turn).alias("key"), F.lit(b"").alias("block"))
    ranges = max(1, round(size * 2 / (LENGTH - GRAM + 2) / RANGE))
    hashes = chunks.select("key").repartition(number, "key").mapInArrow(_give_hashes(uri, ranges, most), DEALT)
    # Explicit numbers of partitions: the rows are few bytes but much work, which Spark would put into one task.
    hashes = deal.deal(hashes.select("key", "block"), ranges).repartition(ranges, "key")
    marks = keep(hashes.groupBy("key").applyInArrow(_answer_hashes(targets), DEALT), f"{uri}/marks")
    repeated = marks.agg(F.sum("entries")).first()[0] or 0
    shares = max(1, round(repeated / SHARE))
    marks = deal.deal(marks.select("key", "block"), targets).unionByName(chunks).repartition(number, "key")
    spans = marks.groupBy("key").applyInArrow(_give_spans(uri, shares, most), DEALT)
    spans = deal.deal(spans.select("key", "block"), shares).repartition(min(shares, 8 * number), "key")
    masks = keep(spans.groupBy("key").applyInArrow(_answer_spans(targets), DEALT), f"{uri}/masks")
    masks = deal.deal(masks.select("key", "block"), targets).unionByName(chunks).repartition(number, "key")
    return masks.groupBy("key").applyInArrow(_cut(uri, columns, text_col, most), schema)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    small_batches(spark)
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark, "repeats"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The rows of op5_suffix_array over all documents, in DuckDB SQL: runs of starts whose string has a smaller id elsewhere.
ORACLE_SQL = f"""with d as (select row_number() over () as rid, doc_id, coalesce(doc_id, {NO_ID}) as own, encode(coalesce(text, '')) as b from documents),
  starts as (select rid, own, p, array_slice(b, p, p + {LENGTH - 1}) as string from (select *, unnest(range(1, octet_length(b) - {LENGTH - 2})) as p from d)),
  hits as (select rid, p from (select rid, p, own, min(own) over (partition by string) as least from starts) where least < own),
  opened as (select *, p > coalesce(lag(p) over (partition by rid order by p) + {LENGTH}, 0) as opens from hits),
  numbered as (select *, sum(opens::int) over (partition by rid order by p) as run from opened),
  runs as (select rid, run, min(p) as a, max(p) + {LENGTH} as z from numbered group by 1, 2),
  pieces as (select rid, run, z - a as gone, coalesce(lag(z) over (partition by rid order by run), 1) as low, a as high, z from runs),
  cut as (select rid, sum(gone) as gone, count(*) as spans, string_agg(hex(array_slice(b, low, high - 1)), '' order by run) || hex(array_slice(any_value(b), max(z), octet_length(any_value(b)))) as kept from pieces join d using (rid) group by 1)
  select doc_id, octet_length(b)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(coalesce(unhex(kept), b)) as kept_sha256 from d left join cut using (rid)"""
