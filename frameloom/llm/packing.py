"""Packing token sequences by bounded-space online best fit.

Every task keeps WINDOWS open windows of at most SIZE tokens. A document's ids (and the closing
id) fill whole windows of their own first; what remains goes to the open window that it fits
best. Where it fits none, the fullest window is topped up with the document's head and emitted
(a gap under MIN_CUT tokens stays as padding), and the rest is tried again. So a window is padded
by less than MIN_CUT tokens unless it is left over at a task's end. Leftovers of groups of tasks are merged:
their pieces fill one window after the other to the brim, and the last is cut into lengths that
are powers of two, which need no padding.

Only piece descriptions are shuffled, never ids; a group of MERGE tasks has at most MERGE x WINDOWS
leftover windows, whatever the input's size. A null text is empty: its one id is the closing one.
Repeated rows are packed each. Of windows that fit equally well the first opened one is taken. An empty
table gives no pieces. Other columns are ignored, whatever their names. A task's rows come in the order of its
input split, so a task that is run again gives the same pieces.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import id_text, keep, shared_dir, small_batches, table

SIZE, WINDOWS, MIN_CUT, MERGE = 4096, 64, 16, 8
#: Entries of a worker's cache, about 200 bytes each; a full cache is emptied.
CACHE_ENTRIES = 800_000
_MARKS = tuple(".,!?;:")
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: The id that closes a document.
CLOSE = 2


class Tokenizer(dict):
    """Ids (as bytes, 4 each) of runs without blanks; the vocabulary's words never cross white space.

    A-Z are lower-cased before the look-up, as the tokenizer does itself later, except in texts that may
    hold the name of a special token.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Public

        self.model = Public.from_file(path)
        self.merge = self.model.model.tokenize

    def _learn(self, runs: set[str]) -> None:
        # A mark after a letter is a word of its own, so "word." is learned as "word" and ".".
        marked = [r for r in runs if r[-1:] in _MARKS and r[-2:-1].lower().isalpha()]
        # Each is looked up by itself: difference() with the keys would walk through the whole cache.
        plain = {r for r in {*runs, *(r[:-1] for r in marked), *_MARKS}.difference(marked) if r not in self}
        # A run of letters is one word to the merges; other runs go through the whole tokenizer.
        other = []
        for r in plain:
            word = r.lower() if r.isascii() else "".join([c.lower() for c in r])
            if word.isalpha() and unicodedata.is_normalized("NFC", word):
                self[r] = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                other.append(r)
        for r, e in zip(other, self.model.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self[r] = array("I", e.ids).tobytes()
        for r in marked:
            self[r] = self[r[:-1]] + self[r[-1]]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.entries:
            self.clear()
        runs = [(x if "<|" in x else x.encode().lower().decode()).replace("\n", " ").split(" ") for x in texts]
        found = [list(map(self.get, run)) for run in runs]
        new: set[str] = set()
        again = [i for i, ids in enumerate(found) if None in ids]
        for i in again:
            new.update([r for r, x in zip(runs[i], found[i], strict=True) if x is None])
        self._learn(new)
        for i in again:
            found[i] = [self[r] if x is None else x for r, x in zip(runs[i], found[i], strict=True)]
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]


@lru_cache(maxsize=1)
def tokenizer(path: str, entries: int = CACHE_ENTRIES) -> Tokenizer:
    return Tokenizer(path, entries)


class Windows:
    """The open windows of one task. Pieces are (row, start, length)."""

    def __init__(self, size: int, windows: int, min_cut: int, emit: Callable[[list[tuple]], None]):
        self.size, self.most, self.min_cut, self.emit = size, windows, min_cut, emit
        self.open: list[list] = []  # [used tokens, pieces]

    def add(self, row, n: int) -> None:
        start = 0
        while n - start >= self.size:
            self.emit([(row, start, self.size)])
            start += self.size
        while start < n:
            rest = n - start
            fits = [w for w in self.open if w[0] + rest <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
                self._put(best, row, start, rest)
                return
            if len(self.open) < self.most:
                self.open.append([rest, [(row, start, rest)]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            if gap >= self.min_cut:
                self._put(fullest, row, start, gap)
                start += gap
            else:
                self._close(fullest)

    def _put(self, window: list, row, start: int, length: int) -> None:
        window[0] += length
        window[1].append((row, start, length))
        if window[0] == self.size:
            self._close(window)

    def _close(self, window: list) -> None:
        self.open.remove(window)
        self.emit(window[1])


def fill(pieces: list[tuple[int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Merge leftovers: (piece, cut from, cut length) by sequence; pieces are (number, length) in order."""
    total = sum(n for _, n in pieces)
    sizes = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
    out, at, used = [], 0, 0
    for room in sizes:
        sequence = []
        while room:
            number, n = pieces[at]
            take = min(room, n - used)
            sequence.append((number, used, take))
            room, used = room - take, used + take
            if used == n:
                at, used = at + 1, 0
        out.append(sequence)
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pack_texts(docs: DataFrame, tokenizer_path: str, uri: str, size: int = SIZE, windows: int = WINDOWS, close: int = CLOSE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids too if wanted.

    Sequence ids are the task's number times 2**33 plus a count; merged leftovers count on from 2**32.
    The pieces of the tasks are written to the shared folder uri, so texts are tokenized once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[int, tuple] = {}  # row: [doc_id, ids, tokens not emitted]
        done: list[tuple] = []
        count = 0

        def emit(pieces: list[tuple], sequence: int | None = None) -> None:
            nonlocal count
            if sequence is None:
                sequence, count = (task << 33) + count, count + 1
            offset = 0
            for row, start, length in pieces:
                doc_id, ids, left = held[row]
                done.append((doc_id, start, length, ids[start : start + length], len(ids), sequence, offset))
                held[row][2] = left - length
                if left == length:
                    del held[row]
                offset += length

        def out(leftover: bool) -> pa.RecordBatch:
            columns = [[d[i] for d in done] for i in (0, 1, 2, 4, 5, 6)]
            crcs = [_crc(d[3]) for d in done]
            carried = [d[3].tobytes() if with_ids or leftover else None for d in done]
            doc_id, start, length, tokens, sequence, offset = columns
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc_id, start, length, crcs, tokens, sequence, offset)), pa.array(carried, pa.binary()), pa.array([leftover] * len(doc_id), pa.bool_())], names=names)

        open_windows = Windows(size, windows, MIN_CUT, emit)
        row = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(ids, tokenizer(tokenizer_path, cache).encode_all(batch.column(1).to_pylist()), strict=True):
                held[row] = [doc_id, np.append(tokens, np.uint32(close)), len(tokens) + 1]
                open_windows.add(row, len(tokens) + 1)
                row += 1
            if done:
                yield out(False)
        for k, (_, pieces) in enumerate(sorted(open_windows.open, key=lambda w: -w[0])):
            emit(pieces, (task << 33) + k)
        if done:
            yield out(True)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "leftover"]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        first = ((key[0].as_py() * MERGE) << 33) + (1 << 32)
        merged = []
        for s, sequence in enumerate(fill([(i, r["length"]) for i, r in enumerate(rows)], size)):
            offset = 0
            for i, used, take in sequence:
                r, ids = rows[i], np.frombuffer(rows[i]["ids"], "<u4")[used : used + take]
                merged.append({"doc_id": r["doc_id"], "start": r["start"] + used, "length": take, "ids_crc32": _crc(ids), "doc_tokens": r["doc_tokens"], "sequence_id": first + s, "offset": offset, "ids": ids.tobytes() if with_ids else None})
                offset += take
        return pa.Table.from_pylist(merged, schema=group.select(names[:-1]).schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    pieces = keep(id_text(docs, id_col, text_col).mapInArrow(run, f"{ddl}, leftover boolean"), f"{uri}/pieces")
    whole = pieces.where(~F.col("leftover")).select(*names[:-1])
    rest = pieces.where("leftover").withColumn("group", F.floor(F.shiftright("sequence_id", 33) / MERGE))
    merged = rest.groupBy("group").applyInArrow(merge, ddl)
    packed = whole.unionByName(merged)
    return packed if with_ids else packed.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, piece by piece."""
    import public_tokenizers

    small_batches(spark)
    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "packing"))
