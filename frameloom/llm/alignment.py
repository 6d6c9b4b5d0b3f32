"""Alignment of two tokenizers over a corpus, each distinct segment tokenised and aligned once.

A text, with a space before it, is cut before its runs of white space, where these begin with a
character that no token of either vocabulary holds after one that is no white space (the vocabularies
are searched: of the ASCII ones, all but the carriage return). No merge of either tokenizer crosses
such a cut; nor does the pattern of the byte-level tokenizer, whose pre-tokens end where white space
follows. Documents are then nothing but sequences of segments, and what holds for segments adds up.

1. Blocks of documents become lists of their distinct segments, with counts, and the documents as
   numbers into them (``_blocks``).
2. The lists are dealt out to ranges of segments' hashes. A range tokenises each of its distinct
   segments by both tokenizers and aligns them (``Pair.align``): groups of tokens between common ends,
   and links, the pairs of tokens whose bytes overlap.
3. The ranges' links are counted over the corpus by pair of ids. With these counts a range sums up
   each segment's links, and the alignments are dealt back to the blocks, which compose their documents.

A segment is sent once per block, never once per occurrence; a very frequent one is an entry a block,
and ranges are hashes, so none is crowded. Texts that are null or empty or hold U+2581 (which the piece model
can't tell from a space) have no tokens and count nowhere. All other segments' bytes are compared
with both tokenizations; a vocabulary that doesn't give them back raises an error. Long texts are
handled whole; repeated rows and ids each keep their row and count; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import deal
from frameloom.llm.bpe import _field
from frameloom.llm.common import id_text, keep, shared_dir, small_batches, small_side, table

SPACE = "▁"
#: Characters of text in a block, entries of a range, and segments tokenised at a time.
BLOCK, RANGE, SEGMENTS = 8 << 20, 250_000, 4096


def _byte_table() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Aligned(NamedTuple):
    """Of segments: numbers of tokens of A and B and of groups; the pairs of all links, one after the other; their numbers; the groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    n_links: np.ndarray
    groups: list[str]


class Pair:
    """Tokenizers A (byte-level, of a .json file) and B (a .model of pieces with byte fallback), and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        table = _byte_table()
        with open(a_path, encoding="utf-8") as source:
            vocabulary = json.load(source)["model"]["vocab"]
        self.a_bytes = {i: bytes(table[c] for c in token) for token, i in vocabulary.items()}
        with open(b_path, "rb") as source:
            # A later message of the same field is merged into the earlier one: no space is put before a segment.
            self.b = sentencepiece.SentencePieceProcessor(model_proto=source.read() + _field(3, _field(3, 0)))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.a_size, self.b_size = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.a_size)
        #: Decimal ids with what may follow them, A's first: in the group, after it, after the segment.
        self.signs = [f"{i}{sign}" for i in range(self.width) for sign in (",", "|", "")] + [f"{i}{sign}" for i in range(len(self.b_size)) for sign in (",", ";", "\n")]
        self.cuts = whitespace([*self.a_bytes.values(), *(t for i, t in self.b_bytes.items() if not self.b.is_control(i))])

    def align(self, segments: list[str]) -> Aligned:
        """The tokens, groups and links of segments; their bytes are laid end to end, where both tokenizations end with each segment."""
        a_rows = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b_rows = self.b.encode(segments, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, rows), np.int64, len(segments)) for rows in (a_rows, b_rows))
        a, b = (np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())) for rows, n in ((a_rows, n_a), (b_rows, n_b)))
        text = [s.encode() for s in segments]
        ends = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        whole, a_last, b_last = b"".join(text), np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        same = (n_a > 0).all() and (n_b > 0).all() and np.array_equal(a_ends[a_last], ends) and np.array_equal(b_ends[b_last], ends)
        if not same or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            raise ValueError(f"the tokens of some of {text[0][:60]!r} and others don't give their bytes again")
        # Between two ends of any tokens lie bytes of one token of A and one of B: a link each. Ends of both are ends of groups.
        every, both = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends)
        pair = a[np.searchsorted(a_ends, every)] << 32 | b[np.searchsorted(b_ends, every)]
        # Ids as text: a token's group and side give its place, the sign behind it tells what comes next.
        a_in, b_in = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_sign, b_sign = (a_ends == both[a_in]).astype(np.int64), (b_ends == both[b_in]).astype(np.int64)
        b_sign[b_last] = 2
        order = np.argsort(np.r_[2 * a_in, 2 * b_in + 1], kind="stable")
        signed = np.r_[a * 3 + np.where(a_sign, 1, 0), (b + self.width) * 3 + b_sign][order]
        return Aligned(n_a, n_b, np.diff(np.searchsorted(both, ends, "right"), prepend=0), pair, np.diff(np.searchsorted(every, ends, "right"), prepend=0), "".join(map(self.signs.__getitem__, signed.tolist())).split("\n")[:-1])


def whitespace(tokens: list[bytes]) -> str:
    """The ASCII white space that no token has after a character that is no white space."""
    found = set(b" \t\n\r\x0b\x0c")
    for t in tokens:
        found -= {y for i, y in enumerate(t) if i and y in found and not t[:i].decode(errors="replace")[-1].isspace()}
    return bytes(sorted(found)).decode()


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One pair for each worker process."""
    return Pair(a_path, b_path)


def segmenter(cuts: str):
    """Texts to segments, cut before each run of white space that begins with one of these characters."""
    c = re.escape(cuts)
    return re.compile(rf"\s*\S+(?:[^\S{c}]\s*\S*)*|\s+" if cuts else ".+", re.DOTALL).findall


BLOCKS = "block long, entries long, documents binary, segments binary"


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(pair(a_path, b_path).cuts)
        turn, first = 0, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        sizes: list[int] = []
        order: list[np.ndarray] = []
        number: dict[str, int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(order)
            payload = deal.pack([np.array([i or 0 for i in ids]), np.array([i is None for i in ids]), np.array(sizes), flat])
            times = np.bincount(flat, minlength=len(number))
            listed = deal.pack([deal.strings(s.encode() for s in number), times])
            columns = [pa.array([first + turn]), pa.array([len(number)]), pa.array([payload], pa.binary()), pa.array([listed], pa.binary())]
            for kept in (ids, sizes, order, number):
                kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=["block", "entries", "documents", "segments"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segments = cut(" " + text) if text and SPACE not in text else []
                ids.append(doc)
                sizes.append(len(segments))
                order.append(np.fromiter((number.setdefault(s, len(number)) for s in segments), np.int64, len(segments)))
                held += len(text) + 16
                if held > BLOCK:
                    yield out()
                    turn, held = turn + 1, 0
        if ids:
            yield out()

    return run


def _send(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, segments) of blocks to entries for ranges: segment, block, its number there, and how often it stands there."""
        for batch in batches:
            for block, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segments, times = deal.unpack(listed)
                targets = np.fromiter((xxhash.xxh32_intdigest(s) % ranges for s in segments), np.int64, len(segments))
                yield deal.batch(*deal.cut(targets, [segments, np.full(len(segments), block), np.arange(len(segments)), times], deal.width(ranges)))

    return run


RANGES = "key long, entries binary, aligned binary, pairs array<long>, times array<long>"


def _align(a_path: str, b_path: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """A range's entries, its distinct segments aligned, and how often its pairs of ids are linked."""
        tokenizers = pair(a_path, b_path)
        segments, block, number, times = deal.gather(group.column("block").to_pylist())
        place: dict[bytes, int] = {}
        at = np.fromiter((place.setdefault(s, len(place)) for s in segments), np.int64, len(segments))
        total = np.zeros(len(place), np.int64)
        np.add.at(total, at, times)
        texts = [s.decode() for s in place]
        parts = [tokenizers.align(texts[i : i + SEGMENTS]) for i in range(0, len(texts), SEGMENTS)]
        n_a, n_b, n_groups, pairs, n_links = (np.concatenate([p[k] for p in parts]) for k in range(5))
        distinct, pairs = np.unique(pairs, return_inverse=True)
        linked = np.zeros(len(distinct), np.int64)
        np.add.at(linked, pairs, np.repeat(total, n_links))
        aligned = deal.pack([n_a, n_b, n_groups, n_links, pairs, deal.strings(g.encode() for p in parts for g in p.groups)])
        return pa.table([pa.array([key[0].as_py()]), pa.array([deal.pack([block, number, at])], pa.binary()), pa.array([aligned], pa.binary()), pa.array([distinct], pa.list_(pa.int64())), pa.array([linked], pa.list_(pa.int64()))], names=["key", "entries", "aligned", "pairs", "times"])

    return run


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
COMPOSED = ", ".join(["doc_id long", *(f"{x} long" for x in NUMBERS), "groups string"])


def _give_back(targets: int):
    def run(key: tuple, range_: pa.Table, counted: pa.Table) -> pa.Table:
        """A range and its pairs (pair, n, best) to alignments for blocks: a segment's number there, its six numbers and its groups."""
        if not range_.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["key", "block"])
        block, number, at = deal.unpack(range_.column("entries")[0].as_py())
        n_a, n_b, n_groups, n_links, pairs, groups = deal.unpack(range_.column("aligned")[0].as_py())
        order = np.argsort(counted.column("pair").to_numpy())  # the range's pairs are numbered in this order
        n, best = (counted.column(c).to_numpy()[order][pairs] for c in ("n", "best"))
        first = np.cumsum(n_links) - n_links
        numbers = [n_a, n_b, n_groups, n_links, np.add.reduceat(best, first), np.add.reduceat(n, first)]
        keys, blocks = deal.cut(block, [number, *(x[at] for x in numbers), groups[at]], deal.width(targets))
        return pa.table([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])

    return run


def _compose(key: tuple, group: pa.Table) -> pa.Table:
    """A block's documents and its segments' alignments to documents."""
    ids, missing, sizes, flat = deal.unpack(next(x for x in group.column("documents").to_pylist() if x))
    found = [b for b in group.column("block").to_pylist() if b]
    number, *numbers, groups = deal.gather(found) if found else [np.empty(0, np.int64)] * (len(NUMBERS) + 1) + [deal.strings([])]
    order = np.argsort(number)
    groups = [g.decode() for g in groups[order]]
    stops = np.cumsum(sizes)
    sums = [np.r_[0, np.cumsum(x[order][flat])] for x in numbers]
    columns = [pa.array(s[stops] - s[stops - sizes], pa.int64()) for s in sums]
    texts = [";".join([groups[i] for i in flat[z - s : z].tolist()]) for s, z in zip(sizes.tolist(), stops.tolist(), strict=True)]
    return pa.table([pa.array(ids, pa.int64(), mask=missing > 0), *columns, pa.array(texts, pa.string())], names=["doc_id", *NUMBERS, "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, uri: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, numbers of tokens, groups and links, n_best, count_sum and groups as text; and the links of each pair of ids (A's << 32 | B's) in the corpus.

    n_best: the document's links whose pair is its B id's most frequent in the corpus; count_sum: the pairs' counts, over its links.
    Intermediate tables go to the shared folder uri.
    """
    spark = docs.sparkSession
    small_batches(spark)
    written = keep(id_text(docs, id_col, text_col).mapInArrow(_blocks(a_path, b_path), BLOCKS), f"{uri}/blocks")
    part, turn = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    total = written.agg(F.count("*").alias("n"), F.sum("entries").alias("entries"), F.max(part).alias("last"), F.max(turn).alias("turn")).first()
    if not total["n"]:
        return spark.createDataFrame([], COMPOSED), spark.createDataFrame([], "pair long, n long")
    number, most, ranges = total["n"], total["turn"] + 1, max(1, round(total["entries"] / RANGE))
    targets = (total["last"] + 1) * most
    blocks = written.withColumn("key", part * most + turn)
    # Explicit numbers of partitions: the rows are few bytes but much work, which Spark would put into one task.
    sent = blocks.select("key", "segments").repartition(number, "key").mapInArrow(_send(ranges), deal.SCHEMA)
    aligned = keep(deal.deal(sent, ranges).repartition(ranges, "key").groupBy("key").applyInArrow(_align(a_path, b_path), RANGES), f"{uri}/ranges")
    linked = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), "p.times")
    counts = keep(linked.groupBy("pair").agg(F.sum("times").alias("n")), f"{uri}/counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    ranked = keep(counts.join(F.broadcast(best), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), f"{uri}/ranked")
    counted = linked.select(F.col("key").alias("range"), "pair").join(small_side(ranked), "pair").repartition(ranges, "range")
    given = aligned.select("key", "entries", "aligned").repartition(ranges, "key").groupBy("key").cogroup(counted.groupBy("range")).applyInArrow(_give_back(targets), deal.SCHEMA)
    documents = blocks.select("key", F.lit(None).cast("binary").alias("block"), "documents")
    back = deal.deal(given, targets).withColumn("documents", F.lit(None).cast("binary")).unionByName(documents).repartition(number, "key")
    return back.groupBy("key").applyInArrow(_compose, COMPOSED), ranked.select("pair", "n")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every whole text by the byte-level 50k and the piece 32k vocabulary, as numbers and a digest."""
    import public_tokenizers

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    composed, _ = align(table(spark, sf_dir, "documents"), a_path, b_path, shared_dir(spark, "alignment"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return composed.select("doc_id", *NUMBERS, digest.alias("groups_sha256"))
