"""Byte-level BPE by way of a sentencepiece model that is written straight from a rank file.

The model is a protobuf message put together here, byte by byte: one piece per token, its
bytes mapped to the characters U+0100..U+01FF, its score the negative rank, no normalisation.
Merging the best-scored neighbours is then merging the lowest rank, so each pre-token gets
the ids that the rank file implies. Decoding is the inverse table.

Nulls encode as no ids; an empty text has none either. Long texts are encoded whole. Extra
columns are carried; a column named like the new one is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import CACHE_ENTRIES, id_text, per_text, small_batches, table

#: Byte b is the character FIRST + b in the model's pieces.
FIRST = 0x100
TO_CHARS = {b: FIRST + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; ids must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: Iterable[bytes]) -> bytes:
    """A sentencepiece BPE model with exactly these tokens, ids in order, then an unknown piece."""
    pieces = [_field(1, _field(1, _chars(token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


def _chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern that may use the classes of letters (L) and numbers (N).

    The standard library splits twice as fast but has other classes; it is used for texts without a
    character on whose class the two libraries differ, and without characters beyond U+FFFF.
    """
    slow = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\w\s]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in plain:
        return slow
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    differ: set[str] = set()
    for ours, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        differ |= set(re.findall(ours, every)) ^ set(regex.findall(theirs, every))
    fast, odd = re.compile(plain).findall, re.compile("[" + "".join(map(re.escape, sorted(differ))) + "\U00010000-\U0010FFFF]").search
    return lambda text: slow(text) if odd(text) else fast(text)


class Codec(dict):
    """Ids of pre-tokens, looked up or else encoded by the model; a full cache is emptied."""

    def __init__(self, rank_path: str, pattern: str):
        self.tokens = read_ranks(rank_path)
        self.split = splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.model.encode(_chars(piece.encode()))
        if len(piece) <= 100:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids (array<int>) of each text."""

    def work(texts: list[str | None]) -> list:
        c = codec(rank_path, pattern)
        rows = [c.encode(x) if x else [] for x in texts]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

    return per_text(docs, f"{ids_col} array<int>", work, text_col)


def decode(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the bytes (binary) that each row's ids stand for."""

    def work(rows: list[list[int] | None]) -> list:
        c = codec(rank_path, pattern)
        return [[c.decode(ids or ()) for ids in rows]]

    return per_text(docs, f"{out_col} binary", work, ids_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the public 50k ranks, and the bytes decoded from them, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    small_batches(spark)
    encoded = encode(id_text(table(spark, sf_dir, "documents")), path, pattern).select("doc_id", "ids")
    decoded = decode(encoded, path, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
