"""Quality rules: counts over words and lines, and zstandard compression bands.

A text compresses to some share of its bytes. Repetitive texts fall below, incompressible ones
rise above what prose of that length does, so each length has its own band of allowed ratios,
for the whole text and for each of its fixed chunks. Single odd chunks are normal in clean
text (a table, a quotation); a text goes when its odd chunks hold more than a given share of its bytes.
The last chunk, which may be shorter, is judged by the band of its own length.

Null and empty texts have no words and fail the base rules. Words are runs without ASCII white
space. Long texts are read whole. Repeated rows are judged alike; there are no ties. An empty table
stays empty. Columns named like a new one are replaced, others are carried.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import id_text, per_text, small_batches, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: (bytes from, least ratio, largest ratio) of whole texts; zstandard at LEVEL.
BANDS = ((0, 0.0, 9.9), (100, 0.30, 1.15), (200, 0.30, 0.95), (500, 0.25, 0.85), (1000, 0.20, 0.80), (2000, 0.18, 0.75), (5000, 0.15, 0.70), (20000, 0.12, 0.70))
LEVEL = 3
#: Bytes of a chunk.
CHUNK = 2000
#: A text fails when more than this share of its bytes lies in chunks outside the band of their length.
ODD_CHUNKS = 0.5

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, odd_chunk_share double, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has more than once."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    a = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    n = len(codes)
    if n >= 2_000_000:  # three codes would not fit into 64 bits
        pairs = np.unique(a[:-1] * n + a[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + a[2:]
    else:
        windows = (a[:-2] * n + a[1:-1]) * n + a[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    count = 0
    for line in data.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip():
            seen.add(line)
    return count


def band(size: int) -> tuple[float, float]:
    """The allowed ratios for so many bytes."""
    return BANDS[bisect_right(BANDS, (size, 9e9)) - 1][1:]


def compression(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text; share of its bytes in chunks outside their band. An empty text has 1 and 0."""
    if not data:
        return 1.0, 0.0
    odd = 0
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        low, high = band(len(chunk))
        odd += 0 if low <= len(compressor.compress(chunk)) / len(chunk) <= high else len(chunk)
    return len(compressor.compress(data)) / len(data), odd / len(data)


def judge(texts: list[str | None]) -> list[list]:
    """The new columns of quality_rules for a batch of texts."""
    compressor, rows = zstandard.ZstdCompressor(level=LEVEL), []
    for text in texts:
        text = text or ""
        data = text.encode()
        words = data.split()
        n, repeats = len(words), repeated_words(words)
        ratio, odd = compression(data, compressor)
        failed = n < 50 or 100 * repeats > 50 * n
        low, high = band(len(data))
        rows.append((n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(data), repeats, ratio, odd, failed, not failed and low <= ratio <= high and odd <= ODD_CHUNKS))
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(9)]


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts, the ratios, base_failed and kept; clashing columns are replaced."""
    return per_text(docs, FIELDS, judge, text_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    small_batches(spark)
    judged = quality_rules(id_text(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *(F.col(x.split()[0]) for x in FIELDS.split(", ")))
