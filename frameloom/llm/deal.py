"""Dealing entries out to numbered targets, in levels, as compressed blocks of columns: integers, byte strings (of
dtype object), or rows of bytes (two dimensions), whose first byte says how many of the others count; behind them are zeros.

A task that gives every target a block of its own makes tasks x targets blocks, the square of the
input. Here a block holds the entries of a range of targets, at most FAN ranges a level; where there
are more targets, each level gathers the blocks of a range (spread over SPREAD tasks, so a crowded
range is no single task) and cuts them into ranges a FAN-th as wide. Blocks grow with the entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of a level, tasks that a range is spread over, bytes of entries a task holds before it cuts them.
FAN, SPREAD, HELD = 256, 16, 1 << 26
SCHEMA = "key long, block binary"
#: Marks a block of byte strings, where others have the width of a number.
STRINGS = 255


def strings(values: Iterable[bytes]) -> np.ndarray:
    """Byte strings as a column."""
    values = list(values)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def squeeze(values: np.ndarray, ascending: bool) -> bytes:
    """Numbers in few bytes: their differences or themselves, by byte plane, compressed. Of rows of bytes the lengths, then the bytes that count."""
    if values.dtype == object:
        sizes = np.fromiter(map(len, values), "<u4", len(values))
        return bytes([STRINGS, 0]) + zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + sizes.tobytes() + b"".join(values))
    if values.ndim == 2:
        body = values[:, 1:][np.arange(values.shape[1] - 1) < values[:, :1]]
        return np.array([0, values.shape[1]], np.uint8).tobytes() + zstandard.ZstdCompressor(level=3).compress(len(values).to_bytes(8, "little") + values[:, 0].tobytes() + body.tobytes())
    a = np.asarray(values, np.int64)
    a = (np.diff(a, prepend=0) if ascending else a).astype("<u8", copy=False)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width, ascending]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(data: bytes) -> np.ndarray:
    """The numbers, or rows, of squeeze()."""
    width = data[0]
    if width == STRINGS:
        flat = zstandard.ZstdDecompressor().decompress(data[2:])
        n = int.from_bytes(flat[:8], "little")
        ends = (8 + 4 * n + np.cumsum(np.frombuffer(flat, "<u4", n, 8), dtype=np.int64)).tolist()
        return strings([flat[a:z] for a, z in zip([8 + 4 * n, *ends], ends, strict=False)])
    if not width:
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8)
        n = int(flat[:8].view("<i8")[0])
        rows = np.zeros((n, data[1]), np.uint8)
        rows[:, 0] = flat[8 : n + 8]
        rows[:, 1:][np.arange(data[1] - 1) < rows[:, :1]] = flat[n + 8 :]
        return rows
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8).reshape(width, -1)
    a = np.zeros((planes.shape[1], 8), np.uint8)
    a[:, :width] = planes.T
    a = a.view("<i8").ravel()
    return np.cumsum(a) if data[1] else a


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length in one block; those that ascend, as the first does, as differences."""
    parts = [squeeze(c, c.dtype != object and c.ndim == 1 and bool((c[1:] >= c[:-1]).all())) for c in columns]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(data, np.int64, n, 8)])
    return [spread(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gather(blocks: list[bytes]) -> list[np.ndarray]:
    """The columns of several blocks, targets left out."""
    return [np.concatenate(c) for c in zip(*map(unpack, blocks), strict=True)][1:]


def width(n: int) -> int:
    """How many of n targets a first block is for."""
    w = 1
    while -(-n // w) > FAN:
        w *= FAN
    return w


def cut(targets: np.ndarray, columns: list[np.ndarray], wide: int) -> tuple[list[int], list[bytes]]:
    """Keys and blocks of entries for ranges of so many targets."""
    if not len(targets):
        return [], []
    if (targets[1:] < targets[:-1]).any():
        order = np.argsort(targets, kind="stable")
        targets, columns = targets[order], [c[order] for c in columns]
    key = targets // wide
    ends = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return key[ends[:-1]].tolist(), [pack([x[a:b] for x in (targets, *columns)]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def batch(keys: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])


def _cut_again(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last, size = None, 0

        def out() -> pa.RecordBatch:
            targets, *columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return batch(*cut(targets, columns, wide))

        for rows in batches:
            for key, block in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held and (key != last or size > HELD):
                    yield out()
                    size = 0
                last = key
                held.append(unpack(block))
                size += sum(c.nbytes if c.dtype != object else 64 * len(c) + sum(map(len, c)) for c in held[-1])
        if held:
            yield out()

    return run


def deal(rows: DataFrame, n: int) -> DataFrame:
    """Blocks (key, block) that were cut for ranges of width(n), as blocks of one target each: key is the target."""
    wide = width(n)
    while wide > 1:
        wide //= FAN
        salt = F.pmod(F.xxhash64("block"), F.lit(SPREAD))
        rows = rows.repartition("key", salt).sortWithinPartitions("key").mapInArrow(_cut_again(wide), SCHEMA)
    return rows
