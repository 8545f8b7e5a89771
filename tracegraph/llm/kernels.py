"""Array kernels on batches of texts: bytes, words, windows and their 64-bit hashes.

Every kernel works on the concatenated UTF-8 bytes of a bounded chunk of rows; nothing crosses a
row's end. Hashes are polynomial (arithmetic modulo 2**64) with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes.

    Nulls count as empty texts. A row longer than the limit is a piece of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(BASE), pow(int(BASE), -1, 1 << 64)
    up, down = np.full(n, U(base)), np.full(n, U(inverse))
    up[0] = down[0] = U(1)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    up, down = _powers(size)
    return up, down


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower()[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin-1 letters lowered."""
    low = _lower()[data]
    if len(low):
        wide = np.zeros(len(low), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[wide] += 32
    return low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space, and each row's first word.

    The third array has len(offsets) entries: row r has words first[r]:first[r + 1].
    """
    solid = ~_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; entry i covers values[i:i + size]."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        out *= BASE
        out += values[k : len(values) - size + 1 + k]
    return mix(out)


def byte_windows(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes, in time linear in the bytes."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(data) - size + 1])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word shingles as sorted hashes, rows joined, and the rows' offsets in them.

    A-Z are lowered. A row of fewer words than ``size`` has its whole word sequence as its one
    shingle; a row without words has none.
    """
    low = lower_ascii(data)
    starts, ends, first = words(low, offsets)
    counts = np.diff(first)
    tokens = span_hashes(low, starts, ends)
    grams = windows(tokens, size)
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    owner, values = row[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([mix(_fold(tokens[first[r] : first[r + 1]]))[0] for r in short], np.uint64)
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
        order = np.argsort(owner, kind="stable")
        owner, values = owner[order], values[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    out, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for r in range(len(counts)):
        part = np.unique(values[bounds[r] : bounds[r + 1]])
        out.append(part)
        sizes[r + 1] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _fold(tokens: np.ndarray) -> np.ndarray:
    acc = U(len(tokens))
    with np.errstate(over="ignore"):
        for t in tokens:
            acc = acc * BASE + t
    return np.array([acc], np.uint64)


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary Arrow column whose row r is data[bounds[r]:bounds[r + 1]] as little-endian bytes."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    width = data.dtype.itemsize
    offsets = (np.asarray(bounds) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
