"""Words of Arrow text columns as flat numpy arrays: spans, 64-bit word hashes, rolling window hashes.

A word is a run of bytes other than space and \\x09-\\x0D. Those bytes are ASCII, so working on UTF-8 bytes gives
the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20  # texts are worked on in pieces of about this size; one longer text is a piece of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the polynomial hashes
_TABLES = tuple(np.random.default_rng(s).integers(1, 2**64 - 1, 256, dtype=np.uint64) for s in (11, 12))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    buf: np.ndarray  # bytes of all rows
    rows: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each. At the end, memory Arrow no longer uses is given back."""
    _, offsets = flat(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()


def words_of(col, lower: bool = False) -> Words:
    buf, rows = flat(col)
    if lower:
        buf = _LOWER[buf]
    solid = ~_SPACE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = rows[:-1][rows[:-1] < rows[1:]]  # a row's first and last byte bound a word whatever lies beside them
    last = rows[1:][rows[:-1] < rows[1:]] - 1
    start[full] = solid[full]
    end[last] = solid[last]
    start = np.flatnonzero(start)
    return Words(buf, rows, start, np.flatnonzero(end) + 1, np.searchsorted(start, rows))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a multiplier modulo 2**64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = have = tuple(out)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap.

    Taken in parts of a quarter piece: the powers and sums of a part have eight bytes for each of its own.
    """
    out = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE_BYTES // 4 - 1, side="right")))
        s, e, at = start[lo:hi], end[lo:hi], start[lo]
        part = buf[at : e[-1]]
        up, down = powers(len(part) + 1, which)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[which][part] * up[:-1], out=sums[1:])
        out[lo:hi] = mix((sums[e - at] - sums[s - at]) * down[s - at] + (e - s).astype(np.uint64))
        lo = hi
    return out


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    return span_hashes(w.buf, w.start, w.end, which)


def rolling(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` consecutive values; position p covers p .. p+size-1, the last ones too few."""
    n = len(h)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(n, which)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """For every position with a run of ``size`` after it: does the run lie within one row?"""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n - size + 1) + size <= ends[: n - size + 1]


def slide(x: np.ndarray, size: int, fold) -> np.ndarray:
    """fold (np.minimum or np.maximum) over every run of ``size`` values, by doubling."""
    done, y = 1, x
    while done < size:
        step = min(done, size - done)
        y = fold(y[:-step], y[step:])
        done += step
    return y


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of start .. start+count-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def repeated(x: np.ndarray) -> np.ndarray:
    """Which values occur more than once in ``x``."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    same = y[1:] == y[:-1]
    out = np.zeros(len(x), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
