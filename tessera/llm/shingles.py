"""Word hashes and shingle hashes of whole Arrow columns, without a loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Multipliers of the hashes: any odd numbers do; these are digits of well-known constants.
BASE = U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** 0..n and its inverses modulo 2 ** 64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, U), np.full(size, U(_inverse(int(BASE))), U)
        up[0] = down[0] = 1
        _POWERS[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset:c.offset + len(c) + 1]
    data = c.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``, and the row of each."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, from prefix sums."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(U) + U(1)) * up[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (not distinct), row by row, and the
    position in them where each row begins (one more than rows).  A row of
    fewer than ``width`` words has its whole sequence as one shingle."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, row = word_spans(raw, offsets)
    w = word_hashes(raw, starts, ends)
    per = np.bincount(row, minlength=n)
    first = np.cumsum(per) - per
    factors = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    long_rows = np.flatnonzero(per >= width)
    whole = (row[:len(row) - width + 1] == row[width - 1:]) if len(row) >= width else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), U)
    for k in range(width):
        h += w[at + k] * factors[k]
    counts = np.zeros(n, np.int64)
    counts[long_rows] = per[long_rows] - width + 1
    short = np.flatnonzero((per > 0) & (per < width))
    counts[short] = 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(begin[-1], U)
    is_long = np.ones(begin[-1], bool)
    is_long[begin[short]] = False
    out[is_long] = h
    for r in short:
        k = per[r]
        out[begin[r]] = (w[first[r]:first[r] + k] * factors[:k]).sum() + U(int(k))
    return mix(out), begin
