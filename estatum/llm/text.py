"""Vectorized words and hashes over Arrow batches of texts.

All work is on the UTF-8 bytes that Arrow holds, in blocks of whole texts, so
that what a task holds is a small multiple of BLOCK or of its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (fixed multipliers)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = U(0x9E3779B97F4A7C15)
_RAW = mix(np.arange(1, 257, dtype=U) * _BASE)
_LOWER = _RAW[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(column: pa.Array, size: int = BLOCK):
    """(first row, rows, bytes, offsets) of blocks of whole texts; null is empty.
    Offsets are within the block's bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j - i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, and per text the number of
    the words before it (one longer than the texts)."""
    solid = ~_SPACE[data]
    fresh = solid.copy()
    if len(data):
        fresh[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        fresh[heads] = solid[heads]
    starts = np.flatnonzero(fresh)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, U), counts
    number = np.cumsum(fresh) - 1
    at = np.flatnonzero(solid)
    place = at - starts[number[at]]
    terms = _LOWER[data[at]] * powers(int(_BASE), int(place.max()) + 1)[place]
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    return mix(np.add.reduceat(terms, first) + length.astype(U)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``k`` words; a text of
    fewer words is one run, one without words has none."""
    n = max(0, len(hashes) - k + 1)
    runs = np.zeros(n, U)
    for j in range(k):
        runs = mix(runs * _BASE + hashes[j : j + n])
    out = []
    for a, b in zip(counts[:-1], counts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            whole = np.zeros(1, U)
            for h in hashes[a:b]:
                whole = mix(whole * _BASE + h)
            out.append(mix(whole + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out
