"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A batch of texts is one byte buffer plus row offsets; words, shingles and windows are index arrays into it.
Long batches are cut into pieces of bounded bytes, so memory doesn't follow the batch, only the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 20
_BLOCK = 1 << 18

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte value, and an odd base with its inverse modulo 2**64.
BYTE_CODE = _rng.integers(1, 1 << 64, 256, dtype=U64)
BASE = int(0x9E3779B97F4A7C15)
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE_LOWER = BYTE_CODE[LOWER]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


_pow, _inv = powers(BASE, _BLOCK + 1), powers(BASE_INV, _BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift, multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of each span of bytes; spans ascend and may overlap. Equal bytes, equal hash, wherever they stand."""
    global _pow, _inv
    out, lo, n = np.empty(len(starts), U64), 0, len(starts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _BLOCK, "right")))
        a, b = int(starts[lo]), int(ends[lo:hi].max())
        if b - a >= len(_pow):
            _pow, _inv = powers(BASE, b - a + 1), powers(BASE_INV, b - a + 1)
        run = np.empty(b - a + 1, U64)
        run[0] = 0
        np.cumsum(code[buf[a:b]] * _pow[: b - a], dtype=U64, out=run[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (run[e] - run[s]) * _inv[s] + (e - s).astype(U64) * U64(0x2545F4914F6CDD1D)
        lo = hi
    if len(_pow) > 16 * _BLOCK:  # a very long text came by: give its tables back
        _pow, _inv = _pow[: _BLOCK + 1].copy(), _inv[: _BLOCK + 1].copy()
    return mix(out)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` bytes that don't cross rows, and each row's first run (rows + 1)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table of the byte values in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + w] for every i, by doubling; shorter at the end."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        f(out[:-step], out[step:], out=out[:-step]) if step < len(out) else None
        have += step
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for every i (meaningless for the last k - 1)."""
    out = h.copy()
    for t in range(1, k):
        if t < len(h):
            out[:-t] = out[:-t] * U64(0xA24BAED4963EE407) + h[t:]
    return mix(out)
