"""Vectorised views of Arrow text columns: UTF-8 buffers, word spans and polynomial fingerprints.

A *chunk* is a run of whole rows of one record batch whose texts hold about ``CHUNK`` bytes (a single longer text is a
chunk of its own).  All helpers work on the chunk's concatenated bytes, so the cost of a call does not depend on how
many short texts the batch holds, and memory stays bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
# One random odd 64-bit number per byte value, drawn by rule from a fixed seed.
BYTE_CODE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
# Word separators of the contracts: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]

KEPT = 2 * CHUNK
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n; kept between calls up to ``KEPT`` of them, as workers outlive a long text."""
    global _POW, _INV
    if len(_POW) < min(n, KEPT):
        _POW, _INV = _powers(BASE, KEPT), _powers(BASE_INV, KEPT)
    return (_POW, _INV) if n <= len(_POW) else (_powers(BASE, n), _powers(BASE_INV, n))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a, out=a)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; null rows hold no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of whole rows."""
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(data: np.ndarray, code: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of code[data[t]] * BASE**t over i <= t < j."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    v = code[data]
    v *= pw[: len(data)]
    np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit fingerprint of the spans [start, end)."""
    _, inv = powers(len(sums))
    h = sums[end] - sums[start]
    h *= inv[start]
    h += (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-separator bytes; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    begin = on.copy()
    begin[1:] &= ~on[:-1] | first[1:n]
    stop = on.copy()
    stop[:-1] &= ~on[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of the A-Z lower-cased word, start, end, row) of every word."""
    start, end, row = words(data, off)
    return span_hash(prefix_sums(data, LOWER_CODE), start, end), start, end, row


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 fingerprints as the int64 that Spark's BIGINT holds."""
    return x.view(np.int64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
