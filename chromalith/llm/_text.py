"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial in an odd base modulo 2**64, taken from prefix sums, so a whole batch is hashed by a few numpy
passes over its bytes; a finaliser then spreads the bits.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Hand freed memory back to the system at a task's end: workers live on, and other operators need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        if size > 1 << 22:  # of one very long text: not kept
            return out[0], out[1]
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) for runs of whole documents of about CHUNK bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Word starts, ends and hashes of a chunk; words of document d are first[d] to first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER, space: np.ndarray = SPACE):
        n = len(data)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        word = ~gap[1:-1]
        self.starts = np.flatnonzero(word & (gap[:n] | cut[:n]))
        self.ends = np.flatnonzero(word & (gap[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum((table[data].astype(U) + U(1)) * up[:n], out=sums[1:])
        length = (self.ends - self.starts).astype(U)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + length * U(0xD6E8FEB86659FD93))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, the first word of each, and their bounds by document; a document with
    1 to k-1 words has its whole sequence as one shingle."""
    h, first = words.hashes, words.first
    n = len(h)
    odd = [U((BASE * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(k)]
    counts = np.diff(first)
    doc_end = np.repeat(first[1:], counts)
    at = np.arange(n)
    whole = at + k <= doc_end
    full = np.zeros(n, U)
    for i in range(min(k, n)):
        full[: n - i] += mix(h[i:] + odd[i]) * odd[i]
    short = np.flatnonzero((counts > 0) & (counts < k))
    keep = whole.copy()
    keep[first[short]] = True
    for d in short:
        a, b = first[d], first[d + 1]
        full[a] = sum((int(x) * int(odd[i]) for i, x in enumerate(mix(h[a:b] + U(b - a)))), int(b - a)) & 0xFFFFFFFFFFFFFFFF
    at = np.flatnonzero(keep)
    return mix(full[at]), at, np.searchsorted(at, first)


def features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, gaps: np.ndarray, sizes: tuple[int, ...], bits: int):
    """(byte position, bucket) of every word of a chunk, then of its character n-grams of each size in bytes.

    An n-gram may begin or end with the blank beside a word, and has no blank inside; it never leaves its document.
    """
    words = Words(data, offsets, table, gaps)
    yield words.starts, (words.hashes >> U(64 - bits)).astype(np.uint32)
    n, u32 = len(data), np.uint32
    gap = gaps[data]
    raw = np.where(gap, u32(1), table[data].astype(u32) + u32(2))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    h = raw.copy()
    inside, same = np.ones(n, bool), np.ones(n, bool)
    for k in range(1, max(sizes)):
        m = n - k
        if m <= 0:
            return
        h = h[:m] * u32(0x01000193) ^ raw[k:]
        same = same[:m] & ~cut[k : k + m]
        if k + 1 in sizes:
            at = np.flatnonzero(same & inside[:m] & ~(gap[:m] & gap[k:]))
            x = h[at]
            x = (x ^ (x >> u32(15))) * u32(0x2C1B3C6D + 2 * k)
            x = (x ^ (x >> u32(12))) * u32(0x297A2D39)
            yield at, (x ^ (x >> u32(15))) >> u32(32 - bits)
        inside = inside[:m] & ~gap[k:]
