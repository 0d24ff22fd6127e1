"""Words, lines and shingles of whole Arrow batches as numpy arrays.

A batch of texts is one byte array with offsets. Words are byte ranges, and a word's hash is a sum over its
bytes of a random value for the byte times a power for its place, mixed at the end: no Python loop runs over
words. Hashes depend on fixed seeds only, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)

#: The white space that separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: ``start``, ``end`` (bytes) and ``of`` (word offsets by text)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE):
        self.data, self.off = data, off
        gap = apart[data]
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:], after[:-1] = gap[:-1], gap[1:]
            inner = off[1:-1]
            before[inner[inner < len(data)]] = True
            after[inner[inner > 0] - 1] = True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.of = np.searchsorted(self.start, off)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    power = np.cumprod(np.full(int(size.max()) + 1, _BASE, U64))
    gaps = np.zeros(len(data), np.int32 if len(data) < 2**31 else np.int64)
    gaps[start[0] :] = 1
    gaps[start[1:]] -= np.diff(start).astype(gaps.dtype)  # counts from 1 again at each range
    place = np.cumsum(gaps, dtype=gaps.dtype)
    np.minimum(place, len(power) - 1, out=place)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[data] * power[place], out=total[1:])
    return mix(total[end] - total[start] + size.astype(U64))


def shingles(word: np.ndarray, of: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of each text and their offsets by text.

    A text of fewer words, but one at least, has its whole sequence as its only shingle.
    """
    n = len(word)
    count = np.diff(of)
    out_count = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_of = np.concatenate([[0], np.cumsum(out_count)])
    if n >= k:
        total = word[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            total += word[j : n - k + 1 + j] * _PLACE[j]
        mixed = mix(total)
    else:
        mixed = np.zeros(0, U64)
    out = np.zeros(int(out_of[-1]), U64)
    long = np.flatnonzero(count >= k)
    if len(long):
        src = _ranges(of[long], out_count[long])
        out[_ranges(out_of[long], out_count[long])] = mixed[src]
    for i in np.flatnonzero((count > 0) & (count < k)):
        w = word[of[i] : of[i + 1]]
        total = (w * _PLACE[: len(w)]).sum(keepdims=True)
        total += _PLACE[-len(w) - 1 : -len(w)]
        out[out_of[i]] = mix(total)[0]
    return out, out_of


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c) for each start and count, all counts over 0."""
    step = np.ones(int(count.sum()), np.int64)
    at = np.cumsum(count)[:-1]
    step[0] = start[0]
    step[at] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(step)


def shingle_sets(column: pa.Array, k: int = 5, fold: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted array of its distinct shingles' hashes."""
    data, off = utf8(column)
    for i, j in chunks(off):
        part = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        sh, of = shingles(part.hashes(fold), part.of, k)
        for a, b in zip(of[:-1], of[1:], strict=True):
            yield np.unique(sh[a:b])
