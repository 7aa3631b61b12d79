"""Word spans and hashes of many texts at once, on the UTF-8 bytes of an Arrow string column.

A word is a run of bytes outside space and \\t \\n \\v \\f \\r. These are all single bytes in UTF-8, so byte spans and
character spans agree. Working on the column's own buffer costs a few array passes a byte and no object a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the arrays take some 40 bytes for each. A longer text is handled alone.
GROUP_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i under n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * GROUP_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Group:
    """Some texts in one buffer. Row i has bytes offsets[i]:offsets[i + 1]; word j is bytes start[j]:end[j] of row doc[j]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def first_word(self) -> np.ndarray:
        """Index of each row's first word, and at the end the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        base = (_BASE + 2 * seed) % (1 << 64)
        inverse = _INVERSE if not seed else pow(base, -1, 1 << 64)
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):  # some words at a time, so that a long text takes no more room than a group
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + GROUP_BYTES, "right")))
            data = self.data[self.start[lo] : self.end[hi - 1]]
            start, end = self.start[lo:hi] - self.start[lo], self.end[lo:hi] - self.start[lo]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(inverse, len(data)), out=sums[1:])
            h = (sums[end] - sums[start]) * powers(base, len(data))[start]
            out[lo:hi] = mix(h + (end - start).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
            lo = hi
        return out


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie within one row, and the word each starts at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k <= 8:
        g = h[:n].copy()
        for j in range(1, k):
            g = g * _STEP + h[j : j + n]
    else:
        base = int(_STEP)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(pow(base, -1, 1 << 64), len(h)), out=sums[1:])
        g = (sums[k:] - sums[:n]) * powers(base, len(h))[:n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(g[at]), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; a null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def ranges(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    data, offsets = buffers(column)
    for lo, hi in ranges(offsets, limit):
        yield split(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def split(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> Group:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Group(lo, hi, data, offsets, none, none, none)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return Group(lo, hi, data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1)


def counts(group: Group, flags: np.ndarray) -> np.ndarray:
    """Number of set flags, one for each byte, in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[group.offsets[1:]] - sums[group.offsets[:-1]]
