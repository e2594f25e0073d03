"""Words of whole texts as 64-bit hashes, a column at a time.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; UTF-8 never uses
those bytes inside a character, so this equals the character class
``[^\\x20\\x09-\\x0D]+``. Texts are taken in groups of whole documents of about
``GROUP`` bytes, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 19
#: Powers that a worker keeps; those for a longer text go with it.
KEPT = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2^64."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, GROUP + 1)
    found = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))]
    if size <= KEPT + 1:
        _powers[:] = found
    return found[0], found[1]


def release() -> None:
    """Gives memory that is free back to the machine: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence of hashes; the order counts."""
    out = np.asarray(hashes[0], np.uint64)
    for h in hashes[1:]:
        out = mix(out * np.uint64(_MULTIPLIER) + h)
    return out


class Spans:
    """Hashes of any byte ranges of one buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Group:
    """Some whole texts: first is the row of the first in its batch; word i is data[start[i]:end[i]] of text doc[i]."""

    first: int
    bounds: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A hash of each word, the same wherever it stands; running sums are over about GROUP bytes at a time."""
        out, a = np.zeros(len(self.start), np.uint64), 0
        while a < len(out):
            x = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, x + GROUP, "right")))
            data = self.data[x : self.end[b - 1]]
            out[a:b] = Spans(LOWER[data] if lower else data).hash(self.start[a:b] - x, self.end[a:b] - x)
            a = b
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


@dataclass
class Bytes:
    """Some whole texts: first is the row of the first in its batch; text i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    bounds: np.ndarray
    data: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1


def byte_groups(column: pa.Array, limit: int = GROUP) -> Iterator[Bytes]:
    """A string column in groups of whole texts of about limit bytes; every row is in one group."""
    data, bounds = utf8(column)
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield Bytes(a, bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]])
        a = b


def groups(column: pa.Array, limit: int = GROUP) -> Iterator[Group]:
    """The same with the words found."""
    for g in byte_groups(column, limit):
        inside = ~SPACE[g.data]
        edge = np.zeros(len(g.data) + 1, bool)
        edge[g.bounds] = True
        before, after = np.ones(len(g.data), bool), np.ones(len(g.data), bool)
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        start = np.flatnonzero(inside & (before | edge[:-1]))
        end = np.flatnonzero(inside & (after | edge[1:])) + 1
        yield Group(g.first, g.bounds, g.data, start, end, np.searchsorted(g.bounds, start, "right") - 1)


def per_doc(values: np.ndarray | None, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums (or counts, without values) by text, as int64."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def runs(doc: np.ndarray, length: int) -> np.ndarray:
    """Positions i at which words i .. i + length - 1 are in one text."""
    if len(doc) < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])
