"""Whole-text kernels over Arrow batches: bytes, words and hashes as numpy arrays.

Texts are handled as UTF-8. A batch is cut into runs of whole texts of about ``CHUNK``
bytes, so temporary arrays stay small whatever the batch size; a text longer than that
is a run of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: The separators of words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tidy():
    """Has the C library, where it is glibc, give freed arrays back from 8 MB on instead of keeping up to 64 MB a worker."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            libc.mallopt(option, 8 << 20)


_tidy()


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def runs(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of a run of texts: ``[^\\x20\\x09-\\x0D]+``, with 64-bit hashes.

    ``first[d] : first[d + 1]`` are the words of text d; ``start`` and ``end`` are places
    in ``data``, in which one space follows each text (text d begins at ``begin[d]``).
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        n = len(at) - 1
        size = np.diff(at)
        total = int(at[-1] - at[0])
        self.begin = (at - at[0]) + np.arange(n + 1)
        self.data = np.full(total + n + 1, 0x20, np.uint8)
        body = raw[at[0] : at[-1]]
        self.data[np.arange(total) + np.repeat(np.arange(n), size)] = LOWER[body] if lower else body
        inside = ~IS_SPACE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self._sums = self._hashes = None

    def hashes_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ranges of ``data``."""
        up, down = Powers.to(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.hashes_of(self.start, self.end)
        return self._hashes

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the code points of ``data`` begin, and their bytes as one number each."""
        at = np.flatnonzero((self.data & 0xC0) != 0x80)
        out = self.data[at].astype(np.uint64)
        size = np.diff(np.append(at, len(self.data)))
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            if not len(more):
                break
            out[more] |= self.data[at[more] + k].astype(np.uint64) << np.uint64(8 * k)
        return at, out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, one for each place where k words begin (the run's
    texts are not told apart: the caller takes the places inside a text)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ranges ``starts[i] : starts[i] + sizes[i]``."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i] : bounds[i + 1]]``; empty segments give 0."""
    return range_sums(values, bounds[:-1], bounds[1:])


def range_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin[i] : end[i]]``."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[begin]
