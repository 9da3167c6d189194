"""Words, word hashes and shingles of Arrow text batches, in numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.
A word's hash is a polynomial over random byte values modulo 2**64, finished by a
bijective mixer; a shingle's hash combines its words' hashes in order.  The odds that
any two of n distinct words or shingles share a hash are about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19  # bytes of text that are hashed at once

_RNG = np.random.default_rng(20240229)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_WHITE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(WINDOW + 4096, 1 << (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for factor in (_BASE, _INVERSE):
            t = np.full(size, factor, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * WINDOW:
            return tables[0], tables[1]  # for one very long word; not kept
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(offsets: np.ndarray, target: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``target`` bytes each; a long text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _WHITE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = white[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = white[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    word = ~white
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between ``starts`` and ``ends``, A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    lo, n = 0, len(starts)
    while lo < n:
        hi = int(np.searchsorted(ends, starts[lo] + WINDOW, "right"))
        hi = max(hi, lo + 1)
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _power_tables(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out)


class Words:
    """The words of a window of texts: ``hashes``, byte bounds, and ``first[i]`` .. ``first[i+1]`` of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = word_bounds(data, offsets)
        self.hashes = hash_words(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)

    def shingles(self, i: int, width: int) -> np.ndarray:
        """Hashes of the ``width``-word shingles of text i, in order; a shorter text is one shingle."""
        h = self.hashes[self.first[i] : self.first[i + 1]]
        return shingle_hashes(h, width)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return h
    w = min(width, len(h))
    out = h[: len(h) - w + 1] * _PLACE[0]
    for k in range(1, w):
        out = out + mix(h[k : len(h) - w + 1 + k] + _PLACE[k + 32]) * _PLACE[k]
    return mix(out + np.uint64(w))


def release() -> None:
    """Give this process's free memory back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A mapInArrow function that gives its worker's free memory back when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def text_windows(batch: pa.RecordBatch, column: str, target: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each window of a batch: its first and last row, bytes and offsets."""
    data, offsets = text_buffers(batch.column(column))
    for lo, hi in windows(offsets, target):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
