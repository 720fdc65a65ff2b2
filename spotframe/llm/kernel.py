"""Array kernels over Arrow text columns: words, word hashes and shingle sets, without a loop over words.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, as in the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_BYTE_SALTED = mix(np.arange(1, 257, dtype=U) * U(0xE7037ED1A0B428DB))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """The words of consecutive documents: byte spans, and for each document its range of words."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words before each document, one more entry than documents

    def hashes(self, lower: bool, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lower`` treats A-Z as a-z; ``salt`` 1 gives another hash."""
        n = len(self.buf)
        up, down = _power(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((_BYTE_SALTED if salt else _BYTE_LOWER if lower else _BYTE)[self.buf] * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))


def words_of(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that the table ``between`` doesn't hold."""
    inside = ~between[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(buf) else (False, False)
    edge[1:-1] = inside[1:] != inside[:-1]
    starts_mask = np.zeros(len(buf) + 1, bool)
    starts_mask[:-1] = edge[:-1] & inside
    ends_mask = np.zeros(len(buf) + 1, bool)
    ends_mask[1:] = edge[1:] & inside
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    cut = cut[inside[cut] & inside[cut - 1]]  # a word never crosses from one document to the next
    starts_mask[cut] = True
    ends_mask[cut] = True
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask)
    return Words(buf, offs, starts, ends, np.searchsorted(starts, offs))


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function that gives freed memory back when its task ends; workers stay for later tasks."""

    @functools.wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return

    return tidied


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` word hashes; entry i covers words i to i+k-1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def shingle_sets(w: Words, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each document its sorted distinct ``k``-word shingle hashes; a shorter text is one shingle, an empty one none."""
    h = w.hashes(lower)
    s = windows(h, k)
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(s[lo : hi - k + 1])
        elif hi > lo:
            yield mix(windows(h[lo:hi], hi - lo) + U(hi - lo))
        else:
            yield np.zeros(0, U)
