"""Vectorised words and hashes over Arrow string columns.

A column's bytes are handled in slices of whole texts (about a megabyte each), so memory does not grow with the batch;
a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Masks of the first n bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: The separators \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and digits and bytes of longer characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # a null may have bytes of its own
        keep = np.asarray(col.is_valid())
        if (np.diff(offs)[~keep] > 0).any():
            return column_bytes(col.fill_null(""))
    return buf, offs


def released(run: Callable) -> Callable:
    """``run`` over Arrow batches, whose memory goes back to the machine when a task ends: workers stay for later stages,
    and what one has used is not there for the others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(offs: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: ``start`` and ``length`` in ``buf``, ``hash``, and ``first``: n + 1 offsets by text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = True, between: np.ndarray = SPACE):
        """``between``: for each byte, whether it separates words; a text's end always does."""
        base = int(offs[0])
        raw = buf[base : int(offs[-1])]
        self.buf = LOWER[raw] if lower else raw
        self.offs = offs - base
        n = len(raw)
        word = np.zeros(n + 1, bool)
        np.logical_not(between[raw], out=word[:n])
        opens = np.zeros(n + 1, bool)  # a text begins here
        opens[self.offs] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | opens[1:]
        ends[:-1] &= ~word[1:] | opens[1:]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, self.offs)

    @property
    def count(self) -> int:
        return len(self.start)

    def by_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def hash(self) -> np.ndarray:
        """Eight bytes at a time, so work grows with the words rather than their bytes."""
        if not self.count:
            return np.zeros(0, U64)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        # the length is mixed in apart, so that a word and the same word with NUL bytes behind it differ
        out = mix(mix(eights[self.start] & _FIRST[np.minimum(self.length, 8)]) * U64(0x9E3779B97F4A7C15) + self.length.astype(U64))
        left, k = np.flatnonzero(self.length > 8), 8
        while len(left):
            part = eights[self.start[left] + k] & _FIRST[np.minimum(self.length[left] - k, 8)]
            out[left] = mix(out[left] * U64(31) + part)
            k += 8
            left = left[self.length[left] > k]
        return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their n + 1 offsets by text; a shorter text with words has one shingle."""
    n = np.diff(first)
    m = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_first = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], m) + np.repeat(first[:-1], m)
    room = np.repeat(np.minimum(n, width), m)
    total = np.zeros(len(at), U64)
    for k in range(width):
        inside = room > k
        where = np.minimum(at + k, max(len(hashes) - 1, 0))
        total = mix(total * U64(31) + np.where(inside, hashes[where] if len(hashes) else U64(0), U64(k + 1)))
    return total, out_first


def distinct_by_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their offsets."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    if len(v) > 1:
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[new], t[new]
    return v, np.searchsorted(t, np.arange(len(first)))
