"""Byte-level BPE over many texts: each distinct stretch between spaces is encoded once per slice and worker.

A slice's texts stay bytes: cuts are found on the bytes and Arrow numbers the distinct stretches between them, so only
those that a worker has not met become Python strings. A stretch is a list of pre-tokens and a pre-token a list of ids;
both are spread over all occurrences with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from leafmill.llm._words import column_bytes, slices

#: White space of one byte, as str.isspace has it, and of more (together a superset of what the pattern calls \s).
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of a slice of whole texts; bytes of stretches and ids after which a worker forgets them, about 100 each with
#: their keys; longer stretches are not remembered.
SLICE, REMEMBERED, LONGEST = 4 << 20, 160 << 20, 64
_ENTRY = 100


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_CODES = np.array([ord(c) for c in byte_letters()], "<u2")


def lettered(data: bytes) -> str:
    """Each byte as its letter."""
    return _CODES[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le")


def lettered_list(pieces: list[str]) -> str:
    """All pieces lettered, the letter of the byte 255 between them, which no UTF-8 has."""
    return lettered(b"\xff".join(map(str.encode, pieces)))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    total, reach = (int(ends[-1]), int((starts + sizes).max())) if len(ends) else (0, 0)
    kind = np.int32 if max(total, reach) < 2**31 else np.int64
    return np.repeat((starts - (ends - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` behind its used part; its room doubles, so that growth costs no more than its result."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(len(array), len(more)), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Lists:
    """Growing lists of numbers by key."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.lists = 0

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.row.update(zip(keys, range(self.lists, self.lists + len(keys)), strict=True))
        self.starts = _grown(self.starts, self.lists, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _grown(self.sizes, self.lists, sizes)
        self.flat = _grown(self.flat, self.used, flat)
        self.lists, self.used = self.lists + len(keys), self.used + len(flat)

    def missing(self, keys: list[str]) -> list[str]:
        has = self.row
        return [k for k in keys if k not in has]

    def rows(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all rows' lists, their sizes)."""
        sizes = self.sizes[rows]
        return self.flat[spread(self.starts[rows], sizes)], sizes


class PretokenEncoder:
    """Ids of whole texts. A match of ``pattern`` never reaches over a space between two visible characters, so texts are
    cut there and equal stretches have equal ids. ``encode``: pre-tokens to (all ids, number of each); ``special``: what
    makes a stretch one to be encoded by ``whole`` as it is."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: re.Pattern | None = None, whole: Callable[[str], list[int]] | None = None):
        self.find, self.encode, self.special, self.whole = regex.compile(pattern).findall, encode, special, whole
        self.reset()

    def reset(self) -> None:
        self.stretches, self.pieces, self.held = Lists(), Lists(), 0

    def _cut(self, stretch: str) -> list[str]:
        """The pattern's matches; a comma or full stop behind letters alone is one. What is special stays."""
        bare = stretch[1:] if stretch[0] == " " else stretch
        if bare[-1:] in (",", ".") and bare[:-1].isalpha():
            return [stretch[:-1], bare[-1]]
        return [stretch] if self.special and self.special.search(stretch) else self.find(stretch)

    def _learn(self, stretches: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all their pre-tokens, number of each); ``letters``: those that are one pre-token for sure."""
        one = letters.astype(bool)
        alone, other = list(compress(stretches, one)), list(compress(stretches, ~one))
        cut = list(map(self._cut, other))
        sizes = np.ones(len(stretches), np.int64)
        sizes[~one] = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = list(chain.from_iterable(cut))
        new = self.pieces.missing(list(dict.fromkeys(chain(alone, flat))))
        if self.special:
            for p in (p for p in new if self.special.search(p)):
                ids = np.array(self.whole(p), np.uint32)
                self.pieces.add([p], ids, np.array([len(ids)]))
            new = self.pieces.missing(new)
        if new:
            ids, each = self.encode(new)
            self.pieces.add(new, ids, each)
            self.held += 4 * len(ids) + _ENTRY * len(new) + sum(map(len, new))
        starts = np.cumsum(sizes) - sizes
        rows = np.zeros(int(sizes.sum()), np.int64)
        rows[starts[one]] = self.pieces.rows(alone)
        rows[spread(starts[~one], sizes[~one])] = self.pieces.rows(flat)
        return rows, sizes

    def _slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.held > REMEMBERED:
            self.reset()
        raw = np.ascontiguousarray(buf[int(offs[0]) : int(offs[-1])])
        offs, n = offs - offs[0], len(raw)
        blank = _BLANK[raw]
        if (raw >= 0x80).any():
            for m in _WIDE.finditer(raw.tobytes()):
                blank[m.start() : m.end()] = True
        first = np.zeros(n + 1, bool)
        first[1 : n - 1] = (raw[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
        first[np.maximum(offs - 1, 0)] = False  # a text's last character has none behind it
        first[offs] = True
        starts = np.flatnonzero(first[:n])
        per_text = np.searchsorted(starts, offs)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(raw)]).dictionary_encode()
        distinct = column.dictionary.cast(pa.large_string())
        letters = pc.utf8_is_alpha(pc.if_else(pc.starts_with(distinct, " "), pc.utf8_slice_codeunits(distinct, 1), distinct)).to_numpy(zero_copy_only=False)
        found = distinct.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        row = self.stretches.row
        new = np.fromiter((k not in row for k in found), bool, len(found))
        fresh = list(compress(found, new))
        self.stretches.add(fresh, *self._learn(fresh, letters[new]))
        self.held += _ENTRY * len(fresh) + sum(map(len, fresh))
        pieces, sizes = self.stretches.of(self.stretches.rows(found)[column.indices.to_numpy()])
        for k in fresh:
            if len(k) > LONGEST:
                del row[k]
        ids, lengths = self.pieces.of(pieces)
        stops = np.concatenate([[0], np.cumsum(lengths)])
        return ids, stops[np.concatenate([[0], np.cumsum(sizes)])[per_text]]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts and n + 1 offsets by text; null is empty."""
        buf, offs = column_bytes(column)
        ids, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for i, j in slices(offs, SLICE):
            own, stop = self._slice(buf, offs[i : j + 1])
            ids.append(own)
            ends.append(ends[-1][-1] + stop[1:])
        return np.concatenate(ids), np.concatenate(ends)
