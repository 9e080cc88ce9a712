"""Words and shingles of many texts at once, as numpy arrays.

Used inside Arrow tasks: a slice of rows is one byte buffer, words are runs of word bytes in it, and
hashes of words come from prefix sums, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n (mod 2**64); grows as longer slices come."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table() -> np.ndarray:
    """True for 0-9, a-z, A-Z and all bytes of characters beyond ASCII."""
    table = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = True
    return table


LOWER, WORD = lower_table(), word_table()


class RangeHash:
    """Hashes of any ranges of a buffer: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        terms = _byte_values()[data]
        terms *= _power(_MULTIPLIER, len(data))[:len(data)]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power(_INVERSE, len(self._sums))[start]
        return mix((self._sums[end] - self._sums[start]) * back + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice of rows. ``row`` counts from the slice's first row; starts and ends are byte
    places in ``data``; words of row r are first[r] .. first[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def place(self) -> np.ndarray:
        """Each word's number in its own text."""
        return np.arange(len(self.row)) - self.first[self.row]


def strings(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 64-bit offsets."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = buffers(strings(column))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Runs of word bytes; a word never crosses into the next text."""
    data = LOWER[data] if lower else data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = WORD[data]
    turn = np.diff(inside)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    # two texts that touch with word bytes: a word ends and another begins there
    joint = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]) if len(cut) else cut
    start = np.flatnonzero(turn == 1)
    end = np.flatnonzero(turn == -1)
    if len(joint):
        start, end = np.sort(np.concatenate((start, joint))), np.sort(np.concatenate((end, joint)))
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)))
    return Words(data, offsets, start, end, row, first, RangeHash(data)(start, end))


_COEFFICIENTS = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word) of all runs of ``size`` words that lie in one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words.hash[i:n + i] * _COEFFICIENTS[i]
    keep = np.flatnonzero(words.row[:n] == words.row[size - 1:])
    return mix(total[keep]), keep


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of the word shingles; a text of fewer words, but not none, is one shingle."""
    hashes, first = windows(words, size)
    rows = words.row[first] if len(first) else first
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        lone = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = words.counts[short] > i
            lone[has] += words.hash[words.first[short[has]] + i] * _COEFFICIENTS[i]
        hashes = np.concatenate((hashes, mix(lone + np.uint64(1))))
        rows = np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows
