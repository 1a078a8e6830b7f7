"""Words and their hashes from whole texts, on bytes, for functions that run on Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Work is done on slices of about a million bytes, so memory does
not follow the size of an Arrow batch; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of consecutive runs of texts; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(column))
        own = offsets[row: end + 1]
        yield row, _LOWER[data[own[0]: own[-1]]], own - own[0]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inked: np.ndarray = _INK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text with the total last) of all words of a slice.

    ``inked`` tells which bytes are parts of words.
    """
    ink = inked[data]
    if not len(ink):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(ink) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], ink[:-1]))
    after = np.concatenate((ink[1:], [False]))
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash's base and of its inverse, kept between slices of ``size`` bytes, or what the longest text has."""

    def __init__(self, size: int = SLICE_BYTES):
        self.size = size
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, self.size + 1)
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE_INVERSE))), dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, from prefix sums."""
    powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers.down[starts])


def distinct_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The different hashes of runs of ``width`` words; of all words, if they are fewer."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * _BASE + hashes[i: i + len(out)])
    return np.unique(out)
