"""Hashed word shingles of Arrow text columns, with whole batches in NumPy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  A word's 64-bit hash is a polynomial over a random byte table,
taken from running sums; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer document is taken alone.
SLICE_BYTES = 1 << 20

BYTES = np.arange(256)
IS_WORD = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
LOWER = np.where((BYTES >= ord("A")) & (BYTES <= ord("Z")), BYTES + 32, BYTES)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mixed(LOWER.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
ROLES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse, made longer when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])
                for b in (np.uint64(BASE), np.uint64(INVERSE))
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and, for each document that starts at these bytes,
    the place of its first word."""
    inside = IS_WORD[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    fresh[at] = inside[at]  # a word does not run over from one document into the next
    begin = np.flatnonzero(fresh)
    stop = np.empty_like(begin)
    # A word ends before the next white space or the next document.
    closes = ~inside
    closes[at] = True
    ends = np.r_[np.flatnonzero(closes), len(data)]
    stop = ends[np.searchsorted(ends, begin, "right")]
    up, down = POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up, out=sums[1:])
    words = mixed((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    return words, np.searchsorted(begin, starts)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; the whole
    sequence where it has fewer words; nothing for null, empty or blank."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        yield from (np.empty(0, np.uint64) for _ in range(len(column)))
        return
    everything = np.frombuffer(column.buffers()[2], np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        data = everything[offsets[first] : offsets[last]]
        words, places = word_hashes(data, offsets[first:last] - offsets[first])
        bounds = np.r_[places, len(words)]
        n = len(words) - width + 1
        if n > 0:
            rolled = words[:n] * ROLES[0]
            for i in range(1, width):
                rolled = rolled + words[i : i + n] * ROLES[i]
            rolled = mixed(rolled)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                yield distinct(rolled[a : b - width + 1])
            elif b > a:
                few = (words[a:b] * ROLES[: b - a]).sum(keepdims=True) + ROLES[63 - (b - a)]
                yield mixed(few)
            else:
                yield np.empty(0, np.uint64)
        first = last


def distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    keep = np.empty(len(ordered), bool)
    keep[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]
