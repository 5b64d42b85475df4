"""Words of whole Arrow string columns as numpy arrays: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; a longer text is taken whole.
SLICE_BYTES = 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it stands in a word, and the byte with A-Z lower-cased, plus one."""
    byte = np.arange(256)
    upper = (byte >= 0x41) & (byte <= 0x5A)
    inside = (byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | upper | ((byte >= 0x61) & (byte <= 0x7A))
    return inside, (byte + 32 * upper + 1).astype(np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE & _MASK, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about limit bytes; a null has no bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(raw, width, n + 1 + column.offset)[column.offset :].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, every[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the number of words before each text (and in all).

    Words are the longest runs of [0-9a-z] and characters from U+0080 on, after A-Z are lower-cased.
    """
    inside, value = _classes()
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    opens[cuts] = mask[cuts]
    closes[cuts - 1] = mask[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers.upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data] * up[:n], out=sums[1:])
        found = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return found, np.searchsorted(start, offsets)
