"""Simple-8b: 64-bit words, each with a 4-bit selector and as many numbers of one width as fit into 60 bits.

Numbers come in blocks of BLOCK; every block starts a new word and its offset is kept, so that any
block can be read alone. Numbers of more than 60 bits stand in a list of their own, and an escape
word holds their place in it: no word's selector is ever ambiguous, and all words of a file can be
decoded at once.
"""

from __future__ import annotations

import numpy as np

#: Numbers in a word, and the bits of each, by selector; fixed by the 60 bits they share.
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // PER_WORD
ESCAPE = 15
BLOCK = 4096


def widths(numbers: np.ndarray) -> np.ndarray:
    """Bits that each number needs; zero needs none."""
    if len(numbers) and int(numbers.max()) < 1 << 16:
        return _narrow[numbers]
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), numbers, "right").astype(np.uint8)


_narrow = np.searchsorted(1 << np.arange(16), np.arange(1 << 16), "right").astype(np.uint8)


def _most(width: np.ndarray) -> np.ndarray:
    """For each place, how many numbers from there on a word can take."""
    n = len(width)
    most = np.ones(n, np.uint8)
    widest, have = width, 1  # the greatest width among `have` numbers from a place on
    for per, bits in zip(PER_WORD[-2::-1].tolist(), BITS[-2::-1].tolist(), strict=True):
        if per > n:
            break
        widest = np.maximum(widest[: n - per + 1], widest[per - have : n - have + 1])
        have = per
        most[: n - per + 1][widest <= bits] = per
    return most


def encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block starts, and the escaped numbers (all uint64 but the offsets, uint32)."""
    numbers = np.asarray(numbers)
    n = len(numbers)
    width = widths(numbers)
    steps = _most(width).tobytes()
    largest = [0] + [max(p for p in PER_WORD.tolist() if p <= k) for k in range(1, 61)]
    starts: list[int] = []
    offsets: list[int] = []
    put = starts.append
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK)
        offsets.append(len(starts))
        i, safe = begin, end - 60
        while i < safe:
            put(i)
            i += steps[i]
        while i < end:
            put(i)
            i += largest[min(steps[i], end - i)]
    start = np.array(starts, np.int64)
    size = np.diff(np.append(start, n))
    words = np.zeros(len(start), np.uint64)
    wide = numbers.astype(np.uint64, copy=False)
    for selector, (per, bits) in enumerate(zip(PER_WORD.tolist(), BITS.tolist(), strict=True)):
        at = np.flatnonzero(size == per)
        if not len(at):
            continue
        packed = np.full(len(at), selector << 60, np.uint64)
        for j in range(per):
            packed |= np.where(width[start[at] + j] <= 60, wide[start[at] + j], np.uint64(0)) << np.uint64(bits * j)
        words[at] = packed
    escaped = np.flatnonzero(width[start] > 60) if n else np.zeros(0, np.int64)
    words[escaped] = (np.uint64(ESCAPE) << np.uint64(60)) | np.arange(len(escaped), dtype=np.uint64)
    return words, np.array(offsets, np.uint32), wide[start[escaped]]


def decode(words: np.ndarray, escaped: np.ndarray, dtype=np.uint64) -> np.ndarray:
    """All numbers of these words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    size = np.where(selector == ESCAPE, 1, PER_WORD[np.minimum(selector, len(PER_WORD) - 1)])
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, dtype)
    for k in np.unique(selector).tolist():
        at = np.flatnonzero(selector == k)
        first = end[at] - size[at]
        if k == ESCAPE:
            out[first] = escaped[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        bits = int(BITS[k])
        for j in range(int(PER_WORD[k])):
            out[first + j] = (words[at] >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, k: int, dtype=np.uint64) -> np.ndarray:
    """The numbers of block k alone."""
    return decode(words[offsets[k] : offsets[k + 1] if k + 1 < len(offsets) else len(words)], escaped, dtype)
