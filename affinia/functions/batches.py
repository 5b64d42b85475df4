"""The ratios of similarity for many pairs of texts at once, in numpy.

A text is a column of bits, one a character, as in similarity.common_length; what is done there to one pair is done
here to arrays of pairs. The results are those of the functions in similarity, to the last bit.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np

from affinia.functions.similarity import FAR_FROM, FAR_PARTIAL, PARTIAL, PARTIAL_FROM, WORDWISE, measured_one, partial_ratio

#: Pairs measured at once: so few that arrays of them stay in the processor's cache.
TOGETHER = 1 << 14
#: Texts of more letters are measured one by one: every column is as long as the longest.
LONG = 256
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Spark's round of doubles: half up, of the shortest decimal that names the double."""
    scale = 10.0**digits
    up = x * scale
    out = np.floor(np.abs(up) + 0.5) * np.sign(up) / scale
    # What is about a half is rounded as a decimal.
    for at in np.flatnonzero(np.abs(np.abs(up) % 1.0 - 0.5) < 1e-3):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Letters:
    """Texts as columns of letters and as bits by letter, in an alphabet of their own."""

    def __init__(self, texts: list[str]):
        self.texts, n = texts, len(texts)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, n)
        self.alphabet = np.unique(flat)
        self.most = int(self.size.max(initial=0))
        # One letter more, which no text has, fills up the columns.
        self.letters = np.full((self.most, n), len(self.alphabet), np.intp)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.letters[place, np.repeat(np.arange(n), self.size)] = np.searchsorted(self.alphabet, flat)
        self.width = len(self.alphabet) + 1

    @cached_property
    def bits(self) -> list[np.ndarray]:
        """For each 64 places, an array by text and letter."""
        found, rows = [], np.arange(len(self.texts)) * self.width
        for start in range(0, max(self.most, 1), 64):
            held = np.zeros(len(self.texts) * self.width, np.uint64)
            for at in range(start, min(self.most, start + 64)):
                held[rows + self.letters[at]] |= _ONE << np.uint64(at - start)
            held[rows + self.width - 1] = 0
            found.append(held)
        return found


def common(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray, keep: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of texts i of a and j of b, of the letters at ``keep`` (bits by place, of each) alone."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    short, swapped = a.size[i] <= 64, b.size[j] <= 64
    for chosen, turned, words in ((short, False, 1), (~short & swapped, True, 1), (~short & ~swapped, False, len(a.bits))):
        at = np.flatnonzero(chosen)
        # Pairs of texts of like length together: a pair is done when its second text is.
        at = at[np.argsort((a.size[i] if turned else b.size[j])[at], kind="stable")] if len(at) else at
        for start in range(0, len(at), TOGETHER):
            part = at[start : start + TOGETHER]
            kept = keep and tuple([k[part] for k in side] for side in keep)
            x, y, p, q = (b, a, j[part], i[part]) if turned else (a, b, i[part], j[part])
            out[part] = _common(x, p, y, q, kept and (kept[::-1] if turned else kept), words)
    return out


def _common(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray, keep: tuple[list[np.ndarray], list[np.ndarray]] | None, words: int) -> np.ndarray:
    steps, base = int(b.size[j].max()), i * a.width
    free = [np.full(len(i), _ALL) for _ in range(words)]
    letter, taken, rest = np.empty(len(i), np.intp), np.empty(len(i), np.uint64), np.empty(len(i), np.uint64)
    for at in range(steps):
        np.take(b.letters[at], j, out=letter, mode="clip")
        np.add(letter, base, out=letter)
        asked = keep and (keep[1][at >> 6] >> np.uint64(at & 63)) & _ONE
        carry = None
        for w in range(words):
            f = free[w]
            np.take(a.bits[w], letter, out=taken, mode="clip")
            if keep:
                np.bitwise_and(taken, keep[0][w], out=taken)
                np.multiply(taken, asked, out=taken)
            np.bitwise_and(taken, f, out=taken)
            np.bitwise_xor(f, taken, out=rest)
            if words == 1:
                np.add(f, taken, out=f)
            else:
                total = f + taken
                over = total < f
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry, f = over.astype(np.uint64), total
            free[w] = np.bitwise_or(f, rest, out=f)
    return sum(np.bitwise_count(~f).astype(np.int64) for f in free)


def _share(same: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * same / np.maximum(total, 1), 100.0)


def ratio(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    return _share(common(a, i, b, j), a.size[i] + b.size[j])


def partial(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """similarity.partial_ratio."""
    la, lb = a.size[i], b.size[j]
    out = np.where((la == 0) & (lb == 0), 100.0, 0.0)
    some, least = (la > 0) & (lb > 0), np.minimum(la, lb)
    for at in np.flatnonzero(some & (least > 64)):
        out[at] = partial_ratio(a.texts[i[at]], b.texts[j[at]])
    some &= least <= 64
    for chosen, x, p, y, q in ((some & (la <= lb), a, i, b, j), (some & (la >= lb), b, j, a, i)):
        at = np.flatnonzero(chosen)
        at = at[np.lexsort((y.size[q[at]], -x.size[p[at]]))]
        for start in range(0, len(at), TOGETHER // 8):
            part = at[start : start + TOGETHER // 8]
            out[part] = np.maximum(out[part], _stretches(x, p[part], y, q[part]))
    return out


def _most(a: Letters, i: np.ndarray, j: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """What partial gives texts i and j at most, by their ratio: no stretch shares more letters than the whole, or than it has."""
    same = ratios * (a.size[i] + a.size[j]) / 200.0
    return 200.0 * same / np.maximum(np.minimum(a.size[i], a.size[j]) + same, 1)


def _stretches(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """The best ratio of texts of a, the longest first, with a stretch of those of b: similarity._best_stretch."""
    n, m, base = a.size[i], b.size[j], i * a.width
    longest, last = int(n[0]), int(m.max())
    # How many of the texts have so many letters.
    upto = np.searchsorted(-n, -np.arange(longest + 1), side="right")
    found = [a.bits[0][base + b.letters[at][j]] for at in range(last)]
    best, free, taken, rest = np.zeros(len(i)), *(np.empty(len(i), np.uint64) for _ in range(3))
    for end in range(1, last + longest):
        free.fill(_ALL)
        for back in range(min(longest, end), max(0, end - last), -1):
            k = upto[back]
            f, t, r = free[:k], taken[:k], rest[:k]
            np.bitwise_and(f, found[end - back][:k], out=t)
            np.bitwise_xor(f, t, out=r)
            np.add(f, t, out=f)
            np.bitwise_or(f, r, out=f)
        length = np.minimum(end, m) - np.maximum(0, end - n)
        np.maximum(best, np.where(length > 0, 200.0 * np.bitwise_count(~free) / (n + np.maximum(length, 0)), 0.0), out=best)
    return best


class Texts:
    """Distinct texts, with all that the ratios need of one of them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.long = np.fromiter((len(t) > LONG for t in texts), bool, len(texts))
        self.short = ["" if long else t for t, long in zip(texts, self.long, strict=True)]
        self.words = [t.split() for t in self.short]

    @cached_property
    def size(self) -> np.ndarray:
        return np.fromiter(map(len, self.texts), np.int64, len(self.texts))

    @cached_property
    def plain(self) -> Letters:
        return Letters(self.short)

    @cached_property
    def ordered(self) -> Letters:
        return Letters([" ".join(sorted(w)) for w in self.words])

    @cached_property
    def _sets(self) -> list[list[str]]:
        return [sorted(set(w)) for w in self.words]

    @cached_property
    def single(self) -> Letters:
        """Sorted words, each once."""
        return Letters([" ".join(w) for w in self._sets])

    @cached_property
    def ended(self) -> Letters:
        """The same with a space after each word."""
        return Letters(["".join(x + " " for x in w) for w in self._sets])

    @cached_property
    def repeats(self) -> np.ndarray:
        return np.array([len(s) != len(w) for s, w in zip(self._sets, self.words, strict=True)], bool)

    @cached_property
    def count(self) -> np.ndarray:
        return np.array([len(s) for s in self._sets], np.int64)

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """By place in the sorted words and by text: the word's number, its length, and for each 64 places its bits in ``ended``."""
        most, parts = int(self.count.max(initial=0)), max(1, -(-self.ended.most // 64))
        number: dict[str, int] = {}
        ids, sizes = np.full((most, len(self.texts)), -1, np.int32), np.zeros((most, len(self.texts)), np.int64)
        held = [np.zeros((most, len(self.texts)), np.uint64) for _ in range(parts)]
        for t, words in enumerate(self._sets):
            start = 0
            for k, w in enumerate(words):
                ids[k, t], sizes[k, t] = number.setdefault(w, len(number)), len(w)
                own = ((1 << len(w) + 1) - 1) << start
                for p in range(start >> 6, (start + len(w) >> 6) + 1):
                    held[p][k, t] = own >> 64 * p & 0xFFFFFFFFFFFFFFFF
                start += len(w) + 1
        return ids, sizes, held

    def measured(self, i: np.ndarray, j: np.ndarray, names: tuple[str, ...], guarded: bool = False) -> dict[str, np.ndarray]:
        """The ratios of texts i with texts j; guarded as in similarity.ratios."""
        out, weighted, size = {}, "wratio" in names, self.plain.size
        if weighted or "ratio" in names:
            out["ratio"] = ratio(self.plain, i, self.plain, j)
        if weighted or "token_sort_ratio" in names:
            out["token_sort_ratio"] = ratio(self.ordered, i, self.ordered, j)
        if weighted or "token_set_ratio" in names:
            out["token_set_ratio"], met = self._by_sets(i, j)
        if weighted:
            out["wratio"] = self._weighted(i, j, met, out)
        none = (size[i] == 0).astype(int) + (size[j] == 0) if guarded else None
        out = {n: out[n] if none is None else np.where(none == 2, 100.0, np.where(none == 1, 0.0, out[n])) for n in names}
        for at in np.flatnonzero(self.long[i] | self.long[j]) if self.long.any() else ():
            for n, value in zip(names, measured_one(self.texts[i[at]], self.texts[j[at]], names, guarded), strict=True):
                out[n][at] = value
        return out

    def _by_sets(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """token_set_ratio, and whether the texts share a word."""
        out, met = np.zeros(len(i)), np.zeros(len(i), bool)
        for start in range(0, len(i), TOGETHER):
            part = slice(start, start + TOGETHER)
            out[part], met[part] = self._set_ratio(i[part], j[part])
        return out, met

    def _set_ratio(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, held = self.slots
        na, nb = self.count[i], self.count[j]
        one, two = ([k[w] for k in ids[: int(n.max(initial=0))]] for w, n in ((i, na), (j, nb)))
        in_a, in_b = [np.zeros(len(i), bool) for _ in one], [np.zeros(len(i), bool) for _ in two]
        for x, own in zip(one, in_a, strict=True):
            for y, other in zip(two, in_b, strict=True):
                same = (x == y) & (x >= 0)
                own |= same
                other |= same
        n, letters = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        drop = [[np.zeros(len(i), np.uint64) for _ in held] for _ in range(2)]
        for w, found, dropped in ((i, in_a, drop[0]), (j, in_b, drop[1])):
            for k, own in enumerate(found):
                at = np.flatnonzero(own)
                for h, d in zip(held, dropped, strict=True):
                    d[at] |= h[k][w[at]]
                if w is i:
                    n[at] += 1
                    letters[at] += sizes[k][w[at]]
        met = n > 0
        shared = letters + np.maximum(n - 1, 0)
        total = self.single.size
        # What is left has a space less than what is left with a space after each word.
        left = [np.maximum(total[w] + 1 - letters - n - 1, 0) for w in (i, j)]
        whole = (na > n) & (nb > n)
        same = np.zeros(len(i), np.int64)
        for at, some in ((np.flatnonzero(whole & ~met), False), (np.flatnonzero(whole & met), True)):
            keep = tuple([~d[at] for d in side] for side in drop) if some else None
            same[at] = common(self.ended, i[at], self.ended, j[at], keep) - 1
        size = [shared + met + x for x in left]
        apart = left[0] + left[1] - 2 * same
        best = 100.0 - 100.0 * apart / np.maximum(size[0] + size[1], 1)
        for s in size:
            best = np.where(met, np.maximum(best, 100.0 - 100.0 * (s - shared) / np.maximum(shared + s, 1)), best)
        best = np.where(met & ~whole, 100.0, best)
        return np.where((na == 0) | (nb == 0), 0.0, best), met

    def _weighted(self, i: np.ndarray, j: np.ndarray, met: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
        la, lb = self.plain.size[i], self.plain.size[j]
        far = np.maximum(la, lb) / np.maximum(np.minimum(la, lb), 1)
        out = np.maximum(known["ratio"], WORDWISE * np.maximum(known["token_sort_ratio"], known["token_set_ratio"]))
        some = (la > 0) & (lb > 0)
        at = np.flatnonzero(some & (far >= PARTIAL_FROM))
        x, y, weight, shares = i[at], j[at], np.where(far[at] <= FAR_FROM, PARTIAL, FAR_PARTIAL), met[at]
        best = np.maximum(known["ratio"][at], np.where(shares, WORDWISE * weight * 100.0, 0.0))
        more = np.flatnonzero(_most(self.plain, x, y, known["ratio"][at]) * weight > best - 1e-6)
        best[more] = np.maximum(best[more], weight[more] * partial(self.plain, x[more], self.plain, y[more]))
        repeats = self.repeats[x] | self.repeats[y]
        more = np.flatnonzero(~shares & (repeats | (_most(self.ordered, x, y, known["token_sort_ratio"][at]) * WORDWISE * weight > best - 1e-6)))
        words = partial(self.ordered, x[more], self.ordered, y[more])
        again = np.flatnonzero(repeats[more])
        words[again] = np.maximum(words[again], partial(self.single, x[more[again]], self.single, y[more[again]]))
        best[more] = np.maximum(best[more], WORDWISE * weight[more] * words)
        out[at] = best
        return np.where(some, out, 0.0)
