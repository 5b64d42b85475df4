"""String and set similarities.

Edit-based ratios run in Arrow batches in Python: expressed in SQL they are about twenty times slower.
All ratios of two columns come from one function, so their texts cross to Python once. Sets and
character n-grams are native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATIOS = ("ratio", "wratio", "token_sort_ratio", "token_set_ratio")
#: Weights of partial and of word-wise comparisons in the weighted ratio, and where they apply; fixed values.
WORDWISE, PARTIAL, FAR_PARTIAL, PARTIAL_FROM, FAR_FROM = 0.95, 0.9, 0.6, 1.5, 8.0


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        taken = free & where.get(c, 0)
        free = ((free + taken) | (free - taken)) & full
    return len(a) - free.bit_count()


def _share(common: int, total: int) -> float:
    return 200.0 * common / total if total else 100.0


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence in percent of both lengths; 100 for two empty texts."""
    return 100.0 if a == b else _share(common_length(a, b), len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: common words against each text, and the remaining words against each other."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    rest = [" ".join(sorted(x - both)) for x in (left, right)]
    if both and not all(rest):
        return 100.0
    shared = len(" ".join(both))
    size = [shared + (shared > 0) + len(r) for r in rest]
    apart = len(rest[0]) + len(rest[1]) - 2 * common_length(*rest)
    scores = [100.0 - 100.0 * apart / sum(size)]
    if shared:
        scores += [100.0 - 100.0 * (s - shared) / (shared + s) for s in size]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer, of its length or cut by an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = _best_stretch(a, b)
    return max(best, _best_stretch(b, a)) if len(a) == len(b) and best < 100.0 else best


def _lengths(short: str, text: str) -> list[int]:
    """Lengths of the longest common subsequences of short with each beginning of text."""
    where: dict[str, int] = {}
    for i, c in enumerate(short):
        where[c] = where.get(c, 0) | 1 << i
    n = len(short)
    full = free = (1 << n) - 1
    out = []
    for c in text:
        taken = free & where.get(c, 0)
        free = ((free + taken) | (free - taken)) & full
        out.append(n - free.bit_count())
    return out


def _best_stretch(short: str, text: str) -> float:
    n = len(short)
    if short in text:
        return 100.0
    # Stretches cut by an end are beginnings of the text, or of the reversed one: one pass gives all of them.
    cut = (_lengths(short, text[: n - 1]), _lengths(short[::-1], text[::-1][: n - 1]))
    best = max((_share(k, n + size) for found in cut for size, k in enumerate(found, 1)), default=0.0)
    start = 0
    while start + n <= len(text):
        k = common_length(short, text[start : start + n])
        best = max(best, _share(k, 2 * n))
        # A step changes the length by one at most, so those before the next can't be better.
        start += max(1, int(best * n / 100.0 + 1e-9) - k + 1)
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if a word is shared; else the better partial ratio of the sorted words, with and without repeats."""
    left, right = a.split(), b.split()
    if set(left) & set(right):
        return 100.0
    best = partial_ratio(" ".join(sorted(left)), " ".join(sorted(right)))
    if len(set(left)) == len(left) and len(set(right)) == len(right):
        return best
    return max(best, partial_ratio(" ".join(sorted(set(left))), " ".join(sorted(set(right)))))


def wratio(a: str, b: str) -> float:
    """The best of the ratios, weighted by how much they forgive; partial ones only for texts of different lengths."""
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < PARTIAL_FROM:
        return max(ratio(a, b), WORDWISE * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    weight = PARTIAL if far <= FAR_FROM else FAR_PARTIAL
    return max(ratio(a, b), weight * partial_ratio(a, b), WORDWISE * weight * partial_token_ratio(a, b))


_FUNCTIONS = {"ratio": ratio, "wratio": wratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}


def measured_one(a: str, b: str, names: tuple[str, ...], guarded: bool) -> list[float]:
    """The ratios of one pair; guarded as in ratios."""
    return [0.0 if a or b else 100.0] * len(names) if guarded and not (a and b) else [_FUNCTIONS[n](a, b) for n in names]


def _udf(names: tuple[str, ...], guarded: bool):
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        from affinia.functions.batches import Texts

        codes, texts = pd.factorize(pd.concat([a.fillna(""), b.fillna("")]))
        return pd.DataFrame(Texts(list(texts)).measured(codes[: len(a)], codes[len(a) :], names, guarded), columns=list(names))

    scored.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(scored, ", ".join(f"{n} double" for n in names))


def ratios(a: Column, b: Column, names: tuple[str, ...] = RATIOS, guarded: bool = False) -> Column:
    """A struct of ratios, 0 to 100; nulls are empty texts. guarded: two empty texts 100, one 0, in all ratios."""
    return _udf(names, guarded)(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays without repeats): shared by all; 1 for two empty sets, 0 for one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared by the smaller set; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def same_set(a: Column, b: Column) -> Column:
    """1 if both hold the same and are not empty, else 0."""
    return ((F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(F.array_intersect(a, b)) == F.size(a))).cast("double")


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters of a trimmed text in lower case."""
    text = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.transform(F.array(text), lambda t: F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))))[0]


def char_ngram_cosine(a: Column, b: Column, n: int) -> Column:
    """Cosine of two texts' n-gram counts; 0 if one has no n-gram. Both are sorted, so equal n-grams meet as neighbours."""

    def counts(grams: Column) -> Column:
        def listed(g: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(g) - 1)
            starts = F.filter(places, lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
            return F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(g, i).alias("gram"), (F.coalesce(F.get(s, k + 1), F.size(g)) - i).cast("long").alias("n"))))[0]

        return F.transform(F.array(F.array_sort(grams)), lambda g: F.when(F.size(g) > 0, listed(g)).otherwise(F.array().cast("array<struct<gram:string,n:bigint>>")))[0]

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["n"] * p["n"])

    def product(merged: Column) -> Column:
        def shared(s: Column, i: Column) -> Column:
            p, q = F.get(merged, i), F.get(merged, i + 1)
            return s + F.when(p["gram"] == q["gram"], p["n"] * q["n"]).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.size(merged) - 2), F.lit(0).cast("long"), shared)

    def cosine(both: Column) -> Column:
        x, y = both["x"], both["y"]
        dot = F.transform(F.array(F.array_sort(F.concat(x, y))), product)[0]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / (F.sqrt(total(x).cast("double")) * F.sqrt(total(y).cast("double"))))

    return F.transform(F.array(F.struct(counts(char_ngrams(a, n)).alias("x"), counts(char_ngrams(b, n)).alias("y"))), cosine)[0]


def register(spark) -> None:
    """Makes the Python functions usable from SQL."""
    from affinia.functions.scripts import transliterated
    from affinia.functions.text import nfkc_casefold

    spark.udf.register("nfkc_casefold", nfkc_casefold)
    spark.udf.register("transliterated", transliterated)
    for name in RATIOS:
        spark.udf.register(f"{name}_of", _single(name))


def _single(name: str):
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_FUNCTIONS[name](x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    scored.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(scored, "double")
