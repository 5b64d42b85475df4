import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from affinia.llm import lm_scoring, words


def test_scores_tell_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = lm_scoring.cross_entropy_difference(docs, labels.filter("quality = 1")).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q and r.score is not None] for q in (1, 0))
    assert np.median(good) < 0 < np.median(bad)


def brute(docs, targets):
    """The same models with dictionaries, from words and not from arrays."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    code = lambda w: int(words.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) >> (64 - lm_scoring.CLASS_BITS)
    cell = lambda a, b: int(words.mixed(np.array([a << lm_scoring.CLASS_BITS | b], np.uint64))[0]) >> (64 - lm_scoring.PAIR_BITS)
    split = [[code(w) for w in pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for _, t in docs]
    start = 1 << lm_scoring.CLASS_BITS
    models = []
    for chosen in (targets, None):
        one, two = {}, {}
        for (i, _), w in zip(docs, split, strict=True):
            if chosen is None or i in chosen:
                for a, b in zip([start, *w], w, strict=False):
                    two[cell(a, b)] = two.get(cell(a, b), 0) + 1
                    one[b] = one.get(b, 0) + 1
                if w:
                    one[start] = one.get(start, 0) + 1
        models.append((one, two))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        losses = []
        for one, two in models:
            total = sum(v for k, v in one.items() if k != start)
            p = lambda b: (one.get(b, 0) + lm_scoring.ALPHA) / (total + lm_scoring.ALPHA * start)  # noqa: E731, B023
            losses.append(sum(-math.log((min(two.get(cell(a, b), 0), one.get(a, 0)) + lm_scoring.PRIOR * p(b)) / (one.get(a, 0) + lm_scoring.PRIOR)) for a, b in zip([start, *w], w, strict=False)))  # noqa: B023
        out.append((i, len(w), *(x / len(w) if w else None for x in losses)))
    return out


def test_equals_brute_force(spark):
    docs = [(1, "The cat sat. The cat ran."), (2, None), (3, "a dog, a CAT"), (None, "the the the"), (4, ""), (5, "é ü é ü"), (5, "again")]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, target string")
    got = lm_scoring.cross_entropy_difference(table, spark.createDataFrame([(1,), (5,), (None,), (77,), (1,)], "doc_id long")).collect()
    expected = {(e[0], e[1]): e for e in brute(docs, {1, 5})}
    for g in got:
        e = expected[g.doc_id, g.n_tokens]
        if e[1]:
            assert (g.target_loss, g.background_loss) == pytest.approx(e[2:], rel=1e-5)
            assert g.score == pytest.approx(e[2] - e[3], rel=1e-3, abs=1e-5)
        else:
            assert g.target_loss is None and g.score is None


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")
    assert lm_scoring.cross_entropy_difference(docs, none).count() == 1
    assert lm_scoring.cross_entropy_difference(docs.limit(0), none).collect() == []


def test_words_and_pairs_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1 << 18, raising=False)
    draw = np.random.default_rng(1).integers(0, 1_000_000, (80, 5000))
    split = [[f"w{x}" for x in row] for row in draw] + [["w1", "w2", "w1", "w2"]]
    chosen = set(range(0, 80, 7)) | {80}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(split)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(table, spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()}
    size = max(1 << 18, len({x for w in split for x in w}))
    assert size > 1 << 18
    for column, of in (("target_loss", chosen), ("background_loss", range(81))):
        one, two = Counter(x for i in of for x in ["", *split[i]]), Counter(p for i in of for p in pairwise(["", *split[i]]))
        total = sum(one.values()) - one[""]
        for i, w in enumerate(split):
            p = [(two[a, b] + 8 * (one[b] + 0.5) / (total + 0.5 * size)) / (one[a] + 8) for a, b in pairwise(["", *w])]
            assert got[i][column] == pytest.approx(-sum(map(math.log, p)) / len(w), rel=1e-9)
    assert len(got) == len(split)
