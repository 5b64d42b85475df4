import hashlib
import random
import re

import pytest

from affinia.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def random_rows(rng, n, lengths):
    return [(rng.choice([None, 1, 2, 3, 44]), None if rng.random() < 0.1 else " ".join(rng.choice(["a", "B", "é", "c1", "Z-", "\n"]) for _ in range(rng.choice(lengths)))) for _ in range(n)]


@pytest.mark.parametrize("block", [200_000, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(3)
    docs, items = random_rows(rng, 200, range(60)), random_rows(rng, 40, [0, 2, 3, 4, 5, 6, 12])
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 4)


def test_driver_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert any(r[-1] for r in got)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def test_long_text_and_slices(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") for _ in range(200_000))
    docs = [(1, long + " zu viel des guten"), (2, "zu viel des guten"), (3, long)]
    items = [(9, "zu viel des guten")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=4)
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == [(1, 200_004, 4), (2, 4, 4), (3, 200_000, 0)]


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha new beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta"), (5, "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha, beta; gamma")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    assert [tuple(r) for r in decontaminate.find(index, items, 3).collect()] == [(1, "7", 1, 3)]
    near = {r.doc_id for r in decontaminate.find(index, items, 3, slop=1).collect()}
    assert near == {1, 2}
    assert {r.doc_id for r in decontaminate.find(index, items, 3, slop=2).collect()} == {1, 2, 3}
    assert decontaminate.find(index, items.limit(0), 3).collect() == []
