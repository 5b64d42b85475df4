import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from affinia.llm import simhash
from affinia.llm.components import connected_components


def components(prints):
    names = sorted(set(prints))
    parent = list(range(len(names)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = np.array(names, np.uint64)
    for i, x in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(every ^ x) <= 3):
            parent[top(i)] = top(int(j))
    return {x: top(i) for i, x in enumerate(names)}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    of, least = components(prints), {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> k
    return x


def cloud(rng):
    """Distinct fingerprints around some centres, in Gray order."""
    members = set()
    for _ in range(rng.randrange(1, 6)):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30, 300])):
            x = centre
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            members.add(x)
    return sorted(members, key=gray)


@pytest.mark.parametrize("step", [16, 1000, 1_000_000])
def test_index_finds_all_components(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = random.Random(step)
    for _ in range(40):
        members = cloud(rng)
        index = simhash.GrayIndex(np.array(members, np.uint64))
        of, root = components(members), simhash.forest(index, index, 3)
        pairs = {(of[x], int(r)) for x, r in zip(members, root, strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_two_groups_meet():
    """What lies across two groups of different sizes is found, and only that."""
    rng = random.Random(5)
    for _ in range(60):
        members = cloud(rng)
        cut = rng.randrange(len(members) + 1)
        sides = [np.array(m, np.uint64) for m in (members[:cut], members[cut:])]
        left, right = map(simhash.GrayIndex, sides)
        got = {(int(sides[0][a]), int(sides[1][b])) for x, y in simhash.meetings(left, right, 3) for a, b in zip(x, y, strict=True)}
        assert got == {(a, b) for a in members[:cut] for b in members[cut:] if (a ^ b).bit_count() <= 3}


def test_index_drops_whole_groups():
    """On the driver's documents groups are dropped by their shared bits, and a part of all pairs is compared: the smaller, the more there are."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    members = sorted({simhash.fingerprint(t) & (1 << 64) - 1 for t in texts}, key=gray)
    shares = []
    for some in (members[::10], members):
        index, seen = simhash.GrayIndex(np.array(some, np.uint64)), Counter()
        simhash.forest(index, index, 3, seen)
        shares.append(seen["compared"] / (len(some) * (len(some) - 1) / 2))
    assert seen["pruned"] > seen["kept"] > 0
    assert shares[1] < 0.3 < shares[0] < 0.9


@pytest.mark.parametrize("group", [7, 1 << 15])
def test_links_over_groups(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    members = sorted({x for _ in range(4) for x in cloud(rng)})
    signed = [x - (1 << 64) if x >> 63 else x for x in members]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), len(members)).collect()
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in found]
    of, parent = components(members), {x: x for x in members}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    pairs = {(of[x], top(x)) for x in members}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_clashing_names_and_other_distances(spark):
    rows = [(k, "one two three four five " * 3 + w, 1, "x", 2) for k, w in enumerate(["", "six", "seven", "entirely other words here " * 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, component_id string, least int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, distance=40).collect()}
    prints = [int(r.fingerprint, 16) for r in sorted(simhash.near_duplicates(docs, distance=0).collect())]
    assert prints == [fingerprint(r[1]) for r in rows]
    assert got == {k: 0 for k in range(4)} or any((prints[3] ^ p).bit_count() > 40 for p in prints[:3])


def test_documents_and_edge_cases(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    near = [(6000 + k, " ".join(w if rng.random() > 0.01 else rng.choice(words) for w in base)) for k in range(60)]
    rows = [(5000, None), (5001, ""), (5002, " a  B"), (None, "a b"), (None, "zzz"), (5003, "a\xa0b c d"), (5002, "other"), (7000, "lorem ipsum " * 40_000), *near]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs.collect()])
    assert len({r[2] for r in got}) < len(got)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(500, 500)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent}
