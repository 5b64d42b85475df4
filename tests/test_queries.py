"""Every query with SQL gives the same rows as that SQL; the others run."""

import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from affinia import queries
from affinia.operators import blocking
from affinia.operators import pairs as targets
from affinia.sources import records

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(x):
    x = float(x) if hasattr(x, "as_tuple") else x
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(map(cell, r)) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pair_queries_take_all_candidates(spark):
    """Pairs by nested loops over the records' keys, and measures from plain strings."""
    e = records.entity_view(spark, SF)
    keyed = [r.asDict() for r in blocking.with_keys(e, blocking.VARIANTS["ALL_V2"]).collect()]
    named = {r.entity_id: (r.business_name, r.business_address) for r in e.collect()}
    meet = lambda a, b: a["block_country"] == b["block_country"] and any(a[k] and a[k] == b[k] for k in blocking.BLOCKS)
    pairs = {(a["entity_id"], b["entity_id"]) for a in keyed if a["source"] == 1 for b in keyed if b["source"] > 1 and meet(a, b)}
    true = {tuple(r) for r in queries._truth(e).collect()} & pairs
    run = lambda n: entry.queries()[n](spark, SF).collect()

    def lcs(x, y):
        old = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(old[j] + 1 if c == d else max(old[j + 1], new[j]))
            old = new
        return old[-1]

    def ratio(x, y):
        return 200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0

    def cosine(x, y, n):
        p, q = (Counter(z[i : i + n] for i in range(len(z) - n + 1)) for z in (x, y))
        return sum(v * q[k] for k, v in p.items()) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values())) if p and q else 0.0

    tables = [entry.queries()[n](spark, SF) for n in ("indel_ratio_pairs", "token_sort_ratio_pairs", "char_ngram_cosine", "address_sets_jaccard", "length_token_features")]
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.join(t, queries.PAIR)
    measured = {tuple(r)[:2]: r for r in joined.collect()}
    assert set(measured) == pairs
    for (i, j), r in measured.items():
        (x, xa), (y, ya) = named[i], named[j]
        p, q = (set(re.findall("[A-Z0-9]+(?:-[A-Z0-9]+)*", z.upper().strip())) for z in (xa, ya))
        assert r.ratio == pytest.approx(ratio(x, y), abs=1e-5)
        assert r.token_sort_ratio == pytest.approx(ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))), abs=1e-5)
        assert (r.cosine_3, r.cosine_4, r.cosine_5) == pytest.approx(tuple(cosine(x, y, n) for n in (3, 4, 5)), abs=1e-5)
        assert r.jaccard == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0, abs=1e-5)
        assert r.length_diff == abs(len(x) - len(y))
    assert {tuple(r)[:2] for r in run("wratio_pairs")} == {tuple(r)[:2] for r in run("base_features")} == pairs
    assert sum(r.n for r in run("similarity_categories")) == len(pairs)
    assert sum(r.n for r in run("hard_negative_zones")) == len(pairs - true)
    version = targets.target_categories(3)
    scored = queries._similar(spark, SF).select("source1_entity_id", "target_entity_id", *[c.alias(k) for k, c in version.items()]).collect()
    expected = {tuple(r)[:2] for r in scored if any(r[k] for k in version)} - true
    assert {tuple(r)[:2] for r in run("targeted_negatives")} == expected if len(expected) <= 50 else len(run("targeted_negatives")) >= 50
