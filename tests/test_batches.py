"""Ratios of arrays of pairs are those of single pairs, and so is what is made of them."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia import queries
from affinia.functions import batches, similarity
from affinia.operators import blocking, rows
from affinia.sources import records as R

SF = "/root/testdata/sf0.001"


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé\U0001f600") for _ in range(r.randint(1, 9))) for _ in range(40)] + ["x" * 70, "q" * 64]
    made = [r.choice((" ", "  ")).join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 4, 4, 8, 10, 14, 25)))) for _ in range(150)]
    return list(dict.fromkeys(["", " ", "a", "a a", "z" * 300, "z " * 200, *made]))


@pytest.mark.parametrize("guarded", [False, True])
def test_ratios_of_arrays_are_those_of_single_pairs(guarded):
    t, rng = texts(), np.random.default_rng(1)
    i, j = rng.integers(0, len(t), 2500), rng.integers(0, len(t), 2500)
    got = batches.Texts(t).measured(i, j, similarity.RATIOS, guarded)
    want = [similarity.measured_one(t[a], t[b], similarity.RATIOS, guarded) for a, b in zip(i, j, strict=True)]
    assert [list(x) for x in zip(*[got[n] for n in similarity.RATIOS], strict=True)] == want


def test_rounded_is_half_up_of_the_decimal():
    x = np.array([0.7421875, 74.21875, 0.0000005, 2.5e-7, 100.0, 33.3333335, 66.66666666666667, 0.0])
    assert list(batches.rounded(x)) == [float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x]


@pytest.mark.parametrize("query", ["base_features", "alternative_features", "similarity_categories", "token_set_ratio_pairs"])
def test_pairs_made_by_tasks_equal_joined_pairs(spark, monkeypatch, query):
    """In units and chunks that cut keys apart, the same rows as where pairs are shuffled; and no pair crosses to Python."""
    monkeypatch.setattr(blocking, "UNIT", 7)
    run = getattr(queries, query)
    new = run(spark, SF)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(R, "unique_ids", lambda *_: False)
    old = run(spark, SF)
    assert new.dtypes == old.dtypes and sorted(new.collect()) == sorted(old.collect())


def test_rows_pair_by_unit_in_parts(spark, monkeypatch):
    """Each pair once, under its first shared key, whatever the sizes of chunks."""
    monkeypatch.setattr(rows, "PAIRS", 5)
    monkeypatch.setattr(rows, "TOGETHER", 3)
    held = spark.createDataFrame([(f"a{k}", True, 0, "x", k % 2, 0, "x", "p" if k < 2 else "") for k in range(4)] + [(f"b{k}", False, 0, "x", m, 0, "x", "p") for k in range(3) for m in (0, 1)] + [(f"a{k}", True, 1, "p", 0, 0, "x", "p") for k in range(2)] + [("b0", False, 1, "p", 0, 0, "x", "p"), ("c", False, 1, "p", 0, 0, "y", "p")], "entity_id string, first_side boolean, place int, value string, left_unit int, right_unit int, k0 string, k1 string")
    unit = ["place", "value", "left_unit", "right_unit"]
    batches_ = held.orderBy(*unit).toArrow().to_batches(max_chunksize=2)
    found = []
    for table in rows.whole_units(iter(batches_), unit):
        r = rows.Rows(table)
        ids = table["entity_id"].to_pylist()
        found += [(ids[a], ids[b]) for i, j in r.pairs(unit, ("k0", "k1")) for a, b in zip(i, j, strict=True)]
    assert sorted(found) == sorted([(f"a{k}", f"b{m}") for k in range(4) for m in range(3)] + [("a0", "c"), ("a1", "c")])


def test_copies_count_as_often_as_they_occur(spark):
    """Copies of records are one record with a count; the counts are those of all pairs."""
    from affinia.operators import features

    e = R.entity_view(spark, SF)
    more = e.unionAll(e.limit(60).withColumn("entity_id", F.concat("entity_id", F.lit("-copy"))))
    keyed = blocking.with_keys(more, blocking.VARIANTS["ALL_V2"])
    assert features.counted_similarities(keyed, blocking.STEPS).agg(F.sum("n")).first()[0] == blocking.carried_pairs(keyed).count()


def test_rules_from_counts_of_tasks_equal_rules_from_all_pairs(spark, monkeypatch):
    """Each pair is made once, and only counts and first pairs leave the tasks; with parts so small that records come apart."""
    monkeypatch.setattr(blocking, "UNIT", 7)
    made = []
    monkeypatch.setattr(blocking, "measured_pairs", lambda *a, f=blocking.measured_pairs: made.append(a) or f(*a))
    new = sorted(queries.threshold_topk_search(spark, SF).collect())
    assert len(made) == 1
    monkeypatch.setattr(R, "unique_ids", lambda *_: False)
    assert new == sorted(queries.threshold_topk_search(spark, SF).collect())
