"""Pair queries shuffle records, not pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from affinia import queries
from affinia.functions.batches import Texts
from affinia.operators import blocking, evaluate, features
from affinia.operators import pairs as targets
from affinia.operators.rows import Rows
from affinia.sources import records as R

SF = "/root/testdata/sf0.001"
PAIR = ["source1_entity_id", "target_entity_id"]
#: Queries without a group-by of pairs or a join of pairs with records.
NAMES = (
    "address_features",
    "address_sets_jaccard",
    "best_rule",
    "blocking_intersections",
    "classification_report",
    "dedup_category_priority",
    "discovery_scores",
    "error_ranking",
    "extra_features",
    "hard_negative_zones",
    "indel_ratio_pairs",
    "intersect_except_ids",
    "length_token_features",
    "miss_diagnosis",
    "similarity_categories",
    "targeted_negatives",
    "targeted_negatives_v2",
    "targeted_negatives_v4",
    "threshold_topk_search",
    "token_set_ratio_pairs",
    "token_sort_ratio_pairs",
    "topn_hard_negatives",
)


@pytest.mark.parametrize("name", NAMES)
def test_no_pair_is_shuffled_to_be_found_or_joined(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set(block" not in plan and not re.search(r"Join \[[^\]]*target_entity_id", plan)


@pytest.mark.parametrize("unit", [3, 2000])
def test_carried_pairs_equal_any_key_join(spark, monkeypatch, unit):
    monkeypatch.setattr(blocking, "UNIT", unit)
    e = R.entity_view(spark, SF)
    keyed = blocking.with_keys(e)
    want = {(r[0], r[1]): (r.blocks, r.n_blocks) for r in blocking.any_key_join(keyed.filter("source = 1"), keyed.filter("source > 1")).collect()}
    name = {r.entity_id: r.business_name for r in e.collect()}
    got = blocking.carried_pairs(keyed, ("business_name",)).collect()
    assert len(got) == len(want) and {(r[0], r[1]): (r.blocks, r.n_blocks) for r in got} == want
    assert all((r.a_business_name, r.b_business_name) == (name[r[0]], name[r[1]]) for r in got)


def test_ids_that_occur_twice_give_each_pair_once(spark):
    e = R.entity_view(spark, SF)
    twice = e.unionAll(e.limit(40))
    assert R.unique_ids(e) and not R.unique_ids(twice)
    rows = queries._pairs(twice).select(*PAIR).collect()
    assert len(rows) == len(set(rows)) and set(rows) == set(queries._pairs(e).select(*PAIR).collect())


def test_cuts_keep_all_that_can_be_first(spark):
    rows = spark.createDataFrame([("a", None, c) for c in (3, 2, 2, 1)] + [("b", None, 1)], "source1_entity_id string, kind string, coarse int")
    assert {r.source1_entity_id: r.cut for r in targets.cuts(rows, {None: 2}).collect()} == {"a": 2, "b": 1}


def test_rule_search_by_counts_equals_the_sort_of_all_pairs(spark):
    e = R.entity_view(spark, SF)
    truth, scored = queries._truth(e), queries._scored_labelled(e).withColumnRenamed("label", "t").cache()
    few = lambda cuts, reached: scored.join(cuts, "source1_entity_id").filter(reached >= F.col("cut"))
    a, b = (evaluate.rule_search(queries._sources(e), truth, scored.drop(*d), [0.3, 0.5, 0.62], (None, 1, 3), few=f).collect() for d, f in ((["t"], None), ([], few)))
    assert sorted(a) == sorted(b)


def test_thinned_keeps_the_best(spark):
    rows = spark.createDataFrame([(s, f"t{i}", float(i * 7 % 5)) for s in "ab" for i in range(40)], "source1_entity_id string, target_entity_id string, score double")
    a, b = (sorted(targets.top_by_score(r, 3).collect()) for r in (rows, targets.thinned(rows.repartition(3), 3)))
    assert a == b


#: Queries whose pairs are made and measured where the records are.
MEASURED = ("address_features", "base_features", "alternative_features", "address_sets_jaccard", "token_sort_ratio_pairs", "targeted_negatives", "targeted_negatives_v2", "discovery_scores", "hard_negative_zones", "extra_features")


@pytest.mark.parametrize("name", MEASURED)
def test_pairs_are_made_where_the_records_are(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Join \[[^\]]*unit", plan)


def _copied(spark):
    """Records of which many are alike, with ids of their own."""
    e = R.entity_view(spark, SF)
    return e.withColumn("k", F.explode(F.sequence(F.lit(1), 1 + F.pmod(F.xxhash64("business_name"), F.lit(4)).cast("int")))).withColumn("entity_id", F.concat("entity_id", F.lit("-"), "k")).drop("k")


def _same_rows(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_copies_give_all_their_address_features(spark, monkeypatch):
    monkeypatch.setattr(blocking, "COPIES", 2)
    e = _copied(spark)
    got = features.measured_address_features(blocking.with_keys(e, blocking.VARIANTS["ALL_V2"]))
    _same_rows(got, queries._rounded(features.address_features(queries._ids(e), e)))


def test_first_words_of_a_text_are_those_of_the_whole(spark, tmp_path):
    texts = [" ".join(["w" * n + str(i) for i in range(40)]) for n in (1, 19, 25, 60)] + ["a b", "", None, " - ".join("abcdefghijklmnopq"), "ß" * 299 + " x", "." * 400 + "y z"]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").replace("ß", "ss")).strip().split(" ")
    got = {int(r.entity_id.split("-")[1]): (r.business_name, r.business_address) for r in R.entity_view(spark, str(tmp_path)).collect()}
    assert got == {i: (" ".join(words(t)[:4]), " ".join(words(t)[4:14])) for i, t in enumerate(texts)}


@pytest.mark.parametrize("alternative", [False, True])
def test_copies_give_all_their_features(spark, monkeypatch, alternative):
    monkeypatch.setattr(blocking, "COPIES", 2)
    monkeypatch.setattr(blocking, "UNIT", 50)
    e = _copied(spark)
    sides = features.prepared(blocking.with_keys(e, blocking.VARIANTS["ALL_V2"]), keep=("source", "block_country", *blocking.BLOCKS))
    got = features.measured_features(sides, alternative)
    _same_rows(got, queries._rounded((features.alternative_features if alternative else features.base_features)(queries._ids(e), e)))


def test_a_text_pair_is_measured_once(monkeypatch):
    table = pa.table({"name": ["ab c", "ab c", "x", "ab d", "ab d"]})
    seen = []
    measured = Texts.measured
    monkeypatch.setattr(Texts, "measured", lambda self, i, j, *a: seen.append(len(i)) or measured(self, i, j, *a))
    i, j = np.array([0, 0, 1, 1, 2, 2]), np.array([3, 4, 3, 4, 3, 4])
    assert Rows(table).measured("name", i, j, ("ratio",))["ratio"].tolist() == [75.0] * 4 + [0.0] * 2 and seen == [2]


def test_errors_come_from_pairs_made_by_joint_keys(spark):
    """Copies with other texts make more than fifty false positives with all four keys; records as they are make fewer."""
    e = R.entity_view(spark, SF)
    for rows in (e, _copied(spark).withColumn("text_key", F.concat("text_key", F.pmod(F.xxhash64("entity_id"), F.lit(2)).cast("string"))).withColumn("business_address", F.concat(F.lit("7 "), "business_address"))):
        want = {tuple(r) for r in queries._scored_labelled(rows).filter("n_blocks >= 3").collect()}
        keyed = blocking.with_keys(rows, blocking.VARIANTS["ALL_V2"])
        c = ["source1_entity_id", "target_entity_id", "n_blocks", "label", "score"]
        assert {tuple(r) for r in queries._close_labelled(keyed).select(*c).collect()} == want
        assert {tuple(r) for r in queries._close_labelled(keyed, four=True).select(*c).collect()} == {w for w in want if w[2] == 4}
        assert {tuple(r) for r in queries._true_scored(keyed).select(*c).collect()} == {tuple(r) for r in queries._scored_labelled(rows).filter("label = 1").collect()}


def test_copies_count_in_rankings_and_zones(spark, monkeypatch):
    monkeypatch.setattr(blocking, "COPIES", 2)
    e = _copied(spark)
    monkeypatch.setattr(R, "entity_view", lambda *a: e)
    similar = queries._similar(spark, SF, untrue=True)
    keyed = blocking.with_keys(e, blocking.VARIANTS["ALL_V2"])
    c = [*PAIR, "name_sim", "address_sim"]
    _same_rows(features.near_untrue(keyed, 90, 80).select(*c), similar.filter("name_sim >= 90 or address_sim >= 80").select(*c))
    best = targets.top_by_score(similar.select(*PAIR, F.round(F.col("name_sim") * 0.6 + F.col("address_sim") * 0.4, 6).alias("score")), 3)
    _same_rows(targets.top_by_score(features.best_untrue(keyed, 3), 3), best)
    _same_rows(targets.counted_zone_summary(features.counted_zones(keyed, targets.ZONES), ["country"]), targets.zone_summary(similar, ["country"]))
