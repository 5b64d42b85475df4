import pytest
from pyspark.sql import functions as F

from affinia.operators import blocking, evaluate, features, model, pairs, profile
from affinia.plans import linkage
from affinia.sources import records as R
from affinia.streaming import candidates as streaming

SF = "/root/testdata/sf0.001"
PAIR = ["source1_entity_id", "target_entity_id"]


@pytest.fixture(scope="module")
def entities(spark):
    return R.entity_view(spark, SF).cache()


@pytest.fixture(scope="module")
def truth(entities):
    a, b = entities.filter("source = 1"), entities.filter("source > 1")
    return a.select(F.col("entity_id").alias(PAIR[0]), "text_key").join(b.select(F.col("entity_id").alias(PAIR[1]), "text_key"), "text_key").select(*PAIR).cache()


def small(spark, rows):
    return spark.createDataFrame(rows, "source1_entity_id string, target_entity_id string, score double, label int")


def test_join_equals_nested_loop(entities):
    keyed = blocking.with_keys(entities).cache()
    rows = keyed.collect()
    expected = {}
    for a in rows:
        for b in rows:
            if a.source == 1 and b.source > 1 and a.block_country == b.block_country:
                shared = sorted(k for k in blocking.BLOCKS if a[k] and a[k] == b[k])
                if shared:
                    expected[a.entity_id, b.entity_id] = shared
    got = blocking.any_key_join(keyed.filter("source = 1"), keyed.filter("source > 1")).collect()
    assert {(r[0], r[1]): r.blocks for r in got} == expected and len(got) == len(expected)
    assert all(r.n_blocks == len(r.blocks) for r in got)


def test_blocking_has_no_nested_loop(entities):
    plan = linkage.candidates(entities)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_values_and_countries(spark):
    rows = spark.createDataFrame([("a", 1, "", "", "US"), ("b", 2, "", "", "US"), ("c", 1, "xy", "", ""), ("d", 2, "xy", "", "")], "entity_id string, source int, business_name string, business_address string, country string")
    keyed = blocking.with_keys(rows)
    both = [blocking.any_key_join(keyed.filter("source = 1"), keyed.filter("source = 2"), require_country=c).collect() for c in (False, True)]
    assert [(r[0], r[1]) for r in both[0]] == [("c", "d")] and both[1] == []
    found = features.blocking_features(spark.createDataFrame([("a", "b")], "entity_id string, target_entity_id string"), rows)
    assert found.first().v4_shared_key_count == 0
    assert features.blocking_features(found.select("entity_id", "target_entity_id"), rows, empty_matches=True).first().v4_shared_key_count == 4


def test_diagnosis_and_categories(entities, truth):
    out = blocking.diagnosed(truth, entities).collect()
    assert out and all(r.name_first_status in ("equal", "missing") for r in out)
    cases = [(90, 85), (90, 70), (50, 90), (50, 50), (70, 70), (82, 70)]
    df = entities.sparkSession.createDataFrame(cases, "n int, a int")
    got = [tuple(r) for r in df.select(blocking.similarity_category(F.col("n"), F.col("a")), blocking.similarity_category(F.col("n"), F.col("a"), 2)).collect()]
    assert got == [("high_name_high_address",) * 2, ("high_name_low_address", "mixed_similarity"), ("low_name_high_address",) * 2, ("low_name_low_address",) * 2, ("mixed_similarity",) * 2, ("mixed_similarity",) * 2]


def test_top_negatives_and_training_pairs(entities, truth):
    c = linkage.candidates(entities)
    out = pairs.training_pairs(c, truth, 3)
    rows = out.collect()
    assert {(r[0], r[1]) for r in rows if r.label} == {(r[0], r[1]) for r in truth.join(c, PAIR).collect()}
    per = {}
    for r in rows:
        if not r.label:
            per.setdefault(r[0], []).append(r.n_blocks)
    assert all(len(v) <= 3 for v in per.values())
    best = {r[0]: r.m for r in pairs.labelled(c, truth).filter("label = 0").groupBy(PAIR[0]).agg(F.max("n_blocks").alias("m")).collect()}
    assert {k: max(v) for k, v in per.items()} == best


def test_random_negatives(entities, truth):
    out = pairs.random_negatives(entities.filter("source = 1"), entities.filter("source > 1"), truth, {2: 3, 3: 2})
    rows = out.collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows}) == 5 * entities.filter("source = 1").count()
    assert not out.join(truth, PAIR, "left_semi").count()


def test_splits(entities):
    ids = entities.filter("source = 1").select("entity_id")
    rows = pairs.split_entities(ids, 10, 20).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"holdout": 10, "dev": 20, "train": ids.count() - 30}
    shares = pairs.split_by_share(ids, 30).collect()
    assert len(shares) == ids.count() and {r.split for r in shares} == {"train", "test"}
    a, b = ids.limit(5), ids.exceptAll(ids.limit(5))
    pairs.assert_disjoint(a, b, "entity_id")
    with pytest.raises(ValueError):
        pairs.assert_disjoint(ids, a, "entity_id")


@pytest.mark.parametrize("percent", [0, 20, 35, 100])
def test_stratified_split_by_label(spark, percent):
    rows = spark.range(537).select(F.concat(F.lit("a"), "id").alias("source1_entity_id"), F.lit("t").alias("target_entity_id"), F.when(F.col("id") % 11 == 0, 1).otherwise(0).alias("label"))
    got = {(r.label, r.split): r["count"] for r in pairs.stratified_split(rows, percent).groupBy("label", "split").count().collect()}
    for label, n in ((1, 49), (0, 488)):
        assert got.get((label, "test"), 0) == n * percent // 100 and got.get((label, "train"), 0) == n - n * percent // 100


def test_full_width_names_meet(spark):
    """Compatibility forms of one name are one name, in blocking and in features."""
    rows = [("S1-1", 1, "\uff21\uff22\uff23 \ufb01ne Stra\u00dfe", "12 x", "US"), ("S2-1", 2, "abc fine STRASSE", "99 other", "US")]
    e = spark.createDataFrame(rows, "entity_id string, source int, business_name string, business_address string, country string")
    keyed = blocking.with_keys(e, blocking.VARIANTS["ALL_V4"])
    found = blocking.any_key_join(keyed.filter("source = 1"), keyed.filter("source = 2")).collect()
    assert [(r[0], r[1], r.blocks) for r in found] == [("S1-1", "S2-1", ["name_first", "name_prefix2"])]
    ids = e.filter("source = 1").select("entity_id", F.lit("S2-1").alias("target_entity_id"))
    assert features.base_features(ids, e).first().norm_name_exact == 1.0
    assert features.alternative_features(ids, e).first().raw_name_exact == 1.0


def test_checks(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        pairs.one_to_one(twice, twice, ["k"])
    with pytest.raises(ValueError):
        R.require_columns(twice, ["k", "other"])
    assert pairs.same_keys(twice, twice.select("k"), ["k"]) and not pairs.same_keys(twice, twice.limit(1), ["k"])


SIMILAR = {"b": (95.0, 85.0), "c": (96.0, 40.0), "d": (30.0, 95.0), "e": (10.0, 10.0), "f": (80.0, 39.0), "g": (39.0, 70.0), "h": (59.0, 79.0), "i": (80.0, 80.0), "j": (90.0, 59.0)}
ZONES = {
    "name_80_address_80": lambda n, a: n >= 80 and a >= 80,
    "name_90_address_below_60": lambda n, a: n >= 90 and a < 60,
    "name_below_60_address_80": lambda n, a: n < 60 and a >= 80,
    "name_below_40_address_70": lambda n, a: n < 40 and a >= 70,
    "name_80_address_below_40": lambda n, a: n >= 80 and a < 40,
}


def test_categories(spark):
    every = [("a", k, *v) for k, v in SIMILAR.items()]
    zones = spark.createDataFrame(every, "s string, t string, name_sim double, address_sim double").select([F.count_if(c).alias(k) for k, c in pairs.danger_zones().items()]).first()
    assert zones.asDict() == {k: sum(zone(*v) for v in SIMILAR.values()) for k, zone in ZONES.items()}
    scored = spark.createDataFrame(every[:4], "source1_entity_id string, target_entity_id string, name_sim double, address_sim double")
    got = {r[1]: r.category for r in pairs.targeted_negatives(scored).collect()}
    assert got == {"b": "similar_name", "c": "similar_name", "d": "similar_address"}


def test_f05_rules(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source1_entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "source1_entity_id string, target_entity_id string")
    scored = small(spark, [("a", "x", 0.9, 1), ("a", "q", 0.8, 0), ("c", "q", 0.7, 0)])
    got = {r[0]: r.f05 for r in evaluate.entity_scores(ids, truth, scored).collect()}
    assert got == {"a": pytest.approx(0.5), "b": 0.0, "c": 0.0, "d": 1.0}
    assert evaluate.entity_scores(ids, truth, scored, empty=0.0).filter("source1_entity_id = 'd'").first().f05 == 0
    assert evaluate.macro_f05(ids, truth, scored).first().macro_f05 == pytest.approx(1.5 / 4)
    m = evaluate.micro(ids, truth, scored).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 2)


def test_rule_search_equals_each_rule(spark, entities, truth):
    scored = linkage.candidates(entities).select(*PAIR, (F.col("n_blocks") / 4 - F.pmod(F.xxhash64(*PAIR), F.lit(7)) / 100).alias("score"))
    ids = entities.filter("source = 1").select("entity_id")
    rules = evaluate.rule_search(ids, truth, scored, [0.2, 0.5, 0.99], (None, 1, 2))
    for r in rules.collect():
        one = evaluate.macro_f05(ids, truth, evaluate.selected(scored, r.threshold, r.top_k or None)).first()
        assert (r.macro_f05, r.avg_predictions) == (pytest.approx(one.macro_f05), pytest.approx(one.avg_predictions))
    best = evaluate.best_rule(rules).first()
    assert best.macro_f05 == max(r.macro_f05 for r in rules.collect())


def test_errors_and_reports(spark):
    scored = small(spark, [("a", "x", 0.95, 0), ("a", "y", 0.7, 1), ("b", "z", 0.05, 1), ("b", "w", 0.1, 0)])
    assert {r.outcome for r in evaluate.outcomes(scored, 0.5).collect()} == {"FP", "TP", "FN", "TN"}
    fp, fn = evaluate.error_lists(scored, 0.5)
    assert [r[1] for r in fp.collect()] == ["x"] and [r[1] for r in fn.collect()] == ["z"]
    assert tuple(evaluate.confident_errors(scored, 0.5).first()) == (1, 1)
    report = {r.label: (r.precision, r.recall) for r in evaluate.classification_report(scored, 0.5).collect()}
    assert report == {0: (0.5, 0.5), 1: (0.5, 0.5)}
    assert evaluate.ndcg(scored).first().ndcg == pytest.approx((1 / 1.5849625007 + 1 / 1.5849625007) / 2)
    assert evaluate.quantile_thresholds(scored, 3) == pytest.approx([0.05, 0.4, 0.95])


def test_profiles(spark):
    df = spark.createDataFrame([("a", " ", 1), ("a", "x", 2), (None, "x", 30)], "p string, q string, n int")
    assert {r.column_name: r.missing for r in profile.missing_values(df, ["p", "q"]).collect()} == {"p": 1, "q": 1}
    assert {(r.category, r.value): r.n for r in profile.grouped_counts(df, ["p", "q"]).collect()} == {("p", "a"): 2, ("p", ""): 1, ("q", " "): 1, ("q", "x"): 2}
    assert profile.describe(df, "n").first().p50 == 2
    truth = R.truth_pairs(spark.createDataFrame([("e", "S2-1, S3-2,S2-1"), ("f", "")], R.TRUTH))
    assert sorted(tuple(r) for r in truth.collect()) == [("e", "S2-1"), ("e", "S3-2")]
    assert tuple(profile.match_summary(truth, spark.createDataFrame([("e",), ("f",)], "id string")).first()) == (1, 0, 1, 2, 1, 1)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "NA", "", "null"), ("S1-2", "x\ty", "é", "US")], R.RECORD)
    path = str(tmp_path / "records")
    R.write_tsv(df, path)
    assert sorted(map(tuple, R.read_tsv(spark, path, R.RECORD).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="exist"):
        R.write_tsv(df, path)
    R.write_metrics(df, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    (tmp_path / "bad.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\na\tb\tc\td\na\tb\n")
    assert R.read_tsv(spark, str(tmp_path / "bad.tsv"), R.RECORD, tolerant=True).count() == 1
    assert [r[0] for r in spark.createDataFrame([("s2",), ("Source3",)], "s string").select(R.source_name(F.col("s"))).collect()] == ["S2", "S3"]
    assert R.first_rows(df, 1).first().entity_id == "S1-1" and R.only_ids(df, df.limit(1)).count() == 1 and R.without_ids(df, df.limit(1)).count() == 1


def test_feature_profiles(entities, truth):
    ids = linkage.candidates(entities, linkage.Config(min_blocks=2)).select(F.col(PAIR[0]).alias("entity_id"), PAIR[1])
    base, other = features.base_features(ids, entities), features.alternative_features(ids, entities)
    assert len(features.BASE) == len(features.ALTERNATIVE) == 39
    extra = features.extra_features(base, entities)
    table = features.joined_features(extra, features.address_features(ids, entities), features.blocking_features(ids, entities), features.ngram_features(ids, entities))
    assert len(table.columns) == 2 + 39 + 10 + 10 + 7 + 6 and table.count() == ids.count() == other.count()
    assert table.filter("v4_shared_key_count < 2").count() == 0
    same = table.join(truth.withColumnRenamed(PAIR[0], "entity_id"), ["entity_id", PAIR[1]]).collect()
    assert same and all(r.name_ratio == 100 and r.norm_address_exact == 1 and r.name_address_gap == 0 for r in same)
    assert {len(v) for k, v in features.ABLATIONS.items() if k in ("base40", "relationship45", "suffixconflict43", "full49")} == {40, 45, 43, 49}


def test_model_and_ranker(spark, tmp_path):
    rows = [(f"e{k % 20}", f"t{k}", float(k % 7), float(k % 3), int(k % 7 > 4)) for k in range(200)]
    df = spark.createDataFrame(rows, "entity_id string, target_entity_id string, x double, y double, label int")
    fitted = model.train(df, ("x", "y"), "quick")
    model.save(fitted, str(tmp_path / "m"))
    scored = model.score(model.load(str(tmp_path / "m")), df, ("x", "y")).collect()
    assert min(r.probability for r in scored if r.label) > max(r.probability for r in scored if not r.label)
    assert model.importance(fitted, ("x", "y"))[0][0] == "x"
    ranker = model.train_ranker(df, ("x", "y"))
    ranked = model.rank_score(ranker, df, ("x", "y")).withColumnRenamed("entity_id", PAIR[0])
    assert evaluate.ndcg(ranked).first().ndcg > 0.95


def test_stream_equals_batch(spark, entities, tmp_path):
    targets = entities.filter("source > 1").select("entity_id", "business_name", "business_address", "country")
    targets.repartition(3).write.csv(str(tmp_path / "in"), sep="\t", header=True)
    source1 = entities.filter("source = 1")
    query = streaming.write_candidates(streaming.candidate_stream(streaming.record_stream(spark, str(tmp_path / "in")), source1), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select(*PAIR, F.concat_ws(",", "blocks").alias("b"))
    expected = linkage.candidates(entities).select(*PAIR, F.concat_ws(",", "blocks").alias("b"))
    assert pairs.same_keys(got, expected, [*PAIR, "b"])


def test_empty_inputs(spark, entities, truth):
    none = entities.limit(0)
    assert linkage.candidates(none).count() == 0
    assert evaluate.entity_scores(none.select("entity_id"), truth.limit(0), truth.limit(0)).count() == 0
    assert pairs.top_negatives(pairs.labelled(linkage.candidates(none), truth), 3).count() == 0


def test_misses_and_autopsy(spark, entities, truth):
    found = linkage.candidates(entities)
    assert tuple(blocking.recovered_misses(truth, found).first()) == (truth.count(), truth.count(), 1.0)
    assert tuple(blocking.recovered_misses(truth.limit(0), found).first()) == (0, 0, 1.0)
    assert not blocking.missed_pairs(found, truth).count()
    scored = pairs.labelled(found, truth).withColumn("score", F.col("n_blocks") / 4).select(*PAIR, "label", "score", "n_blocks")
    rows, summary = evaluate.autopsy(scored, entities, 0.5, ["n_blocks", "score"])
    assert {r.outcome for r in rows.collect()} <= {"FP", "FN"} and rows.count() == evaluate.outcomes(scored, 0.5).filter("outcome in ('FP', 'FN')").count()
    assert {(r.outcome, r.feature) for r in summary.collect()} == {("FP", "n_blocks"), ("FP", "score")}
    assert evaluate.errors_by(scored, 0.5, "n_blocks").agg(F.sum("n")).first()[0] == rows.count()


def test_whole_run(entities, truth):
    rule, result = linkage.linked(entities, truth, config=linkage.Config("ALL_V2", negatives=3))
    best, row = rule.first(), result.first()
    assert 0.55 <= best.threshold <= 0.85 and row.entities > 0 and 0 <= row.macro_f05 <= 1


@pytest.mark.parametrize("n", [0, 1, 7, 100, 250, 300, 1000])
def test_leading_rows_equal_a_sort_with_a_limit(spark, n):
    """Scores tie often, one of them is null, and ids settle ties."""
    rows = [(f"e{k:03d}", None if k % 50 == 7 else float(k * 7 % 11) + (k % 3) / 8, k) for k in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, hard_score double, other long")
    order = [F.desc("hard_score"), F.col("entity_id")]
    got = pairs.leading(df, n, F.floor(F.coalesce("hard_score", F.lit(-1.0)) * -1), order)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.orderBy(*order).limit(n).collect()))
