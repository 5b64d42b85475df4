"""Labelled pairs: positives, hard negatives, categories, samples and splits.

Random choices follow the md5 of a seed and the ids, so they don't depend on partitions or on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia import storage

SEED = 42
#: Targets in a bucket of random negatives, and parts of a group that is sampled.
BUCKET, PARTS = 64, 64
PAIR = ["source1_entity_id", "target_entity_id"]


def lot(*columns: Column | str, seed: int = SEED) -> Column:
    """A reproducible random rank: hex text, compared as such."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """candidates with label 1 for true pairs and 0 for others."""
    return candidates.join(truth.select(*PAIR).withColumn("label", F.lit(1)), PAIR, "left").fillna(0, ["label"])


def zeros(drawn: Column) -> Column:
    """How many zeros begin a lot: the lower the lot, the more."""
    return F.length(drawn) - F.length(F.ltrim(drawn, F.lit("0")))


def cuts(pairs: DataFrame, most: dict[str | None, int]) -> DataFrame:
    """(source1_entity_id, kind, cut): the value of ``coarse`` that a record's first ``most[kind]`` pairs reach.

    coarse descends along the order in which pairs are taken and has few values, so only counts are shuffled.
    """
    counts = pairs.groupBy("source1_entity_id", "kind", "coarse").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("source1_entity_id", "kind").orderBy(F.desc("coarse")))
    n = F.coalesce(*[F.when(F.col("kind").eqNullSafe(F.lit(k)), F.lit(v)) for k, v in most.items()])
    full = F.max(F.when(F.col("upto") >= n, F.col("coarse")))
    return counts.withColumn("upto", upto).groupBy("source1_entity_id", "kind").agg(F.coalesce(full, F.min("coarse")).alias("cut"))


def thinned(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Pairs without most of those that top_by_score(k) would drop: the k best of a record in each Arrow batch stay.

    A record's pairs under one key come one after another, so little is left to be shuffled and sorted.
    """

    def best(batches):
        for b in batches:
            t = b.sort_values([score, "target_entity_id"], ascending=[False, True], kind="stable")
            yield t.groupby("source1_entity_id", sort=False).head(k)

    return scored.mapInPandas(best, scored.schema)


def top_negatives(pairs: DataFrame, n: int, by: str = "n_blocks", seed: int = SEED) -> DataFrame:
    """For each source1 record the n negatives with the most of ``by``, by lot among equals."""
    order = Window.partitionBy("source1_entity_id").orderBy(F.desc(by), lot(*PAIR, seed=seed), "target_entity_id")
    return pairs.filter("label = 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def training_pairs(candidates: DataFrame, truth: DataFrame, negatives: int = 20) -> DataFrame:
    """All positives and the hardest negatives of each record; kind is positive or hard_negative, blocks are kept."""
    pairs = labelled(candidates, truth)
    positives = pairs.filter("label = 1").withColumn("kind", F.lit("positive"))
    return positives.unionByName(top_negatives(pairs, negatives).withColumn("kind", F.lit("hard_negative")))


def _drawn(*columns: Column | str, seed: int) -> Column:
    """A lot as a whole number."""
    return F.conv(F.substring(lot(*columns, seed=seed), 1, 15), 16, 10).cast("long")


def random_negatives(source1: DataFrame, targets: DataFrame, truth: DataFrame, take: dict[int, int], seed: int = SEED) -> DataFrame:
    """For each source1 record, take[source] targets of each source by lot, true pairs left out.

    Targets are dealt to buckets of about BUCKET by lot. A record's own lot names neighbouring buckets, two
    or as many more as hold twice what it takes, and it takes from these: no record is compared with all
    targets, and no source is sorted as a whole.
    """
    counts = {r["source"]: r["n"] for r in targets.groupBy("source").agg(F.count("*").alias("n")).collect()}
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(n).alias("n"), F.lit(max(1, counts.get(s, 0) // BUCKET)).cast("long").alias("buckets")) for s, n in take.items()]))
    want = source1.select(F.col("entity_id").alias("source1_entity_id"), kinds.alias("k")).select("source1_entity_id", "k.*")
    first = F.pmod(_drawn("source1_entity_id", F.col("source").cast("string"), seed=seed), F.col("buckets"))
    asked = want.withColumn("first", first).select("source1_entity_id", "source", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), 1 + (F.col("n") * 2 / BUCKET).cast("long")), lambda k: (F.col("first") + k) % F.col("buckets")))).alias("bucket"))
    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(max(1, counts.get(s, 0) // BUCKET))) for s in take], F.lit(1)).cast("long")
    dealt = targets.select("source", F.pmod(_drawn("entity_id", seed=seed), number).alias("bucket"), F.col("entity_id").alias("target_entity_id"))
    met = asked.join(dealt, ["source", "bucket"]).join(truth, PAIR, "left_anti")
    rank = F.row_number().over(Window.partitionBy("source1_entity_id", "source").orderBy(lot(*PAIR, seed=seed), "target_entity_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= F.col("n")).select(*PAIR, "source")


def sample(df: DataFrame, n: int, key: str = "entity_id", seed: int = SEED) -> DataFrame:
    """n rows by lot."""
    return df.orderBy(lot(F.col(key).cast("string"), seed=seed), key).limit(n)


def sample_by_group(df: DataFrame, n: int, group: list[str], key: list[str], seed: int = SEED) -> DataFrame:
    """n rows by lot of each group: first of each of its parts, so that no group has to be sorted as a whole."""
    rank, part = F.row_number(), F.pmod(F.xxhash64(*key), F.lit(PARTS))
    few = df.withColumn("lot_part", part).withColumn("lot_rank", rank.over(Window.partitionBy(*group, "lot_part").orderBy(lot(*key, seed=seed), *key))).filter(F.col("lot_rank") <= n)
    return few.withColumn("lot_rank", rank.over(Window.partitionBy(*group).orderBy(lot(*key, seed=seed), *key))).filter(F.col("lot_rank") <= n).drop("lot_rank", "lot_part")


def split_entities(entities: DataFrame, holdout: int, dev: int, seed: int = 2026) -> DataFrame:
    """entity_id and split: the first ``holdout`` by lot, the next ``dev``, and train for the rest; no entity in two.

    The few rows up to the limit are found by a bounded sort, not by numbering all entities.
    """
    ranked = entities.select("entity_id").distinct().withColumn("lot", lot("entity_id", seed=seed))
    first = ranked.orderBy("lot", "entity_id").limit(holdout + dev)
    number = F.row_number().over(Window.orderBy("lot", "entity_id"))
    chosen = first.withColumn("split", F.when(number <= holdout, "holdout").otherwise("dev")).select("entity_id", "split")
    return ranked.select("entity_id").join(chosen, "entity_id", "left").fillna("train", ["split"])


def split_by_share(entities: DataFrame, test_percent: int = 20, seed: int = SEED) -> DataFrame:
    """entity_id and split (train or test) by lot: about test_percent of the entities, without any sort."""
    share = F.pmod(F.conv(F.substring(lot("entity_id", seed=seed), 1, 8), 16, 10).cast("long"), F.lit(100))
    return entities.select("entity_id").distinct().withColumn("split", F.when(share < test_percent, "test").otherwise("train"))


def stratified_split(pairs: DataFrame, test_percent: int = 20, seed: int = SEED) -> DataFrame:
    """Rows split by lot with the same share of each label: of n rows floor(n * test_percent / 100) go to test.

    An entity may be on both sides. Where the cut lies follows from counts of the lot's first 16 bits by
    label; only rows that share these with the cut are ranked, so no label is sorted as a whole.
    """
    drawn = pairs.withColumn("lot", lot(*PAIR, seed=seed)).withColumn("bin", F.substring("lot", 1, 4))
    label = Window.partitionBy("label")
    bins = drawn.groupBy("label", "bin").agg(F.count("*").alias("rows"))
    upto = bins.withColumns({"before": F.sum("rows").over(label.orderBy("bin")) - F.col("rows"), "take": F.floor(F.sum("rows").over(label) * test_percent / 100)})
    cut = upto.select("label", "bin", (F.col("take") - F.col("before")).alias("left"), "rows")
    placed = drawn.join(cut, ["label", "bin"])
    whole = placed.filter("left <= 0 or left >= rows").withColumn("split", F.when(F.col("left") > 0, "test").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy("label", "bin").orderBy("lot", *PAIR))
    parted = placed.filter("left > 0 and left < rows").withColumn("split", F.when(rank <= F.col("left"), "test").otherwise("train"))
    return whole.unionByName(parted).select(*pairs.columns, "split")


def first_category(pairs: DataFrame, priority: list[str]) -> DataFrame:
    """One row for each pair: that of the category named first in priority."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("category"))
    order = Window.partitionBy(*PAIR).orderBy(F.when(rank == 0, len(priority) + 1).otherwise(rank), "category")
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def first_named(names: Column, priority: list[str]) -> Column:
    """first_category for a pair's array of categories, without a sort of pairs."""
    rest = F.array_sort(F.array_except(names, F.array(*map(F.lit, priority))))
    return F.coalesce(*[F.when(F.array_contains(names, k), F.lit(k)) for k in priority], F.get(rest, F.lit(0)))


def oversampled(pairs: DataFrame, condition: Column, times: int = 3) -> DataFrame:
    """Rows that meet the condition ``times`` times over, others once."""
    copies = F.sequence(F.lit(1), F.when(condition, F.lit(times)).otherwise(F.lit(1)))
    return pairs.withColumn("copy", F.explode(copies))


def hard_score() -> Column:
    """How close a negative comes, from four features."""
    return F.col("norm_name_ratio") * 0.35 + F.col("norm_address_ratio") * 0.35 + F.col("name_no_suffix_wratio") * 0.15 + F.col("norm_address_token_set_ratio") * 0.15


def hard_buckets() -> dict[str, Column]:
    """Kinds of hard negatives by their features, in order of priority. Names and limits are fixed values."""
    name, address = F.col("norm_name_ratio"), F.col("norm_address_ratio")
    return {
        "A_high_name_bad_address": (name >= 85) & (address <= 70),
        "B_high_address_weak_name": (F.col("norm_address_token_set_ratio") >= 85) & (name <= 60),
        "C_no_suffix_high_name_bad_address": (F.col("name_no_suffix_wratio") >= 90) & (address <= 70),
        "D_high_name_number_conflict": (name >= 85) & (F.col("address_number_match") == 0) & (F.col("address1_missing") == 0) & (F.col("address2_missing") == 0),
    }


def leading(df: DataFrame, n: int, coarse: Column, order: list[Column]) -> DataFrame:
    """The n first rows by ``order``; ``coarse`` ascends along it, has few values and no null.

    Counts by coarse value show where the cut lies. Only rows that share it with the cut are ranked, so
    no partition sends n rows to one task, as a sort with a limit does. df is read three times.
    """
    binned = df.withColumn("cut_bin", coarse)
    counts = binned.groupBy("cut_bin").agg(F.count("*").alias("cut_rows"))
    left = F.lit(n) - F.sum("cut_rows").over(Window.orderBy("cut_bin")) + F.col("cut_rows")
    placed = binned.join(counts.withColumn("cut_left", left).filter("cut_left > 0"), "cut_bin")
    whole = placed.filter("cut_left >= cut_rows")
    rank = F.row_number().over(Window.partitionBy("cut_bin").orderBy(*order))
    parted = placed.filter("cut_left < cut_rows").withColumn("cut_rank", rank).filter("cut_rank <= cut_left")
    return whole.select(*df.columns).unionByName(parted.select(*df.columns))


def hard_negative_dataset(features: DataFrame, hard: int = 40_000, total: int = 160_000, seed: int = SEED) -> DataFrame:
    """All positives, the ``hard`` closest bucketed negatives, and others by lot up to ``total`` negatives; kind says which.

    The features are written to the shared folder first, so that each pair's are reckoned once.
    """
    features = storage.materialize(features, "features")
    bucket = F.coalesce(*[F.when(c, F.lit(k)) for k, c in hard_buckets().items()])
    negatives = features.filter("label = 0").withColumn("kind", bucket).withColumn("hard_score", hard_score())
    keys = ["entity_id", "target_entity_id"]
    bucketed = negatives.filter("kind is not null")
    chosen = leading(bucketed, hard, F.floor(F.coalesce("hard_score", F.lit(-1)) * -100), [F.desc("hard_score"), *map(F.col, keys)])
    rest = negatives.join(chosen.select(*keys), keys, "left_anti").withColumn("kind", F.lit("random"))
    drawn = lot(*keys, seed=seed)
    filled = leading(rest, max(0, total - min(hard, bucketed.count())), F.substring(drawn, 1, 4), [drawn, *map(F.col, keys)])
    positives = features.filter("label = 1").withColumn("kind", F.lit("positive")).withColumn("hard_score", hard_score())
    return positives.unionByName(chosen).unionByName(filled)


def target_categories(version: int = 3) -> dict[str, Column]:
    """Kinds of near misses by name_sim and address_sim; a pair may be of several. Names and limits are fixed values."""
    name, address = F.col("name_sim"), F.col("address_sim")
    out = {
        "similar_name": name >= 90,
        "similar_address": address >= 80,
        "name_address": (name >= 90) & (address >= 80),
        "same_name_diff_address": (name >= 95) & (address < 70),
        "same_address_diff_name": (address >= 90) & (name < 70),
    }
    if version >= 3:
        out |= {"name_strong_address_weak": (name >= 90) & (address < 50), "address_strong_name_weak": (address >= 90) & (name < 50)}
    return out


def targeted_negatives(scored: DataFrame, per_category: int = 5_000, version: int = 3, seed: int = SEED) -> DataFrame:
    """Of each category per_category pairs by lot, each pair once under its first category."""
    kinds = target_categories(version)
    rows = scored.withColumn("category", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull())))
    return first_category(sample_by_group(rows, per_category, ["category"], PAIR, seed), list(kinds))


def block_targeted_negatives(pairs: DataFrame, strong: int = 300, control: int = 5, seed: int = SEED) -> DataFrame:
    """Per record the strongest negatives with two or more shared keys, and a few with one as control."""
    kind = F.when(F.col("n_blocks") >= 2, "strong").otherwise("control")
    order = Window.partitionBy("source1_entity_id", "kind").orderBy(F.desc("n_blocks"), lot(*PAIR, seed=seed), "target_entity_id")
    ranked = pairs.filter("label = 0").withColumn("kind", kind).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= F.when(F.col("kind") == "strong", strong).otherwise(control)).drop("rank")


def top_by_score(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """For each source1 record the k best pairs, the lower target id first among equals."""
    order = Window.partitionBy("source1_entity_id").orderBy(F.desc(score), "target_entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Zones of negatives that a threshold on similarity would let through, by name and address similarity; a pair may be in several. Fixed values.
ZONES = {
    "name_80_address_80": lambda n, a: (n >= 80) & (a >= 80),
    "name_90_address_below_60": lambda n, a: (n >= 90) & (a < 60),
    "name_below_60_address_80": lambda n, a: (n < 60) & (a >= 80),
    "name_below_40_address_70": lambda n, a: (n < 40) & (a >= 70),
    "name_80_address_below_40": lambda n, a: (n >= 80) & (a < 40),
}


def danger_zones(name: str = "name_sim", address: str = "address_sim") -> dict[str, Column]:
    """ZONES of columns."""
    return {k: zone(F.col(name), F.col(address)) for k, zone in ZONES.items()}


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, or an error if a key occurs twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} occur more than once: {twice[0]}")
    return df


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if a key is in both tables."""
    if a.select(key).join(b.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"the same {key} is in both tables")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both tables hold the same keys, each as often."""
    return not a.select(*keys).exceptAll(b.select(*keys)).limit(1).count() and not b.select(*keys).exceptAll(a.select(*keys)).limit(1).count()


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that keeps the rows of left as they are: right must hold each key once at most."""
    return left.join(assert_unique(right, keys), keys, "left")


def matched_records(truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs with both records' columns (s1_..., t_...); pairs that lack a record drop out."""
    a = records.select([F.col(c).alias("s1_" + c) for c in records.columns])
    b = records.select([F.col(c).alias("t_" + c) for c in records.columns])
    return truth.join(a, truth["source1_entity_id"] == a["s1_entity_id"]).join(b, truth["target_entity_id"] == b["t_entity_id"])


def zone_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Negatives in each danger zone, by columns such as the country, with the mean and median of 0.6 name + 0.4 address."""
    mean = F.col("name_sim") * 0.6 + F.col("address_sim") * 0.4
    zones = [F.count_if(c).alias(k) for k, c in danger_zones().items()]
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(mean), 2).alias("mean"), F.round(F.median(mean), 2).alias("median"), *zones)


def counted_zone_summary(counted: DataFrame, by: list[str]) -> DataFrame:
    """zone_summary from features.counted_zones."""
    total = F.sum("n")
    zones = [F.sum(k).alias(k) for k in ZONES]
    mean, median = F.sum(F.col("mean") * F.col("n")) / total, F.percentile("mean", 0.5, F.col("n"))
    return counted.groupBy(*by, "mean").agg(total.alias("n"), *zones).groupBy(*by).agg(total.alias("n"), F.round(mean, 2).alias("mean"), F.round(median, 2).alias("median"), *zones)
