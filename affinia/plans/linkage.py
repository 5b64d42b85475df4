"""Whole runs: candidate pairs, training pairs, features, and the choice of a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.operators import blocking, evaluate, features, model, pairs


@dataclass(frozen=True)
class Config:
    """What a run can vary."""

    variant: str = "ALL_V4"
    require_country: bool = False
    negatives: int = 20
    sample: int | None = None
    min_blocks: int = 1


def candidates(records: DataFrame, config: Config = Config()) -> DataFrame:
    """Pairs of source 1 with sources 2 and 3 (column ``source``) that share keys."""
    keyed = blocking.with_keys(records, blocking.VARIANTS[config.variant])
    left = keyed.filter("source = 1")
    if config.sample is not None:
        left = pairs.sample(left, config.sample)
    return blocking.any_key_join(left, keyed.filter("source > 1"), require_country=config.require_country).filter(F.col("n_blocks") >= config.min_blocks)


def training_set(records: DataFrame, truth: DataFrame, config: Config = Config(require_country=True)) -> DataFrame:
    """Labelled pairs with both records' columns, the source of the target, and the keys they share."""
    chosen = pairs.training_pairs(candidates(records, config), truth, config.negatives)
    columns = ["business_name", "business_address", "country"]
    a = records.select(F.col("entity_id").alias("source1_entity_id"), *columns)
    b = records.select(F.col("entity_id").alias("target_entity_id"), F.concat(F.lit("source"), F.col("source")).alias("target_source"), *[F.col(c).alias("target_" + c) for c in columns])
    return chosen.join(a, "source1_entity_id").join(b, "target_entity_id").withColumnRenamed("source1_entity_id", "entity_id")


def feature_table(labelled: DataFrame, records: DataFrame, extra: bool = False) -> DataFrame:
    """Base features of labelled pairs, with the extra ones if asked for."""
    ids = labelled.select("entity_id", "target_entity_id", "label")
    base = features.base_features(ids, records)
    return features.extra_features(base, records) if extra else base


def linked(records: DataFrame, truth: DataFrame, preset: str = "quick", config: Config = Config(require_country=True)) -> tuple[DataFrame, DataFrame]:
    """Trains on 60 % of the entities, chooses a rule on 20 %, applies it to the rest: (rule, macro_f05 on the rest)."""
    table = feature_table(training_set(records, truth, config), records)
    entities = records.filter("source = 1").select("entity_id")
    share = pairs.split_by_share(entities, 40, seed=2026).withColumnRenamed("split", "first")
    split = share.join(pairs.split_by_share(entities, 50, seed=2027), "entity_id").select("entity_id", F.when(F.col("first") == "train", "train").when(F.col("split") == "train", "dev").otherwise("holdout").alias("split"))
    rows = table.join(split, "entity_id")
    fitted = model.train(rows.filter("split = 'train'"), features.BASE, preset)
    scored = model.score(fitted, rows.filter("split <> 'train'"), features.BASE).select(F.col("entity_id").alias("source1_entity_id"), "target_entity_id", "label", F.col("probability").alias("score"), "split")
    ids = split.withColumnRenamed("entity_id", "source1_entity_id")
    own = {s: truth.join(ids.filter(F.col("split") == s).select("source1_entity_id"), "source1_entity_id", "left_semi") for s in ("dev", "holdout")}
    rule = evaluate.best_rule(evaluate.rule_search(ids.filter("split = 'dev'").select("source1_entity_id"), own["dev"], scored.filter("split = 'dev'"), evaluate.GRIDS["rules"], (None, 1, 2, 3, 4, 5, 6)))
    best = rule.first()
    chosen = evaluate.selected(scored.filter("split = 'holdout'"), best["threshold"], best["top_k"] or None)
    return rule, evaluate.macro_f05(ids.filter("split = 'holdout'").select("source1_entity_id"), own["holdout"], chosen)
