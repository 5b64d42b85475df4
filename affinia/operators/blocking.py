"""Candidate pairs by blocking: records of two sides that share a key within a country.

A disjunction of key equalities is planned as one equality join over exploded keys; written as OR it
would be a nested loop. A pair's shared keys are collected in a group-by on the pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions import address as A
from affinia.functions import text as X
from affinia.operators.rows import PAIRS, Rows, whole_units

#: Order in which a pair's blocks are named.
BLOCKS = ("name_first", "name_prefix2", "address_number", "address_first")


@dataclass(frozen=True)
class Variant:
    """Which version of each key family a blocking uses."""

    name: str = "v1"
    number: str = "v1"
    address: str = "v1"


VARIANTS = {
    "BASELINE": Variant(),
    "NAME_V2": Variant(name="v2"),
    "ADDRESS_NUMBER_V2": Variant(number="v2"),
    "ADDRESS_FIRST_V2": Variant(address="v2"),
    "ALL_V2": Variant("v2", "v2", "v2"),
    "NAME_V3": Variant("v3", "v2", "v2"),
    "ALL_V3": Variant("v2", "v2", "v3"),
    "ALL_V4": Variant("v2", "v2", "v4"),
}
#: Records of a key on each side that meet in one unit of work.
UNIT = 2000
#: Records at most, about, that are alike and go as one.
COPIES = 16
#: What records share to meet: which key, where, and its value.
KEY = ["place", "block_country", "value"]
#: Conjunctions of baseline keys.
INTERSECTIONS = {
    "I1": ("name_first", "address_number"),
    "I2": ("name_prefix2", "address_number"),
    "I3": ("name_prefix2", "address_first"),
    "I4": ("name_first", "address_first"),
    "I5": ("name_first", "name_prefix2", "address_number"),
}


def key_columns(variant: Variant) -> dict[str, Column]:
    """Blocking values of a record by key, from business_name and business_address; an empty value blocks nothing."""
    plain, where = X.normalized(F.col("business_name")), X.normalized(F.col("business_address"))
    name = {"v1": plain, "v2": X.without_titles(plain), "v3": X.without_misreadings(X.without_titles(plain))}[variant.name]
    first = {"v1": A.first_word, "v2": A.first_unlabelled_word, "v3": A.first_alphabetic_word, "v4": A.anchor_word}[variant.address]
    number = {"v1": A.first_number, "v2": A.house_number}[variant.number]
    return {"name_first": X.name_first(name), "name_prefix2": X.name_prefix2(name), "address_number": number(where), "address_first": first(where)}


def with_keys(records: DataFrame, variant: Variant = VARIANTS["ALL_V4"], last_token: bool = False) -> DataFrame:
    """records with a column for each key, and block_country; last_token: name_last as well."""
    keys = key_columns(variant)
    if last_token:
        keys["name_last"] = X.last_token(X.normalized(F.col("business_name")))
    return records.withColumns({**keys, "block_country": X.folded(F.trim(F.coalesce("country", F.lit(""))))})


def exploded(keyed: DataFrame, id_column: str, blocks: tuple[str, ...] = BLOCKS, require_country: bool = False) -> DataFrame:
    """(id, block, block_country, value) for every key that isn't empty."""
    pairs = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("value")) for b in blocks])
    rows = keyed.select(F.col("entity_id").alias(id_column), "block_country", F.explode(pairs).alias("k")).select(id_column, "k.block", "block_country", "k.value").filter(F.col("value") != "")
    return rows.filter(F.col("block_country") != "") if require_country else rows


def any_key_join(left: DataFrame, right: DataFrame, blocks: tuple[str, ...] = BLOCKS, require_country: bool = False) -> DataFrame:
    """Distinct pairs that share at least one key: source1_entity_id, target_entity_id, blocks (sorted), n_blocks."""
    a, b = exploded(left, "source1_entity_id", blocks, require_country), exploded(right, "target_entity_id", blocks, require_country)
    shared = a.join(b, ["block", "block_country", "value"]).groupBy("source1_entity_id", "target_entity_id").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    return shared.withColumn("n_blocks", F.size("blocks"))


def _met(keyed: DataFrame, carry: tuple[str, ...], blocks: tuple[str, ...], require_country: bool = False, size: Column | None = None) -> DataFrame:
    """A row for each key of a record that both sides have, with how many records (size: of those that a row stands for) of each side have it."""
    rows = keyed.select("entity_id", (F.col("source") == 1).alias("first_side"), "block_country", *blocks, *[c for c in carry if c not in blocks], F.posexplode(F.array(*[F.col(b) for b in blocks])).alias("place", "value")).filter(F.col("value") != "")
    if require_country:
        rows = rows.filter(F.col("block_country") != "")
    key = Window.partitionBy(*KEY)
    size = F.lit(1) if size is None else size
    left, right = (F.sum(F.when(F.col("first_side") == own, size).otherwise(0)).over(key) for own in (True, False))
    return rows.withColumns({"n_left": left, "n_right": right}).filter("n_left > 0 and n_right > 0")


def _units(n: Column | str) -> Column:
    return F.ceil((F.col(n) if isinstance(n, str) else n) / UNIT).cast("int")


def carried_pairs(keyed: DataFrame, carry: tuple[str, ...] = (), blocks: tuple[str, ...] = BLOCKS, min_blocks: int = 1, require_country: bool = False, asked: Column | None = None) -> DataFrame:
    """any_key_join of source 1 with the others for unique entity_ids, with columns of both records as a_... and b_...

    A record takes its keys and the columns of ``carry`` along. A pair that meets under several keys is given out
    only under the first that its records share, so no pair is shuffled, neither to be found once nor to get its
    records' columns. A key's records are dealt to units of UNIT by UNIT, so a frequent key is no single task.
    ``shared`` has a bit for each of ``blocks``. ``asked`` is a condition on blocks, n_blocks, shared and the a_... and b_... columns that a pair must meet.
    """
    on, met, units = KEY, _met(keyed, carry, blocks, require_country), _units

    def dealt(first: bool, id_column: str, prefix: str) -> DataFrame:
        own, other = ("left", "right") if first else ("right", "left")
        side = met.filter("first_side" if first else "not first_side").withColumn(f"{own}_unit", F.pmod(F.xxhash64("entity_id"), units(f"n_{own}")).cast("int"))
        side = side.withColumn(f"{other}_unit", F.explode(F.sequence(F.lit(0), units(f"n_{other}") - 1)))
        named = [F.col(c).alias(prefix + c) for c in dict.fromkeys((*blocks, *carry))]
        return side.select(F.col("entity_id").alias(id_column), *on, "left_unit", "right_unit", *named)

    both = [*on, "left_unit", "right_unit"]
    # The number is given so that small rows, which make many pairs, aren't put into few tasks.
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (dealt(*args).repartition(tasks, *both) for args in ((True, "source1_entity_id", "a_"), (False, "target_entity_id", "b_")))
    same = [F.coalesce((F.col("a_" + k) == F.col("b_" + k)) & (F.col("a_" + k) != ""), F.lit(False)) for k in blocks]
    mask = reduce(lambda x, y: x + y, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(same)])
    first = reduce(lambda rest, i: F.when(same[i], F.lit(i)).otherwise(rest), reversed(range(len(blocks))), F.lit(len(blocks)))
    sets = [sorted(k for i, k in enumerate(blocks) if m >> i & 1) for m in range(1 << len(blocks))]
    named = F.array(*[F.array(*map(F.lit, s)) if s else F.array().cast("array<string>") for s in sets])
    pairs = a.hint("merge").join(b, both).filter(F.col("place") == first)
    pairs = pairs.withColumn("shared", mask).withColumn("n_blocks", F.get(F.array(*[F.lit(len(s)) for s in sets]), F.col("shared")))
    pairs = pairs.filter(F.col("n_blocks") >= min_blocks) if min_blocks > 1 else pairs
    pairs = pairs.withColumn("blocks", F.get(named, F.col("shared")))
    pairs = pairs.filter(asked) if asked is not None else pairs
    return pairs.select("source1_entity_id", "target_entity_id", "blocks", "n_blocks", "shared", *[p + c for p in ("a_", "b_") for c in carry])


def alike(keyed: DataFrame, columns: tuple[str, ...], blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """One row for about COPIES records of a side at most that have the same keys and columns: entity_id is the least, ids are all."""
    own = ["source", "block_country", *dict.fromkeys((*blocks, *columns))]
    sides = keyed.withColumn("source", F.when(F.col("source") == 1, 1).otherwise(2)).select("entity_id", *own)
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.count("*").over(Window.partitionBy(*own)) / COPIES))
    return sides.withColumn("part", part).groupBy(*own, "part").agg(F.min("entity_id").alias("entity_id"), F.collect_list("entity_id").alias("ids")).drop("part")


def measured_pairs(keyed: DataFrame, carry: tuple[str, ...], measure: Callable[[Rows, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, blocks: tuple[str, ...] = BLOCKS, copies: bool = False, together: int = PAIRS) -> DataFrame:
    """What ``measure`` makes of the pairs of carried_pairs, for unique entity_ids; no pair crosses to Python.

    A task gets the records of its units, not their pairs, and pairs them itself: measure gets records with
    the columns of ``carry``, and which of them (source 1 first) are paired, of about ``together`` pairs at a time.
    copies: records that are alike in all these columns are one record with ``ids`` there (Rows.batches gives out their pairs).
    """
    size = None
    if copies:
        keyed, carry, size = alike(keyed, carry, blocks), (*carry, "ids"), F.size("ids")
    met, both = _met(keyed, carry, blocks, size=size), [*KEY, "left_unit", "right_unit"]
    own = F.when(F.col("first_side"), F.col("n_left")).otherwise(F.col("n_right"))
    other = F.when(F.col("first_side"), F.col("n_right")).otherwise(F.col("n_left"))
    # Records with the same first column go together, so that it is measured once, but no more of them than an eighth of a unit.
    same = F.sum(F.lit(1) if size is None else size).over(Window.partitionBy(*KEY, "first_side", carry[0]))
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(same * 8 / UNIT))
    dealt = met.withColumn("own_unit", F.pmod(F.xxhash64(carry[0], part), _units(own)).cast("int")).withColumn("other_unit", F.explode(F.sequence(F.lit(0), _units(other) - 1)))
    sides = {"left_unit": F.when(F.col("first_side"), F.col("own_unit")).otherwise(F.col("other_unit")), "right_unit": F.when(F.col("first_side"), F.col("other_unit")).otherwise(F.col("own_unit"))}
    rows = dealt.withColumns(sides).select("entity_id", "first_side", *both, *dict.fromkeys((*blocks, *carry)))
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_units(batches, both):
            found = Rows(held)
            for i, j in found.pairs(both, blocks, together):
                yield from measure(found, i, j)

    return rows.repartition(tasks, *both).sortWithinPartitions(*both, carry[0]).mapInArrow(run, schema)


def all_keys_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct pairs that share all of these keys, none of them empty."""
    on = ["block_country", *keys]

    def side(records: DataFrame, id_column: str) -> DataFrame:
        return records.filter(reduce(lambda x, y: x & y, [F.col(k) != "" for k in keys])).select(F.col("entity_id").alias(id_column), *on)

    return side(left, "source1_entity_id").join(side(right, "target_entity_id"), on).select("source1_entity_id", "target_entity_id").distinct()


def any_intersection_join(left: DataFrame, right: DataFrame, strategies: tuple[str, ...] = ("I1", "I2", "I3", "I4")) -> DataFrame:
    """Distinct pairs found by at least one conjunction, with the names of those that do."""
    return found_by(any_key_join(left, right), strategies)


def found_by(pairs: DataFrame, strategies: tuple[str, ...] = ("I1", "I2", "I3", "I4")) -> DataFrame:
    """Those of the pairs that at least one conjunction finds, with the names of those that do."""
    if "shared" in pairs.columns:
        found = [[s for s in strategies if all(m >> BLOCKS.index(k) & 1 for k in INTERSECTIONS[s])] for m in range(1 << len(BLOCKS))]
        names = F.get(F.array(*[F.array(*map(F.lit, f)) if f else F.array().cast("array<string>") for f in found]), F.col("shared"))
        return pairs.filter(F.get(F.array(*[F.lit(bool(f)) for f in found]), F.col("shared"))).select("source1_entity_id", "target_entity_id", names.alias("strategies"))
    hits = F.filter(F.array(*[F.when(reduce(lambda x, y: x & y, [F.array_contains("blocks", k) for k in INTERSECTIONS[s]]), F.lit(s)) for s in strategies]), lambda s: s.isNotNull())
    return pairs.select("source1_entity_id", "target_entity_id", hits.alias("strategies")).filter(F.size("strategies") > 0)


def same_first_word_pairs(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """Exploratory block: country and first word of the loosely normalized name, without the true pairs."""

    def side(records: DataFrame, id_column: str) -> DataFrame:
        word = X.name_first(X.loosely_normalized(F.col("business_name")))
        return records.select(F.col("entity_id").alias(id_column), F.lower(F.trim("country")).alias("c"), word.alias("w")).filter("w <> ''")

    pairs = side(left, "source1_entity_id").join(side(right, "target_entity_id"), ["c", "w"]).select("source1_entity_id", "target_entity_id")
    return pairs.join(truth, ["source1_entity_id", "target_entity_id"], "left_anti")


def recall(candidates: DataFrame, truth: DataFrame, n_source1: int) -> DataFrame:
    """One row: true pairs, recovered pairs, recall, candidates, candidates for each of n_source1 records."""
    found = truth.join(candidates.select("source1_entity_id", "target_entity_id").withColumn("hit", F.lit(1)), ["source1_entity_id", "target_entity_id"], "left")
    true = found.agg(F.count("*").alias("truth_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("recovered_pairs"))
    # Two single rows side by side.
    return true.join(candidates.agg(F.count("*").alias("total_candidates")), how="cross").select(
        "truth_pairs", "recovered_pairs", F.when(F.col("truth_pairs") > 0, F.col("recovered_pairs") / F.col("truth_pairs")).otherwise(1.0).alias("candidate_recall"), "total_candidates", (F.col("total_candidates") / F.lit(n_source1)).alias("avg_candidates_per_source1")
    )


def variant_report(records: DataFrame, truth: DataFrame, names: tuple[str, ...] = tuple(VARIANTS)) -> DataFrame:
    """Recall and volume of each variant, and how they differ from the first one's.

    Columns variant, truth_pairs, recovered_pairs, candidate_recall, total_candidates,
    avg_candidates_per_source1, recall_delta, candidates_delta. Every version of a key is computed once
    and joined once; a pair then carries the versions it shares as bits, and each variant asks for its own.
    """
    versions = {(b, _version(VARIANTS[n], b)): n for n in names for b in BLOCKS}
    made = {f"{b}_{v}": key_columns(VARIANTS[n])[b] for (b, v), n in versions.items()}
    keyed = records.select("entity_id", "source", X.folded(F.trim(F.coalesce("country", F.lit("")))).alias("block_country"), *[c.alias(k) for k, c in made.items()])
    pairs = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col(k).alias("value")) for i, k in enumerate(made)])
    rows = keyed.select("entity_id", "source", "block_country", F.explode(pairs).alias("k")).select("entity_id", "source", "block_country", "k.bit", "k.value").filter("value <> ''")
    on = ["bit", "block_country", "value"]
    left = rows.filter("source = 1").select(F.col("entity_id").alias("source1_entity_id"), *on)
    right = rows.filter("source > 1").select(F.col("entity_id").alias("target_entity_id"), *on)
    found = left.join(right, on).groupBy("source1_entity_id", "target_entity_id").agg(F.bit_or("bit").alias("bits"))
    marked = found.join(truth.withColumn("hit", F.lit(1)), ["source1_entity_id", "target_entity_id"], "left")
    place = {k: i for i, k in enumerate(made)}
    masks = {n: sum(1 << place[f"{b}_{_version(VARIANTS[n], b)}"] for b in BLOCKS) for n in names}
    shares = {n: F.col("bits").bitwiseAND(F.lit(m)) != 0 for n, m in masks.items()}
    sums = marked.agg(*[F.count_if(c).alias(f"{n}_all") for n, c in shares.items()], *[F.count_if(c & F.col("hit").isNotNull()).alias(f"{n}_hit") for n, c in shares.items()])
    # Single rows side by side.
    sizes = sums.join(truth.agg(F.count("*").alias("truth_pairs")), how="cross").join(records.filter("source = 1").agg(F.count("*").alias("n_source1")), how="cross")
    listed = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"{n}_hit").alias("recovered_pairs"), F.col(f"{n}_all").alias("total_candidates")) for n in names])
    each = sizes.select("truth_pairs", "n_source1", listed[0].alias("base"), F.explode(listed).alias("v"))

    def share(recovered: Column) -> Column:
        return F.when(F.col("truth_pairs") > 0, recovered / F.col("truth_pairs")).otherwise(1.0)

    return each.select(
        "v.variant",
        "truth_pairs",
        "v.recovered_pairs",
        share(F.col("v.recovered_pairs")).alias("candidate_recall"),
        "v.total_candidates",
        (F.col("v.total_candidates") / F.nullif("n_source1", F.lit(0))).alias("avg_candidates_per_source1"),
        (share(F.col("v.recovered_pairs")) - share(F.col("base.recovered_pairs"))).alias("recall_delta"),
        (F.col("v.total_candidates") - F.col("base.total_candidates")).alias("candidates_delta"),
    )


def _version(variant: Variant, block: str) -> str:
    """Which version of a block's key family a variant uses."""
    return {"address_number": variant.number, "address_first": variant.address}.get(block, variant.name)


def missed_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that no key finds."""
    return truth.join(candidates, ["source1_entity_id", "target_entity_id"], "left_anti")


def diagnosed(pairs: DataFrame, records: DataFrame, variant: Variant = VARIANTS["ALL_V4"]) -> DataFrame:
    """Pairs with both records and, for each key, whether it is equal, different, or missing on a side."""
    keyed = with_keys(records, variant).select("entity_id", "source", "business_name", "business_address", "country", *BLOCKS)
    left = keyed.select([F.col(c).alias("s1_" + c) for c in keyed.columns])
    right = keyed.select([F.col(c).alias("t_" + c) for c in keyed.columns])
    both = pairs.join(left, pairs["source1_entity_id"] == left["s1_entity_id"]).join(right, pairs["target_entity_id"] == right["t_entity_id"])
    return both.withColumns(key_status("s1_", "t_"))


def key_status(a: str, b: str) -> dict[str, Column]:
    """For each key, whether it is equal, different, or missing on a side; a and b begin the columns' names."""
    return {f"{k}_status": F.when((F.col(a + k) == "") | (F.col(b + k) == ""), "missing").when(F.col(a + k) == F.col(b + k), "equal").otherwise("different") for k in BLOCKS}


#: Where similarity_category and high_confidence tell similarities apart, in all versions.
STEPS = (60.0, 80.0, 85.0, 90.0)


def similarity_category(name: Column, address: Column, version: int = 3) -> Column:
    """Five classes of missed pairs by name and address similarity."""
    low_address = address < (60 if version == 2 else 80)
    high, low = name >= (80 if version == 2 else 85), name < 60
    return F.when(high & (address >= 80), "high_name_high_address").when(high & low_address, "high_name_low_address").when(low & (address >= 80), "low_name_high_address").when(low & (address < 60), "low_name_low_address").otherwise("mixed_similarity")


def recovered_misses(previous: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: earlier misses, how many of them the candidates now hold, and their share."""
    found = previous.join(candidates.select("source1_entity_id", "target_entity_id").withColumn("hit", F.lit(1)), ["source1_entity_id", "target_entity_id"], "left")
    return found.agg(F.count("*").alias("missed"), F.coalesce(F.sum("hit"), F.lit(0)).alias("recovered")).withColumn("share", F.when(F.col("missed") > 0, F.col("recovered") / F.col("missed")).otherwise(1.0))


def high_confidence(name: Column, address: Column, version: int = 3) -> Column:
    """Whether a missed pair is surely true by the similarity of its names or addresses."""
    return (name >= (80 if version == 2 else 85)) | (address >= 90)
