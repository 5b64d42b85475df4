"""Features of pairs of records.

Records are normalized once, before they are joined into pairs, and all edit-based ratios of a pair of
texts come from one Python call; everything else is native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.functions import address as A
from affinia.functions import scripts, similarity
from affinia.functions import text as X
from affinia.functions.batches import rounded
from affinia.operators import blocking
from affinia.operators.pairs import one_to_one
from affinia.operators.rows import Rows

_TEXT = ("ratio", "wratio", "token_sort_ratio", "token_set_ratio", "exact", "length_diff", "length_ratio", "token_count_diff")
#: The primary profile's columns; names that must be these, as all in this module are.
BASE = (
    *(f"name_{x}" for x in _TEXT),
    *(f"address_{x}" for x in _TEXT),
    *(f"norm_name_{x}" for x in _TEXT[:5]),
    "name_no_suffix_ratio", "name_no_suffix_wratio", "name_no_suffix_exact", "name_first_token_same", "name_last_token_same",
    *(f"norm_address_{x}" for x in _TEXT[:5]),
    "address_number_match", "same_country", "source_is_s2", "source_is_s3", "address1_missing", "address2_missing", "name_script_same", "address_script_same",
)
#: The alternative profile's columns.
ALTERNATIVE = (
    *(f"raw_name_{x}" for x in _TEXT),
    *(f"raw_address_{x}" for x in _TEXT),
    *(f"norm_name_{x}" for x in _TEXT[:5]),
    *(f"norm_address_{x}" for x in _TEXT[:5]),
    "suffixless_name_ratio", "suffixless_name_wratio", "suffixless_name_exact", "first_token_agree", "last_token_agree", "address_number_match", "same_country",
    "source2", "source3", "address_missing_any", "address_both_present", "name_script_same", "address_script_same",
)
SUFFIX = ("suffix_both_present", "suffix_same", "suffix_conflict")
RELATIONSHIP = ("name_address_mean", "name_address_min", "name_address_max", "name_address_gap", "name_dominance", "address_dominance")
EXTRA = (*RELATIONSHIP, *SUFFIX, "address_number_conflict")
#: The columns of address_features.
ADDRESS = (
    "address_num_jaccard", "address_num_overlap_min", "address_num_exact_set", "address_num_count_diff", "address_compound_num_exact", "address_compound_num_jaccard",
    "address_alnum_token_jaccard", "address_alnum_token_overlap_min", "address_first_num_exact_normalized", "address_postal_overlap",
)
#: Sets of columns compared with each other.
ABLATIONS = {
    "base39": BASE,
    "base40": (*BASE, "address_number_conflict"),
    "relationship45": (*BASE, *RELATIONSHIP),
    "suffixconflict43": (*BASE, *SUFFIX, "address_number_conflict"),
    "full49": (*BASE, *EXTRA),
    "suffix_present": (*BASE, "suffix_both_present"),
    "suffix_same": (*BASE, "suffix_same"),
    "suffix_conflict": (*BASE, "suffix_conflict"),
    "suffix_all": (*BASE, *SUFFIX),
}
_PAIR = ["entity_id", "target_entity_id"]


def prepared(records: DataFrame, unicode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records with all that the features need of one side, made before any pair is, and the columns of ``keep``."""
    name, address, country = (X.stripped(F.col(c), blank_nan=True) for c in ("business_name", "business_address", "country"))
    base = records.select("entity_id", name.alias("name"), address.alias("address"), F.lower(country).alias("country"), *keep)
    with_norm = base.withColumns({"norm_name": X.normalized(F.col("name"), unicode), "norm_address": X.normalized(F.col("address"), unicode)})
    return with_norm.withColumns(
        {
            "folded_name": X.nfkc_folded(F.col("name")) if unicode else X.folded(F.col("name")),
            "folded_address": X.nfkc_folded(F.col("address")) if unicode else X.folded(F.col("address")),
            "name_no_suffix": X.without_legal_suffix(F.col("norm_name")),
            "suffix": X.legal_suffix(F.col("norm_name")),
            "suffixless_name": X.without_legal_word(F.col("norm_name")),
            "first_token": X.first_token(F.col("norm_name")),
            "last_token": X.last_token(F.col("norm_name")),
            "raw_number": A.first_number(F.col("address")),
            "norm_number": A.first_number(F.col("norm_address")),
            "name_script": scripts.script(F.col("norm_name")),
            "address_script": scripts.script(F.col("norm_address")),
            "name_class": scripts.dominant_script(F.col("name")),
            "address_class": scripts.dominant_script(F.col("address")),
        }
    )


def paired(pairs: DataFrame, records: DataFrame | None, unicode: bool = True) -> DataFrame:
    """pairs (entity_id, target_entity_id, ...) with the prepared columns of both sides as a_... and b_...; without records they have them."""
    if records is None:
        return pairs
    sides = prepared(records, unicode)
    a = sides.select(F.col("entity_id"), *[F.col(c).alias("a_" + c) for c in sides.columns if c != "entity_id"])
    b = sides.select(F.col("entity_id").alias("target_entity_id"), *[F.col(c).alias("b_" + c) for c in sides.columns if c != "entity_id"])
    return pairs.join(a, "entity_id").join(b, "target_entity_id")


def _own(pairs: DataFrame, records: DataFrame | None) -> list[str]:
    """The columns of pairs that go into the result."""
    return [c for c in pairs.columns if records is not None or not c.startswith(("a_", "b_"))]


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _equal(c: str) -> Column:
    return _flag((F.col("a_" + c) != "") & (F.col("a_" + c) == F.col("b_" + c)))


def _same(c: str) -> Column:
    return _flag(F.col("a_" + c) == F.col("b_" + c))


def _sizes(prefix: str, c: str, counted: str, both_empty: float) -> dict[str, Column]:
    """Differences of lengths and word counts."""
    a, b = F.length("a_" + c), F.length("b_" + c)
    ratio = F.when((a == 0) & (b == 0), both_empty).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))
    return {
        f"{prefix}_length_diff": F.abs(a - b).cast("double"),
        f"{prefix}_length_ratio": ratio,
        f"{prefix}_token_count_diff": F.abs(X.token_count(F.col("a_" + counted)) - X.token_count(F.col("b_" + counted))).cast("double"),
    }


def _with_ratios(rows: DataFrame, columns: dict[str, tuple[str, tuple[str, ...]]], guarded: bool) -> DataFrame:
    """Adds {prefix}_{ratio} for each prefix: (column, ratios)."""
    scored = rows.withColumns({f"_{p}": similarity.ratios(F.col("a_" + c), F.col("b_" + c), names, guarded) for p, (c, names) in columns.items()})
    return scored.withColumns({f"{p}_{n}": F.col(f"_{p}.{n}") for p, (_, names) in columns.items() for n in names}).drop(*[f"_{p}" for p in columns])


def base_features(pairs: DataFrame, records: DataFrame | None, target_source: Column | None = None, unicode: bool = True) -> DataFrame:
    """pairs with the BASE columns. target_source: S2 or S3; by default the beginning of target_entity_id."""
    source = F.upper(target_source if target_source is not None else F.substring("target_entity_id", 1, 2))
    every = similarity.RATIOS
    rows = _with_ratios(paired(pairs, records, unicode), {"name": ("name", every), "address": ("address", every), "norm_name": ("norm_name", every), "norm_address": ("norm_address", every), "name_no_suffix": ("name_no_suffix", every[:2])}, guarded=False)
    native = {
        "name_exact": _equal("name"), "address_exact": _equal("address"), "norm_name_exact": _equal("norm_name"), "norm_address_exact": _equal("norm_address"), "name_no_suffix_exact": _equal("name_no_suffix"),
        **_sizes("name", "name", "name", 0.0), **_sizes("address", "address", "address", 0.0),
        "name_first_token_same": _equal("first_token"), "name_last_token_same": _equal("last_token"),
        "address_number_match": _equal("raw_number"), "same_country": _equal("country"),
        "source_is_s2": _flag(source == "S2"), "source_is_s3": _flag(source == "S3"),
        "address1_missing": _flag(F.col("a_address") == ""), "address2_missing": _flag(F.col("b_address") == ""),
        "name_script_same": _equal("name_script"), "address_script_same": _equal("address_script"),
    }
    return rows.withColumns(native).select(*_own(pairs, records), *BASE)


def alternative_features(pairs: DataFrame, records: DataFrame | None, target_source: Column | None = None, unicode: bool = True) -> DataFrame:
    """pairs with the ALTERNATIVE columns: empty equals empty, word counts and numbers of normalized text."""
    source = F.lower(target_source if target_source is not None else F.substring("target_entity_id", 1, 2))
    every = similarity.RATIOS
    rows = _with_ratios(paired(pairs, records, unicode), {"raw_name": ("name", every), "raw_address": ("address", every), "norm_name": ("norm_name", every), "norm_address": ("norm_address", every), "suffixless_name": ("suffixless_name", every[:2])}, guarded=True)
    folded = {c: _same(f"folded_{c}") for c in ("name", "address")}
    present = (F.col("a_address") != "") & (F.col("b_address") != "")
    native = {
        "raw_name_exact": folded["name"], "raw_address_exact": folded["address"], "norm_name_exact": _same("norm_name"), "norm_address_exact": _same("norm_address"), "suffixless_name_exact": _same("suffixless_name"),
        **_sizes("raw_name", "name", "norm_name", 1.0), **_sizes("raw_address", "address", "norm_address", 1.0),
        "first_token_agree": _same("first_token"), "last_token_agree": _same("last_token"), "address_number_match": _equal("norm_number"), "same_country": _same("country"),
        "source2": _flag(source.isin("source2", "s2")), "source3": _flag(source.isin("source3", "s3")),
        "address_missing_any": _flag(~present), "address_both_present": _flag(present),
        "name_script_same": _same("name_class"), "address_script_same": _same("address_class"),
    }
    return rows.withColumns(native).select(*_own(pairs, records), *ALTERNATIVE)


#: For measured_features, by profile: prefix, column, ratios, and the prefix whose ratios are taken where both columns are the same.
_EVERY = similarity.RATIOS
_RATIOS = {
    False: (("name", "name", _EVERY, None), ("address", "address", _EVERY, None), ("norm_name", "norm_name", _EVERY, "name"), ("norm_address", "norm_address", _EVERY, "address"), ("name_no_suffix", "name_no_suffix", _EVERY[:2], "norm_name")),
    True: (("raw_name", "name", _EVERY, None), ("raw_address", "address", _EVERY, None), ("norm_name", "norm_name", _EVERY, "raw_name"), ("norm_address", "norm_address", _EVERY, "raw_address"), ("suffixless_name", "suffixless_name", _EVERY[:2], "norm_name")),
}
#: Columns of two values: equal ones, and (second) equal ones that aren't empty.
_FLAGS = {
    False: ({}, {"name_exact": "name", "address_exact": "address", "norm_name_exact": "norm_name", "norm_address_exact": "norm_address", "name_no_suffix_exact": "name_no_suffix", "name_first_token_same": "first_token", "name_last_token_same": "last_token", "address_number_match": "raw_number", "same_country": "country", "name_script_same": "name_script", "address_script_same": "address_script"}),
    True: ({"raw_name_exact": "folded_name", "raw_address_exact": "folded_address", "norm_name_exact": "norm_name", "norm_address_exact": "norm_address", "suffixless_name_exact": "suffixless_name", "first_token_agree": "first_token", "last_token_agree": "last_token", "same_country": "country", "name_script_same": "name_class", "address_script_same": "address_class"}, {"address_number_match": "norm_number"}),
}


def measured_features(sides: DataFrame, alternative: bool = False, digits: int = 6) -> DataFrame:
    """base_features or alternative_features, rounded, of the pairs of prepared records with keys (unique entity_ids), source S2 or S3 by the id.

    All is reckoned for arrays of pairs where the records are; where normalizing changes neither text, its ratios are those of the texts as written.
    """
    names, (same, full) = (ALTERNATIVE if alternative else BASE), _FLAGS[alternative]
    sizes = [(p, c, ("norm_" if alternative else "") + c + "_words") for p, c in (("raw_name", "name"), ("raw_address", "address"))] if alternative else [(c, c, c + "_words") for c in ("name", "address")]
    counted = sides.withColumns({"origin": F.substring("entity_id", 1, 2), **{c: X.token_count(F.col(c.removesuffix("_words"))) for _, _, c in sizes}})
    carry = tuple(dict.fromkeys((*[c for _, c, _, _ in _RATIOS[alternative]], *same.values(), *full.values(), *[c for _, _, c in sizes], "origin")))

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: dict[str, np.ndarray] = {}
        column = {p: c for p, c, _, _ in _RATIOS[alternative]}
        for p, c, asked, other in _RATIOS[alternative]:
            at = slice(None)
            if other is not None:
                alike = rows.alike(c, column[other])
                at = np.flatnonzero(~(alike[i] & alike[j]))
            found = rows.measured(c, i[at], j[at], asked, guarded=alternative)
            for n in asked:
                out[f"{p}_{n}"] = found[n] if other is None else out[f"{other}_{n}"].copy()
                out[f"{p}_{n}"][at] = found[n]
        for n, c in same.items():
            out[n] = rows.codes(c)[i] == rows.codes(c)[j]
        for n, c in full.items():
            out[n] = (rows.codes(c)[i] == rows.codes(c)[j]) & rows.full(c)[i]
        for p, c, words in sizes:
            (a, b), (m, n) = ((rows.texts(c).size[rows.codes(c)[k]] for k in (i, j)), (rows.numbers(words)[k] for k in (i, j)))
            none, ratio = (a == 0) | (b == 0), np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)
            ratio = np.where(none, np.where((a == 0) & (b == 0), float(alternative), 0.0), ratio)
            out |= {f"{p}_length_diff": np.abs(a - b), f"{p}_length_ratio": ratio, f"{p}_token_count_diff": np.abs(m - n)}
        a, b = (rows.full("address")[k] for k in (i, j))
        source = rows.prefix("origin", 2)[j]
        if alternative:
            out |= {"source2": source == "S2", "source3": source == "S3", "address_missing_any": ~(a & b), "address_both_present": a & b}
        else:
            out |= {"source_is_s2": source == "S2", "source_is_s3": source == "S3", "address1_missing": ~a, "address2_missing": ~b}
        yield from rows.batches(i, j, {n: rounded(out[n], digits) if out[n].dtype == np.float64 else out[n] for n in names}, tuple(_PAIR))

    return blocking.measured_pairs(counted, carry, measure, ", ".join([f"{c} string" for c in _PAIR] + [f"{c} double" for c in names]), copies=True)


def measured_ratio(keyed: DataFrame, column: str, ratio: str, digits: int = 6) -> DataFrame:
    """(source1_entity_id, target_entity_id, ratio) of a column of both records, rounded, for the pairs of records with keys (unique entity_ids)."""

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = rows.measured(column, i, j, (ratio,))[ratio]
        yield from rows.batches(i, j, {ratio: rounded(found, digits)}, ("source1_entity_id", "target_entity_id"))

    return blocking.measured_pairs(keyed, (column,), measure, f"source1_entity_id string, target_entity_id string, {ratio} double", copies=True)


def counted_similarities(keyed: DataFrame, steps: tuple[float, ...]) -> DataFrame:
    """(name_sim, address_sim, n): how many pairs of records with keys (unique entity_ids) reach which steps.

    name_sim is the ratio of the names, address_sim the token_set_ratio of the addresses, each as the greatest step
    that it reaches, or 0. Records that are alike are one record here that counts so many times, so copies make no pairs.
    """
    own = ["side", "block_country", *blocking.BLOCKS, "business_name", "business_address"]
    kinds = keyed.withColumn("side", F.when(F.col("source") == 1, 1).otherwise(2)).groupBy(*own).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).withColumnRenamed("side", "source")
    levels = np.array([0.0, *steps])

    def reached(rows: Rows, c: str, ratio: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.searchsorted(levels[1:], rows.measured(c, i, j, (ratio,))[ratio], side="right")

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell = reached(rows, "business_name", "ratio", i, j) * len(levels) + reached(rows, "business_address", "token_set_ratio", i, j)
        n, sums = rows.numbers("n"), np.zeros(len(levels) ** 2, np.int64)
        np.add.at(sums, cell, n[i] * n[j])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(levels[some // len(levels)]), pa.array(levels[some % len(levels)]), pa.array(sums[some])], names=["name_sim", "address_sim", "n"])

    return blocking.measured_pairs(kinds, ("business_name", "business_address", "n"), measure, "name_sim double, address_sim double, n long").groupBy("name_sim", "address_sim").agg(F.sum("n").alias("n"))


_SIMILAR = ("business_name", "business_address", "text_key")


def _untrue(rows: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Those of the pairs with different texts, with name_sim and address_sim."""
    texts = rows.codes("text_key")
    at = np.flatnonzero(texts[i] != texts[j])
    i, j = i[at], j[at]
    return i, j, rows.measured("business_name", i, j, ("ratio",))["ratio"], rows.measured("business_address", i, j, ("token_set_ratio",))["token_set_ratio"]


def near_untrue(keyed: DataFrame, name: float, address: float) -> DataFrame:
    """(source1_entity_id, target_entity_id, name_sim, address_sim) of pairs of records with keys (unique entity_ids) and different text_key that reach one of the two."""

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, a, b = _untrue(rows, i, j)
        at = np.flatnonzero((a >= name) | (b >= address))
        yield from rows.batches(i[at], j[at], {"name_sim": a[at], "address_sim": b[at]}, ("source1_entity_id", "target_entity_id"))

    return blocking.measured_pairs(keyed, _SIMILAR, measure, "source1_entity_id string, target_entity_id string, name_sim double, address_sim double", copies=True)


def best_untrue(keyed: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(source1_entity_id, target_entity_id, score) of pairs of records with keys (unique entity_ids) and different text_key: 0.6 name_sim + 0.4 address_sim, rounded.

    Of the pairs of a record that a task sees together, those stay that no k others there exceed.
    """

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, a, b = _untrue(rows, i, j)
        if not len(i):
            return
        score, n = rounded(a * 0.6 + b * 0.4, digits), rows.copies()[2]
        order = np.lexsort((-score, i))
        own = i[order]
        upto = np.cumsum(n[j[order]])
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(begins[1:], len(own))
        # The pair by which k are reached, or the record's last.
        reached = np.minimum(np.searchsorted(upto, upto[begins] - n[j[order[begins]]] + k), ends - 1)
        cut = np.repeat(score[order[reached]], ends - begins)
        at = order[score[order] >= cut]
        yield from rows.batches(i[at], j[at], {"score": score[at]}, ("source1_entity_id", "target_entity_id"))

    return blocking.measured_pairs(keyed, _SIMILAR, measure, "source1_entity_id string, target_entity_id string, score double", copies=True)


def counted_zones(keyed: DataFrame, zones: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """(country, mean, n, zones...): how many pairs of records with keys (unique entity_ids) and different text_key have which 0.6 name_sim + 0.4 address_sim.

    country is that of the first record. Counts of pairs in the zones are in rows of their own, without mean.
    """

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, a, b = _untrue(rows, i, j)
        n, mean, country = rows.copies()[2], a * 0.6 + b * 0.4, rows.codes("country")[i]
        weight = n[i] * n[j]
        inside = [z(a, b) for z in zones.values()]
        for c in np.unique(country):
            at = np.flatnonzero(country == c)
            values, own = np.unique(mean[at], return_inverse=True)
            counts = np.bincount(own, weight[at]).astype(np.int64)
            sums = [int(weight[at][z[at]].sum()) for z in inside]
            one = rows.table["country"].combine_chunks().slice(int(i[at[0]]), 1)
            yield pa.RecordBatch.from_arrays(
                [one.take(pa.array(np.zeros(len(values) + 1, np.int64))), pa.concat_arrays([pa.array(values), pa.nulls(1, pa.float64())]), pa.array(np.append(counts, 0)), *[pa.array(np.append(np.zeros(len(values), np.int64), s)) for s in sums]],
                names=["country", "mean", "n", *zones],
            )

    schema = ", ".join(["country string", "mean double", "n long", *[f"{z} long" for z in zones]])
    return blocking.measured_pairs(keyed, (*_SIMILAR, "country"), measure, schema, copies=True, together=1 << 20)


def suffixes_and_numbers(records: DataFrame) -> DataFrame:
    """records with what extra_features needs of one side: suffix, number."""
    return records.withColumns({"suffix": X.legal_suffix(X.normalized(F.col("business_name"))), "number": A.first_number(F.col("business_address"))})


def measured_extra_features(keyed: DataFrame, digits: int = 6) -> DataFrame:
    """norm_name_ratio and norm_address_ratio of business_name and business_address, and the EXTRA columns, rounded, of the pairs of records with keys (unique entity_ids)."""
    names = ("norm_name_ratio", "norm_address_ratio", *EXTRA)

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        name, address = (rows.measured(c, i, j, ("ratio",))["ratio"] for c in ("business_name", "business_address"))
        (both, same), (numbers, equal) = ((rows.full(c)[i] & rows.full(c)[j], rows.codes(c)[i] == rows.codes(c)[j]) for c in ("suffix", "number"))
        out = {
            "norm_name_ratio": name, "norm_address_ratio": address,
            "name_address_mean": (name + address) / 2, "name_address_min": np.minimum(name, address), "name_address_max": np.maximum(name, address), "name_address_gap": name - address,
            "name_dominance": np.maximum(name - address, 0.0), "address_dominance": np.maximum(address - name, 0.0),
            "suffix_both_present": both, "suffix_same": both & same, "suffix_conflict": both & ~same, "address_number_conflict": numbers & ~equal,
        }
        yield from rows.batches(i, j, {n: rounded(out[n], digits) if out[n].dtype == np.float64 else out[n] for n in names}, tuple(_PAIR))

    schema = ", ".join([f"{c} string" for c in _PAIR] + [f"{c} double" for c in names])
    return blocking.measured_pairs(suffixes_and_numbers(keyed), ("business_name", "business_address", "suffix", "number"), measure, schema, copies=True)


def extra_features(features: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """features (with norm_name_ratio and norm_address_ratio) with the EXTRA columns; without records they have a_suffix, b_suffix and so on."""
    name, address = F.col("norm_name_ratio"), F.col("norm_address_ratio")
    rows = features
    if records is not None:
        norm = suffixes_and_numbers(records).select("entity_id", "suffix", "number")
        a = norm.select("entity_id", F.col("suffix").alias("a_suffix"), F.col("number").alias("a_number"))
        b = norm.select(F.col("entity_id").alias("target_entity_id"), F.col("suffix").alias("b_suffix"), F.col("number").alias("b_number"))
        rows = features.join(a, "entity_id").join(b, "target_entity_id")
    both = (F.col("a_suffix") != "") & (F.col("b_suffix") != "")
    extra = {
        "name_address_mean": (name + address) / 2, "name_address_min": F.least(name, address), "name_address_max": F.greatest(name, address), "name_address_gap": name - address,
        "name_dominance": F.greatest(name - address, F.lit(0.0)), "address_dominance": F.greatest(address - name, F.lit(0.0)),
        "suffix_both_present": _flag(both), "suffix_same": _flag(both & (F.col("a_suffix") == F.col("b_suffix"))), "suffix_conflict": _flag(both & (F.col("a_suffix") != F.col("b_suffix"))),
        "address_number_conflict": _flag((F.col("a_number") != "") & (F.col("b_number") != "") & (F.col("a_number") != F.col("b_number"))),
    }
    return rows.withColumns(extra).select(*_own(features, records), *EXTRA)


def address_parts(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records with what address_features needs of one side, and the columns of ``keep``."""
    sets = {"num": A.numbers, "compound": A.compound_numbers, "alnum": A.parts, "postal": A.postal_codes}
    return records.select("entity_id", *[f(F.col("business_address")).alias(k) for k, f in sets.items()], A.first_plain_number(F.col("business_address")).alias("first"), *keep)


def address_features(pairs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """pairs with ten features of the parts of both addresses; without records they have those of both sides as a_... and b_..."""
    rows = pairs
    if records is not None:
        made = address_parts(records)
        a = made.select("entity_id", *[F.col(c).alias("a_" + c) for c in made.columns[1:]])
        b = made.select(F.col("entity_id").alias("target_entity_id"), *[F.col(c).alias("b_" + c) for c in made.columns[1:]])
        rows = pairs.join(a, "entity_id").join(b, "target_entity_id")

    def two(k: str) -> tuple[Column, Column]:
        return F.col("a_" + k), F.col("b_" + k)

    return rows.select(
        *[rows[c] for c in _own(pairs, records)],
        similarity.jaccard(*two("num")).alias("address_num_jaccard"),
        similarity.overlap(*two("num")).alias("address_num_overlap_min"),
        similarity.same_set(*two("num")).alias("address_num_exact_set"),
        F.abs(F.size("a_num") - F.size("b_num")).cast("double").alias("address_num_count_diff"),
        _flag(F.arrays_overlap(*two("compound"))).alias("address_compound_num_exact"),
        similarity.jaccard(*two("compound")).alias("address_compound_num_jaccard"),
        similarity.jaccard(*two("alnum")).alias("address_alnum_token_jaccard"),
        similarity.overlap(*two("alnum")).alias("address_alnum_token_overlap_min"),
        _equal("first").alias("address_first_num_exact_normalized"),
        _flag(F.arrays_overlap(*two("postal"))).alias("address_postal_overlap"),
    )


@cache
def _shares(digits: int) -> np.ndarray:
    """Rounded n / d of whole numbers below 128, at 128 * n + d."""
    return rounded(np.repeat(np.arange(128.0), 128) / np.tile(np.maximum(np.arange(128.0), 1), 128), digits)


def _share(n: np.ndarray, d: np.ndarray, digits: int) -> np.ndarray:
    return _shares(digits)[n * 128 + d] if d.max(initial=0) < 128 else rounded(n / np.maximum(d, 1), digits)


def _sets(rows: Rows, c: str, i: np.ndarray, j: np.ndarray, digits: int) -> dict[str, np.ndarray]:
    """jaccard, overlap and same_set of similarity for two arrays, and whether they share an element."""
    n, both = rows.sets(c)[1], rows.common(c, i, j)
    a, b = n[i], n[j]
    return {"jaccard": np.where(a + b == 0, 1.0, _share(both, a + b - both, digits)), "overlap": _share(both, np.minimum(a, b), digits), "same": (a > 0) & (a == b) & (both == a), "met": both > 0}


def measured_address_features(keyed: DataFrame, digits: int = 6) -> DataFrame:
    """address_features, rounded, of the pairs of records with keys (unique entity_ids), reckoned where the records are."""
    made = address_parts(keyed, keep=("source", "block_country", *blocking.BLOCKS))

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        num, compound, alnum, postal = (_sets(rows, c, i, j, digits) for c in ("num", "compound", "alnum", "postal"))
        size, first = rows.sets("num")[1], rows.codes("first")
        out = {
            "address_num_jaccard": num["jaccard"], "address_num_overlap_min": num["overlap"], "address_num_exact_set": num["same"], "address_num_count_diff": np.abs(size[i] - size[j]),
            "address_compound_num_exact": compound["met"], "address_compound_num_jaccard": compound["jaccard"],
            "address_alnum_token_jaccard": alnum["jaccard"], "address_alnum_token_overlap_min": alnum["overlap"],
            "address_first_num_exact_normalized": (first[i] == first[j]) & rows.full("first")[i], "address_postal_overlap": postal["met"],
        }
        yield from rows.batches(i, j, out, ("entity_id", "target_entity_id"))

    return blocking.measured_pairs(made, ("num", "compound", "alnum", "postal", "first"), measure, ", ".join([f"{c} string" for c in _PAIR] + [f"{c} double" for c in ADDRESS]), copies=True)


def measured_sets(keyed: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """(source1_entity_id, target_entity_id, jaccard, overlap, same) of a column of arrays without repeats, rounded, for the pairs of records with keys (unique entity_ids)."""

    def measure(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = _sets(rows, column, i, j, digits)
        yield from rows.batches(i, j, {n: found[n] for n in ("jaccard", "overlap", "same")}, ("source1_entity_id", "target_entity_id"))

    return blocking.measured_pairs(keyed, (column,), measure, "source1_entity_id string, target_entity_id string, jaccard double, overlap double, same double", copies=True)


def blocking_features(pairs: DataFrame, records: DataFrame, empty_matches: bool = False) -> DataFrame:
    """pairs with counts and flags of shared keys; empty_matches: two empty values in one country count as shared."""
    keyed = blocking.with_keys(records).select("entity_id", "block_country", *blocking.BLOCKS)
    a = keyed.select("entity_id", *[F.col(c).alias("a_" + c) for c in keyed.columns[1:]])
    b = keyed.select(F.col("entity_id").alias("target_entity_id"), *[F.col(c).alias("b_" + c) for c in keyed.columns[1:]])
    rows = pairs.join(a, "entity_id").join(b, "target_entity_id")
    same = F.col("a_block_country") == F.col("b_block_country")
    shared = {k: (same & (F.col("a_" + k) == F.col("b_" + k)) & (F.lit(empty_matches) | (F.col("a_" + k) != ""))).cast("int") for k in blocking.BLOCKS}
    name, address = shared["name_first"] + shared["name_prefix2"], shared["address_number"] + shared["address_first"]
    return rows.select(*[rows[c] for c in pairs.columns], (name + address).alias("v4_shared_key_count"), name.alias("v4_shared_name_key_count"), address.alias("v4_shared_address_key_count"), *[v.alias(f"v4_{k}_match") for k, v in shared.items()])


def ngram_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with the cosines of character 3-, 4- and 5-grams of the names, as written and transliterated."""
    made = records.select("entity_id", F.coalesce("business_name", F.lit("")).alias("name"), scripts.transliterated(F.col("business_name")).alias("latin"))
    a = made.select("entity_id", F.col("name").alias("a_name"), F.col("latin").alias("a_latin"))
    b = made.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("b_name"), F.col("latin").alias("b_latin"))
    rows = pairs.join(a, "entity_id").join(b, "target_entity_id")
    return rows.select(*[rows[c] for c in pairs.columns], *[similarity.char_ngram_cosine(F.col("a_" + c), F.col("b_" + c), n).alias(f"{c}_char_{n}gram_cosine") for c in ("name", "latin") for n in (3, 4, 5)])


def joined_features(*tables: DataFrame) -> DataFrame:
    """Feature tables side by side, by the ids of the pair; each must hold each pair once."""
    out = tables[0]
    for t in tables[1:]:
        out = one_to_one(out, t.drop(*[c for c in t.columns if c in out.columns and c not in _PAIR]), _PAIR)
    return out
