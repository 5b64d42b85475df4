"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from affinia.functions import address, scripts, text
from affinia.queries import NAMES


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _titles(x: str) -> str:
    return f"regexp_replace({x}, '^(?:(?:{'|'.join(text.TITLES)})(?: |$)|m s(?: |$))+', '')"


def _no_suffix(x: str) -> str:
    for s in text.LEGAL_SUFFIXES:
        x = rf"regexp_replace({x}, '\s+{s}$', '')"
    return x


_SUFFIX = "|".join(text.LEGAL_SUFFIXES)
_ORDINAL = r"[0-9]+(?:st|nd|rd|th)"
_BEGINS = rf"^(?:(?:(?:{'|'.join(address.LABELS)})(?: no(?: \S+)?)?|h(?: no)?(?: \S+)?|no(?: \S+)?|(?:{'|'.join(address.FLOORS)}|{_ORDINAL}) floor)(?: |$))+"


def _misread(x: str) -> str:
    return rf"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE WHEN regexp_matches(t, '\p{{L}}') AND NOT regexp_matches(t, '^\p{{Nd}}+(?:st|nd|rd|th)$') THEN translate(t, '01568', 'olsgb') ELSE t END), ' ')"


def _number(x: str) -> str:
    """Without leading zeros."""
    return f"CASE WHEN {x} = '' THEN '' WHEN ltrim({x}, '0') = '' OR NOT regexp_matches(ltrim({x}, '0'), '^[0-9]') THEN '0' || ltrim({x}, '0') ELSE ltrim({x}, '0') END"


def _house(x: str) -> str:
    return f"lower({_number(rf'''regexp_extract({x}, '\p{{Nd}}+[A-Za-z]?')''')})"


def _kept(a: str, drop: str) -> str:
    """Words of a without floors and numbers and what drop (of t) says."""
    words = f"string_split({a}, ' ')"
    storey = f"(list_contains({_list(address.FLOORS)}, %s) OR regexp_matches(%s, '^{_ORDINAL}$'))"
    before, after = f"coalesce({words}[i - 1], '')", f"coalesce({words}[i + 1], '')"
    return rf"list_filter({words}, lambda t, i: t <> '' AND NOT ({storey % ('t', 't')} AND {after} = 'floor') AND NOT (t = 'floor' AND i > 1 AND {storey % (before, before)}) AND NOT regexp_matches(regexp_replace(t, '[^0-9A-Za-z]', '', 'g'), '^[0-9]+[A-Za-z]?$') AND NOT ({drop}))"


def _alphabetic(a: str) -> str:
    drop = rf"NOT regexp_matches(t, '\p{{L}}') OR list_contains({_list((*address.LABELS, 'h', 'no'))}, t)"
    return f"coalesce(({_kept(a, drop)})[1], '')"


def _anchor(a: str) -> str:
    kept = _kept(a, f"list_contains({_list((*address.GENERIC, *address.LABELS))}, t)")
    cleaned = f"list_filter(list_transform({kept}, lambda t: regexp_replace(t, '[^A-Za-z]', '', 'g')), lambda t: length(t) >= 4 AND NOT list_contains({_list(address.GENERIC)}, t))"
    return f"coalesce(list_reduce({cleaned}, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END, ''), '')"


ENT = f"""ent AS (SELECT 'S' || source || '-' || doc_id AS entity_id, source, array_to_string(w[1:4], ' ') AS business_name, array_to_string(w[5:14], ' ') AS business_address, country, md5(t) AS text_key
  FROM (SELECT doc_id, lang AS country, t, string_split(t, ' ') AS w, CASE WHEN n < 7 THEN 1 WHEN n < 14 THEN 2 ELSE 3 END AS source
    FROM (SELECT doc_id, lang, {norm('text')} AS t, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)))"""
TRUTH = """truth AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS target_entity_id FROM ent a JOIN ent b ON a.text_key = b.text_key AND a.source = 1 AND b.source > 1)"""

_NAME = {"v1": "n", "v2": _titles("n"), "v3": _misread(_titles("n"))}
_FIRST = {"v1": "split_part(a, ' ', 1)", "v2": f"split_part(regexp_replace(a, '{_BEGINS}', ''), ' ', 1)", "v3": _alphabetic("a"), "v4": _anchor("a")}
_NUMBER = {"v1": r"regexp_extract(a, '\p{Nd}+')", "v2": _house("a")}
VERSIONS = {"BASELINE": ("v1", "v1", "v1"), "NAME_V2": ("v2", "v1", "v1"), "ADDRESS_NUMBER_V2": ("v1", "v2", "v1"), "ADDRESS_FIRST_V2": ("v1", "v1", "v2"), "ALL_V2": ("v2", "v2", "v2"), "NAME_V3": ("v3", "v2", "v2"), "ALL_V3": ("v2", "v2", "v3"), "ALL_V4": ("v2", "v2", "v4")}


def keys(variant: str, name: str = "keys") -> str:
    n, k, f = VERSIONS[variant]
    return f"""{name} AS (SELECT entity_id, source, country, split_part(m, ' ', 1) AS name_first, substr(replace(m, ' ', ''), 1, 2) AS name_prefix2, address_number, address_first
  FROM (SELECT entity_id, source, lower(trim(country)) AS country, {_NAME[n]} AS m, {_NUMBER[k]} AS address_number, {_FIRST[f]} AS address_first
    FROM (SELECT entity_id, source, country, {norm('business_name')} AS n, {norm('business_address')} AS a FROM ent)))"""


def candidates(variant: str, name: str = "cand", keyed: str = "keys") -> str:
    """CTEs for keys, exploded keys and pairs with their blocks."""
    long = " UNION ALL ".join(f"SELECT entity_id, source, country, '{b}' AS block, {b} AS value FROM {keyed}" for b in ("name_first", "name_prefix2", "address_number", "address_first"))
    return f"""{keys(variant, keyed)}, {keyed}_long AS (SELECT * FROM ({long}) WHERE value <> ''),
{name} AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS target_entity_id, list_sort(list(DISTINCT a.block)) AS blocks, count(DISTINCT a.block) AS n_blocks
  FROM {keyed}_long a JOIN {keyed}_long b ON a.block = b.block AND a.country = b.country AND a.value = b.value AND a.source = 1 AND b.source > 1 GROUP BY 1, 2)"""


AND_JOIN = """both_first AS (SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id AS target_entity_id FROM keys a JOIN keys b ON a.country = b.country AND a.name_first = b.name_first AND a.address_first = b.address_first AND a.source = 1 AND b.source > 1 WHERE a.name_first <> '' AND a.address_first <> '')"""
STRATEGIES = {"I1": ("name_first", "address_number"), "I2": ("name_prefix2", "address_number"), "I3": ("name_prefix2", "address_first"), "I4": ("name_first", "address_first")}
HITS = "hits AS (SELECT source1_entity_id, target_entity_id, strategies FROM (SELECT *, list_filter([" + ", ".join("CASE WHEN " + " AND ".join(f"list_contains(blocks, '{k}')" for k in v) + f" THEN '{s}' END" for s, v in STRATEGIES.items()) + "], lambda s: s IS NOT NULL) AS strategies FROM cand) WHERE len(strategies) > 0)"
SCORED = "scored AS (SELECT source1_entity_id, target_entity_id, n_blocks, (n_blocks + CAST('0x' || substr(md5(source1_entity_id || '|' || target_entity_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) / 5.0::DOUBLE AS score FROM cand)"
_F05 = "CASE WHEN true_count = 0 AND predicted_count = 0 THEN 1.0 WHEN tp = 0 OR true_count = 0 OR predicted_count = 0 THEN 0.0 ELSE 1.25 * (tp / predicted_count) * (tp / true_count) / (0.25 * (tp / predicted_count) + tp / true_count) END"


def counts(predicted: str) -> str:
    """CTE of counts by entity, with ``predicted`` as the selected pairs."""
    return f"""sel AS ({predicted}), per AS (SELECT e.entity_id AS source1_entity_id, coalesce(t.n, 0) AS true_count, coalesce(p.n, 0) AS predicted_count, coalesce(p.tp, 0) AS tp
  FROM (SELECT entity_id FROM ent WHERE source = 1) e
  LEFT JOIN (SELECT source1_entity_id, count(*) AS n FROM truth GROUP BY 1) t ON t.source1_entity_id = e.entity_id
  LEFT JOIN (SELECT s.source1_entity_id, count(*) AS n, count(t.target_entity_id) AS tp FROM sel s LEFT JOIN truth t USING (source1_entity_id, target_entity_id) GROUP BY 1) p ON p.source1_entity_id = e.entity_id)"""


CLOSE = "close AS (SELECT source1_entity_id, target_entity_id, a.business_name AS x, b.business_name AS y, a.business_address AS xa, b.business_address AS ya FROM cand JOIN ent a ON a.entity_id = source1_entity_id JOIN ent b ON b.entity_id = target_entity_id)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row."""
    return f"""(list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [CAST(unicode(substr({a}, i, 1)) AS BIGINT)]), lambda old, c:
      list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda new, j: list_append(new, CASE WHEN unicode(substr({b}, j[1], 1)) = c[1] THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], new[j[1]]) END), [0::BIGINT]),
      list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))[-1]"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * coalesce({lcs(a, b)}, 0) / (length({a}) + length({b})) END"


def partial_ratio(a: str, b: str) -> str:
    """The best ratio of the shorter with a stretch of the longer text."""

    def best(s: str, t: str) -> str:
        stretch = f"substr({t}, greatest(st, 0) + 1, length({s}) + least(st, 0))"
        return f"list_max(list_transform(range(1 - length({s}), length({t})), lambda st: {ratio(s, stretch)}))"

    return f"""CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 100.0
      WHEN length({a}) = length({b}) THEN greatest({best(a, b)}, {best(b, a)}) WHEN length({a}) < length({b}) THEN {best(a, b)} ELSE {best(b, a)} END"""


def measured(name: str, rows: str, x: str, y: str, guarded: bool = False) -> str:
    """CTEs: the four ratios of the distinct pairs of texts x and y of rows, as columns of the table ``name``."""
    n, words = name, "list_filter(string_split({}, ' '), lambda t: t <> '')"
    rest = "array_to_string(list_sort(list_filter({}, lambda t: NOT list_contains({}, t))), ' ')"
    far = "greatest(length(x), length(y)) / least(length(x), length(y))"
    weight = "CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END"
    parts = f"CASE WHEN s > 0 THEN 100.0 WHEN len(p) < len(tx) OR len(q) < len(ty) THEN greatest({partial_ratio('sx', 'sy')}, {partial_ratio('dx', 'dy')}) ELSE {partial_ratio('sx', 'sy')} END"
    guard = "WHEN x = '' AND y = '' THEN 100.0 WHEN x = '' OR y = '' THEN 0.0" if guarded else "WHEN false THEN 0.0"
    return f"""{n}_p AS (SELECT DISTINCT {x} AS x, {y} AS y FROM {rows}),
  {n}_s AS (SELECT x, y, {words.format('x')} AS tx, {words.format('y')} AS ty FROM {n}_p),
  {n}_t AS (SELECT *, list_distinct(tx) AS p, list_distinct(ty) AS q, array_to_string(list_sort(tx), ' ') AS sx, array_to_string(list_sort(ty), ' ') AS sy FROM {n}_s),
  {n}_u AS (SELECT *, array_to_string(list_sort(p), ' ') AS dx, array_to_string(list_sort(q), ' ') AS dy, length(array_to_string(list_intersect(p, q), ' ')) AS s, {rest.format('p', 'q')} AS u, {rest.format('q', 'p')} AS v FROM {n}_t),
  {n}_w AS (SELECT *, s + CAST(s > 0 AS INT) + length(u) AS m, s + CAST(s > 0 AS INT) + length(v) AS n, coalesce({lcs('u', 'v')}, 0) AS c, {ratio('x', 'y')} AS r, {ratio('sx', 'sy')} AS ts, CASE WHEN x = '' OR y = '' THEN 0 ELSE {far} END AS far FROM {n}_u),
  {n}_v AS (SELECT *, CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 WHEN s > 0 AND (u = '' OR v = '') THEN 100.0
    ELSE greatest(100.0 - 100.0 * (length(u) + length(v) - 2 * c) / (m + n), CASE WHEN s > 0 THEN greatest(100.0 - 100.0 * (m - s) / (s + m), 100.0 - 100.0 * (n - s) / (s + n)) ELSE 0.0 END) END AS tset FROM {n}_w),
  {n} AS MATERIALIZED (SELECT x, y, CASE {guard} ELSE r END AS ratio, CASE {guard} ELSE ts END AS token_sort_ratio, CASE {guard} ELSE tset END AS token_set_ratio,
    CASE {guard} WHEN x = '' OR y = '' THEN 0.0 WHEN far < 1.5 THEN greatest(r, 0.95 * greatest(ts, tset)) ELSE greatest(r, {weight} * {partial_ratio('x', 'y')}, 0.95 * {weight} * ({parts})) END AS wratio FROM {n}_v)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _names() -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") v(name)"


SIMILAR = "sim AS (SELECT source1_entity_id, target_entity_id, nm.ratio AS name_sim, am.token_set_ratio AS address_sim FROM close JOIN nm ON nm.x = close.x AND nm.y = close.y JOIN am ON am.x = xa AND am.y = ya)"
UNTRUE = "untrue AS (SELECT s.* FROM sim s WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = s.source1_entity_id AND t.target_entity_id = s.target_entity_id))"


def _similar_oracles() -> dict[str, str]:
    """Queries over the similarities of names and addresses."""
    out = {}
    judged = (ENT, TRUTH, candidates("ALL_V2"), CLOSE, measured("nm", "close", "x", "y"), measured("am", "close", "xa", "ya"), SIMILAR, UNTRUE)
    out["wratio_pairs"] = _with(ENT, candidates("ALL_V2"), CLOSE, measured("nm", "close", "x", "y")) + "SELECT source1_entity_id, target_entity_id, round(wratio, 6) AS wratio FROM close JOIN nm ON nm.x = close.x AND nm.y = close.y"
    out["similarity_categories"] = _with(*judged) + """SELECT CASE WHEN name_sim >= 85 AND address_sim >= 80 THEN 'high_name_high_address' WHEN name_sim >= 85 AND address_sim < 80 THEN 'high_name_low_address' WHEN name_sim < 60 AND address_sim >= 80 THEN 'low_name_high_address'
  WHEN name_sim < 60 AND address_sim < 60 THEN 'low_name_low_address' ELSE 'mixed_similarity' END AS category, count(*) AS n, count(*) FILTER (WHERE name_sim >= 85 OR address_sim >= 90) AS sure FROM sim GROUP BY 1"""
    zones = {"name_80_address_80": "name_sim >= 80 AND address_sim >= 80", "name_90_address_below_60": "name_sim >= 90 AND address_sim < 60", "name_below_60_address_80": "name_sim < 60 AND address_sim >= 80", "name_below_40_address_70": "name_sim < 40 AND address_sim >= 70", "name_80_address_below_40": "name_sim >= 80 AND address_sim < 40"}
    mean = "name_sim * 0.6 + address_sim * 0.4"
    out["hard_negative_zones"] = _with(*judged) + f"SELECT country, count(*) AS n, round(avg({mean}), 2) AS mean, round(median({mean}), 2) AS median, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {z}" for z, c in zones.items()) + " FROM untrue JOIN ent ON entity_id = source1_entity_id GROUP BY 1"
    kinds = {"similar_name": "name_sim >= 90", "similar_address": "address_sim >= 80", "name_address": "name_sim >= 90 AND address_sim >= 80", "same_name_diff_address": "name_sim >= 95 AND address_sim < 70", "same_address_diff_name": "address_sim >= 90 AND name_sim < 70"}
    more = kinds | {"name_strong_address_weak": "name_sim >= 90 AND address_sim < 50", "address_strong_name_weak": "address_sim >= 90 AND name_sim < 50"}
    for name, kind in (("targeted_negatives", more), ("targeted_negatives_v2", kinds)):
        each = " UNION ALL ".join(f"SELECT source1_entity_id, target_entity_id, '{k}' AS category, {i} AS place FROM untrue WHERE {c}" for i, (k, c) in enumerate(kind.items()))
        drawn = "row_number() OVER (PARTITION BY category ORDER BY md5('42|' || source1_entity_id || '|' || target_entity_id), source1_entity_id, target_entity_id)"
        out[name] = _with(*judged, f"k AS ({each})", f"d AS (SELECT *, {drawn} AS r FROM k)") + "SELECT source1_entity_id, target_entity_id, arg_min(category, place) AS category FROM d WHERE r <= 50 GROUP BY 1, 2"
    score = f"round({mean}, 6)"
    out["discovery_scores"] = _with(*judged) + f"SELECT source1_entity_id, target_entity_id, score FROM (SELECT *, {score} AS score, row_number() OVER (PARTITION BY source1_entity_id ORDER BY {score} DESC, target_entity_id) AS r FROM untrue) WHERE r <= 3"
    return out


def _script(x: str) -> str:
    has = {"l": rf"regexp_matches({x}, '\p{{Latin}}')", "d": rf"regexp_matches({x}, '\p{{Devanagari}}')", "o": rf"regexp_matches(regexp_replace(regexp_replace({x}, '[^\p{{L}}]', '', 'g'), '[\p{{Latin}}\p{{Devanagari}}]', '', 'g'), '\p{{L}}')"}
    number = " + ".join(f"CAST({v} AS INT)" for v in has.values())
    return f"CASE WHEN {number} = 0 THEN 'empty' WHEN {number} > 1 THEN 'mixed' WHEN {has['l']} THEN 'latin' WHEN {has['d']} THEN 'devanagari' ELSE 'other' END"


_RATIOS = ("ratio", "wratio", "token_sort_ratio", "token_set_ratio")


def _all_measured(sides: str, both: str, tables: dict[str, str], guarded: bool = False) -> tuple[str, str]:
    """CTEs that measure all text pairs of the columns at once, each distinct pair one time, and the joins to them."""
    every = "texts AS (" + " UNION ".join(f"SELECT a_{c} AS x, b_{c} AS y FROM both_sides" for c in tables.values()) + ")"
    joins = " ".join(f"JOIN every m_{p} ON m_{p}.x = a_{c} AND m_{p}.y = b_{c}" for p, c in tables.items())
    return ",\n".join([sides, both, every, measured("every", "texts", "x", "y", guarded)]), joins


def _base(rounded: bool = True) -> tuple[str, str]:
    """CTEs and columns of the 39 features, for pairs (s1, t) of the table ``ids``."""
    ratios = "round({}, 6)" if rounded else "{}"
    sides = f"""sides AS (SELECT entity_id, name, address, country, n, a, {_no_suffix('n')} AS k, split_part(n, ' ', 1) AS f, split_part(n, ' ', -1) AS l, regexp_extract(address, '\\p{{Nd}}+') AS num, {_script('n')} AS ns, {_script('a')} AS as_
  FROM (SELECT entity_id, business_name AS name, business_address AS address, lower(country) AS country, {norm('business_name')} AS n, {norm('business_address')} AS a FROM ent))"""
    both = "both_sides AS (SELECT i.source1_entity_id AS entity_id, i.target_entity_id, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("name", "address", "country", "n", "a", "k", "f", "l", "num", "ns", "as_")) + " FROM ids i JOIN sides a ON a.entity_id = i.source1_entity_id JOIN sides b ON b.entity_id = i.target_entity_id)"
    tables = {"name": "name", "address": "address", "norm_name": "n", "norm_address": "a", "name_no_suffix": "k"}
    ctes, joins = _all_measured(sides, both, tables)
    columns = [f"{ratios.format(f'm_{p}.{r}')} AS {p}_{r}" for p in tables for r in (_RATIOS if p != "name_no_suffix" else _RATIOS[:2])]
    same = {"name_exact": "name", "address_exact": "address", "norm_name_exact": "n", "norm_address_exact": "a", "name_no_suffix_exact": "k", "name_first_token_same": "f", "name_last_token_same": "l", "address_number_match": "num", "same_country": "country", "name_script_same": "ns", "address_script_same": "as_"}
    columns += [f"CAST(a_{c} <> '' AND a_{c} = b_{c} AS DOUBLE) AS {k}" for k, c in same.items()]
    count = "len(list_filter(string_split({}, ' '), lambda t: t <> ''))"
    for p in ("name", "address"):
        x, y = f"a_{p}", f"b_{p}"
        columns += [f"CAST(abs(length({x}) - length({y})) AS DOUBLE) AS {p}_length_diff", f"round(CASE WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE least(length({x}), length({y})) / greatest(length({x}), length({y})) END, 6) AS {p}_length_ratio", f"CAST(abs({count.format(x)} - {count.format(y)}) AS DOUBLE) AS {p}_token_count_diff"]
    columns += ["CAST(substr(target_entity_id, 1, 2) = 'S2' AS DOUBLE) AS source_is_s2", "CAST(substr(target_entity_id, 1, 2) = 'S3' AS DOUBLE) AS source_is_s3", "CAST(a_address = '' AS DOUBLE) AS address1_missing", "CAST(b_address = '' AS DOUBLE) AS address2_missing"]
    return ctes, f"SELECT entity_id, target_entity_id, {', '.join(columns)} FROM both_sides {joins}"


def _dominant(x: str) -> str:
    """The script with the most letters, the first to occur among equals."""
    names = [*scripts.DOMINANT, "other"]
    inside = {n: f"\\p{{{n}}}" for n in scripts.DOMINANT}
    kept = {n: f"[^{c}]" for n, c in inside.items()} | {"other": f"[{''.join(inside.values())}]"}
    letters = f"regexp_replace({x}, '[^\\p{{L}}]', '', 'g')"
    before = {n: f"length(regexp_extract({letters}, '^[^{c}]*'))" for n, c in inside.items()} | {"other": f"length(regexp_extract({letters}, '^[{''.join(inside.values())}]*'))"}
    each = ", ".join(f"{{'c': length(regexp_replace({letters}, '{kept[n]}', '', 'g')), 'p': -{before[n]}, 'n': '{n.lower()}'}}" for n in names)
    return f"CASE WHEN length({letters}) = 0 THEN 'none' ELSE (list_sort([{each}])[-1]).n END"


def _alternative() -> str:
    """The 39 features of the other profile."""
    words = _list(text.LEGAL_WORDS)
    sides = f"""sides AS (SELECT entity_id, name, address, country, n, a, CASE WHEN list_contains({words}, split_part(n, ' ', -1)) THEN array_to_string(string_split(n, ' ')[:-2], ' ') ELSE n END AS k, split_part(n, ' ', 1) AS f, split_part(n, ' ', -1) AS l, regexp_extract(a, '\\p{{Nd}}+') AS num, {_dominant('name')} AS ns, {_dominant('address')} AS as_
  FROM (SELECT entity_id, business_name AS name, business_address AS address, lower(country) AS country, {norm('business_name')} AS n, {norm('business_address')} AS a FROM ent))"""
    both = "both_sides AS (SELECT i.source1_entity_id AS entity_id, i.target_entity_id, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("name", "address", "country", "n", "a", "k", "f", "l", "num", "ns", "as_")) + " FROM cand i JOIN sides a ON a.entity_id = i.source1_entity_id JOIN sides b ON b.entity_id = i.target_entity_id)"
    tables = {"raw_name": "name", "raw_address": "address", "norm_name": "n", "norm_address": "a", "suffixless_name": "k"}
    ctes, joins = _all_measured(sides, both, tables, guarded=True)
    columns = [f"round(m_{p}.{r}, 6) AS {p}_{r}" for p in tables for r in (_RATIOS if p != "suffixless_name" else _RATIOS[:2])]
    same = {"raw_name_exact": "name", "raw_address_exact": "address", "norm_name_exact": "n", "norm_address_exact": "a", "suffixless_name_exact": "k", "first_token_agree": "f", "last_token_agree": "l", "same_country": "country", "name_script_same": "ns", "address_script_same": "as_"}
    columns += [f"CAST(a_{c} = b_{c} AS DOUBLE) AS {k}" for k, c in same.items()] + ["CAST(a_num <> '' AND a_num = b_num AS DOUBLE) AS address_number_match"]
    count = "len(list_filter(string_split({}, ' '), lambda t: t <> ''))"
    for p, n in (("name", "n"), ("address", "a")):
        x, y = f"a_{p}", f"b_{p}"
        columns += [f"CAST(abs(length({x}) - length({y})) AS DOUBLE) AS raw_{p}_length_diff", f"round(CASE WHEN {x} = '' AND {y} = '' THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE least(length({x}), length({y})) / greatest(length({x}), length({y})) END, 6) AS raw_{p}_length_ratio", f"CAST(abs({count.format(f'a_{n}')} - {count.format(f'b_{n}')}) AS DOUBLE) AS raw_{p}_token_count_diff"]
    present = "a_address <> '' AND b_address <> ''"
    columns += ["CAST(substr(target_entity_id, 1, 2) = 'S2' AS DOUBLE) AS source2", "CAST(substr(target_entity_id, 1, 2) = 'S3' AS DOUBLE) AS source3", f"CAST(NOT ({present}) AS DOUBLE) AS address_missing_any", f"CAST({present} AS DOUBLE) AS address_both_present"]
    return _with(ENT, candidates("ALL_V2"), ctes) + f"SELECT entity_id, target_entity_id, {', '.join(columns)} FROM both_sides {joins}"


def _feature_oracles() -> dict[str, str]:
    """Queries over features of pairs."""
    out = {}
    ids = "ids AS (SELECT source1_entity_id, target_entity_id FROM cand)"
    ctes, select = _base()
    out["alternative_features"] = _alternative()
    out["base_features"] = _with(ENT, candidates("ALL_V2"), ids, ctes) + select
    named = (ENT, candidates("ALL_V2"), CLOSE, measured("nm", "close", "x", "y"), measured("am", "close", "xa", "ya"))
    keys = f"parts AS (SELECT entity_id, regexp_extract(n, '(?:^|\\s)({_SUFFIX})$', 1) AS suffix, regexp_extract(business_address, '\\p{{Nd}}+') AS number FROM (SELECT entity_id, business_address, {norm('business_name')} AS n FROM ent))"
    rel = "rel AS (SELECT c.source1_entity_id AS entity_id, c.target_entity_id, nm.ratio AS n, am.ratio AS a, p.suffix AS s, q.suffix AS t, p.number AS i, q.number AS j FROM close c JOIN nm ON nm.x = c.x AND nm.y = c.y JOIN am ON am.x = xa AND am.y = ya JOIN parts p ON p.entity_id = c.source1_entity_id JOIN parts q ON q.entity_id = c.target_entity_id)"
    values = {"norm_name_ratio": "n", "norm_address_ratio": "a", "name_address_mean": "(n + a) / 2", "name_address_min": "least(n, a)", "name_address_max": "greatest(n, a)", "name_address_gap": "n - a", "name_dominance": "greatest(n - a, 0.0)", "address_dominance": "greatest(a - n, 0.0)"}
    flags = {"suffix_both_present": "s <> '' AND t <> ''", "suffix_same": "s <> '' AND s = t", "suffix_conflict": "s <> '' AND t <> '' AND s <> t", "address_number_conflict": "i <> '' AND j <> '' AND i <> j"}
    out["extra_features"] = _with(*named, keys, rel) + "SELECT entity_id, target_entity_id, " + ", ".join([*(f"round({v}, 6) AS {k}" for k, v in values.items()), *(f"CAST({v} AS DOUBLE) AS {k}" for k, v in flags.items())]) + " FROM rel"
    raw, every = _base(rounded=False)
    label = "ids AS (SELECT c.source1_entity_id, c.target_entity_id FROM cand c)"
    lot = "md5('42|' || entity_id || '|' || target_entity_id)"
    bucket = """CASE WHEN norm_name_ratio >= 85 AND norm_address_ratio <= 70 THEN 'A_high_name_bad_address' WHEN norm_address_token_set_ratio >= 85 AND norm_name_ratio <= 60 THEN 'B_high_address_weak_name'
    WHEN name_no_suffix_wratio >= 90 AND norm_address_ratio <= 70 THEN 'C_no_suffix_high_name_bad_address' WHEN norm_name_ratio >= 85 AND address_number_match = 0 AND address1_missing = 0 AND address2_missing = 0 THEN 'D_high_name_number_conflict' END"""
    score = "round(norm_name_ratio * 0.35 + norm_address_ratio * 0.35 + name_no_suffix_wratio * 0.15 + norm_address_token_set_ratio * 0.15, 6)"
    out["hard_negative_dataset"] = _with(ENT, TRUTH, candidates("ALL_V2"), label, raw, f"f AS ({every})", f"g AS (SELECT f.*, CAST(t.target_entity_id IS NOT NULL AS BIGINT) AS label, {score} AS hard_score, {bucket} AS bucket FROM f LEFT JOIN truth t ON t.source1_entity_id = f.entity_id AND t.target_entity_id = f.target_entity_id)",
        "hard AS (SELECT entity_id, target_entity_id, label, bucket AS kind, hard_score FROM g WHERE label = 0 AND bucket IS NOT NULL ORDER BY hard_score DESC, entity_id, target_entity_id LIMIT 200)",
        f"others AS (SELECT entity_id, target_entity_id, label, 'random' AS kind, hard_score, row_number() OVER (ORDER BY {lot}, entity_id, target_entity_id) AS r FROM g WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM hard h WHERE h.entity_id = g.entity_id AND h.target_entity_id = g.target_entity_id))") + "SELECT * FROM hard UNION ALL SELECT entity_id, target_entity_id, label, kind, hard_score FROM others WHERE r <= 1000 - (SELECT count(*) FROM hard) UNION ALL SELECT entity_id, target_entity_id, label, 'positive', hard_score FROM g WHERE label = 1"
    return out


def _other_oracles() -> dict[str, str]:
    """Queries over keys, samples and evaluation."""
    out = {}
    lot = "md5('42|' || source1_entity_id || '|' || target_entity_id)"
    out["targeted_negatives_v4"] = _with(ENT, TRUTH, candidates("ALL_V4"), f"neg AS (SELECT *, CASE WHEN n_blocks >= 2 THEN 'strong' ELSE 'control' END AS kind FROM cand c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = c.source1_entity_id AND t.target_entity_id = c.target_entity_id))") + f"SELECT source1_entity_id, target_entity_id, n_blocks, kind FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, kind ORDER BY n_blocks DESC, {lot}, target_entity_id) AS r FROM neg) WHERE r <= CASE kind WHEN 'strong' THEN 5 ELSE 2 END"
    state = ", ".join(f"CASE WHEN a.{b} = '' OR b.{b} = '' THEN 'missing' WHEN a.{b} = b.{b} THEN 'equal' ELSE 'different' END AS {b}_status" for b in ("name_first", "name_prefix2", "address_number", "address_first"))
    out["miss_diagnosis"] = _with(ENT, candidates("BASELINE"), AND_JOIN) + f"SELECT {state}, count(*) AS n FROM cand c JOIN keys a ON a.entity_id = c.source1_entity_id JOIN keys b ON b.entity_id = c.target_entity_id WHERE NOT EXISTS (SELECT 1 FROM both_first f WHERE f.source1_entity_id = c.source1_entity_id AND f.target_entity_id = c.target_entity_id) GROUP BY ALL"
    out["last_word_block"] = _with(ENT, f"w AS (SELECT entity_id, source, lower(trim(country)) AS c, split_part({norm('business_name')}, ' ', -1) AS l FROM ent)") + "SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id AS target_entity_id FROM w a JOIN w b ON a.c = b.c AND a.l = b.l AND a.source = 1 AND b.source > 1 WHERE a.l <> ''"
    out["triple_key_join"] = _with(ENT, candidates("BASELINE")) + "SELECT source1_entity_id, target_entity_id FROM cand WHERE list_contains(blocks, 'name_first') AND list_contains(blocks, 'name_prefix2') AND list_contains(blocks, 'address_number')"
    out["stratified_split"] = _with(ENT, TRUTH, keys("BASELINE"), AND_JOIN, "g AS (SELECT f.*, CAST(t.target_entity_id IS NOT NULL AS BIGINT) AS label FROM both_first f LEFT JOIN truth t USING (source1_entity_id, target_entity_id))") + f"SELECT source1_entity_id, target_entity_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {lot}, source1_entity_id, target_entity_id) <= count(*) OVER (PARTITION BY label) * 20 // 100 THEN 'test' ELSE 'train' END AS split FROM g"
    out["reservoir_sample"] = _with(ENT) + "SELECT entity_id FROM ent ORDER BY md5('42|' || entity_id), entity_id LIMIT 100"
    judged = (ENT, TRUTH, candidates("ALL_V2"), SCORED)
    out["top_by_score"] = _with(*judged) + "SELECT * FROM (SELECT source1_entity_id, target_entity_id, row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, target_entity_id) AS rank FROM scored) WHERE rank <= 2"
    told = _with(*judged, "told AS (SELECT s.*, CAST(t.target_entity_id IS NOT NULL AS BIGINT) AS label, CAST(score >= 0.65 AS BIGINT) AS predicted FROM scored s LEFT JOIN truth t USING (source1_entity_id, target_entity_id))")
    out["confusion_matrix"] = told + "SELECT label, predicted, count(*) AS n FROM told GROUP BY 1, 2"
    out["classification_report"] = told + ", h AS (SELECT k AS label, count(*) FILTER (WHERE label = k AND predicted = k) AS hit, count(*) FILTER (WHERE predicted = k) AS said, count(*) FILTER (WHERE label = k) AS support FROM told, (VALUES (0), (1)) v(k) GROUP BY 1), r AS (SELECT *, coalesce(hit / nullif(said, 0), 0.0) AS p, coalesce(hit / nullif(support, 0), 0.0) AS q FROM h) SELECT CAST(label AS BIGINT) AS label, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1, support FROM r"
    out["error_ranking"] = told + "SELECT source1_entity_id, target_entity_id, outcome, round(score, 6) AS score FROM (SELECT *, CASE WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS outcome, row_number() OVER (PARTITION BY predicted ORDER BY CASE WHEN predicted = 1 THEN -score ELSE score END, source1_entity_id, target_entity_id) AS r FROM told WHERE label <> predicted) WHERE r <= 50"
    n, a = norm("url"), norm("substr(url, 9, 30)")
    words = "len(list_filter(string_split({}, ' '), lambda t: t <> ''))"
    out["record_fields"] = f"""SELECT page_id, url AS business_name_raw, substr(url, 9, 30) AS business_address_raw, 'US' AS country_raw, n AS business_name_normalized, a AS business_address_normalized, {_no_suffix('n')} AS business_name_without_suffix, regexp_extract(n, '(?:^|\\s)({_SUFFIX})$', 1) AS legal_suffix,
  {words.format('n')} AS name_token_count, {words.format('a')} AS address_token_count, length(n) AS name_length, length(a) AS address_length, split_part(n, ' ', 1) AS name_first_token, split_part(n, ' ', -1) AS name_last_token FROM (SELECT page_id, url, {n} AS n, {a} AS a FROM pages)"""
    return out


def _part_oracles(cosines: str, grams: str) -> dict[str, str]:
    """Queries over parts of addresses and character n-grams."""
    out = {}
    up = "upper(trim({}))"
    sets = {
        "num": f"list_distinct(list_transform(regexp_extract_all({up}, '\\p{{{{Nd}}}}+'), lambda z: {_number('z')}))",
        "compound": f"list_distinct(regexp_extract_all({up}, '\\b\\p{{{{Nd}}}}+[A-Z]?-\\p{{{{Nd}}}}+[A-Z]?\\b'))",
        "alnum": f"list_distinct(regexp_extract_all({up}, '[A-Z0-9]+(?:-[A-Z0-9]+)*'))",
        "postal": f"list_distinct(list_transform(regexp_extract_all({up}, '\\b\\p{{{{Nd}}}}{{{{4,6}}}}\\b'), lambda z: {_number('z')}))",
    }
    out["address_token_sets"] = "SELECT page_id, " + ", ".join(f"array_to_string(list_sort({sets[k].format('url')}), ',') AS {k}" for k in ("compound", "postal")) + " FROM pages"
    plain = _number("regexp_extract(upper(trim(business_address)), '\\p{Nd}+')")
    made = f"made AS (SELECT entity_id, {', '.join(f'{v.format("business_address")} AS {k}' for k, v in sets.items())}, {plain} AS first FROM ent)"
    rows = "r AS (SELECT c.source1_entity_id AS entity_id, c.target_entity_id, " + ", ".join(f"{p}.{k} AS {p}_{k}" for p in "ab" for k in (*sets, "first")) + " FROM cand c JOIN made a ON a.entity_id = c.source1_entity_id JOIN made b ON b.entity_id = c.target_entity_id)"

    def shared(k: str) -> str:
        return f"len(list_intersect(a_{k}, b_{k}))"

    def jaccard(k: str) -> str:
        return f"round(CASE WHEN len(a_{k}) = 0 AND len(b_{k}) = 0 THEN 1.0 ELSE {shared(k)} / (len(a_{k}) + len(b_{k}) - {shared(k)}) END, 6)"

    def overlap(k: str) -> str:
        return f"round(CASE WHEN len(a_{k}) = 0 OR len(b_{k}) = 0 THEN 0.0 ELSE {shared(k)} / least(len(a_{k}), len(b_{k})) END, 6)"

    out["address_features"] = _with(ENT, candidates("ALL_V2"), made, rows) + f"""SELECT entity_id, target_entity_id, {jaccard('num')} AS address_num_jaccard, {overlap('num')} AS address_num_overlap_min, CAST(len(a_num) > 0 AND len(a_num) = len(b_num) AND {shared('num')} = len(a_num) AS DOUBLE) AS address_num_exact_set, CAST(abs(len(a_num) - len(b_num)) AS DOUBLE) AS address_num_count_diff,
  CAST({shared('compound')} > 0 AS DOUBLE) AS address_compound_num_exact, {jaccard('compound')} AS address_compound_num_jaccard, {jaccard('alnum')} AS address_alnum_token_jaccard, {overlap('alnum')} AS address_alnum_token_overlap_min, CAST(a_first <> '' AND a_first = b_first AS DOUBLE) AS address_first_num_exact_normalized, CAST({shared('postal')} > 0 AS DOUBLE) AS address_postal_overlap FROM r"""
    listed = ", ".join(f"{grams.format(x=c, n=k)} AS {c}{k}" for c in "xy" for k in (3, 4, 5))
    columns = ", ".join(f"cosine_{k} AS {c}_char_{k}gram_cosine" for c in ("name", "latin") for k in (3, 4, 5))
    # The documents hold Latin letters alone, which are the same when transliterated.
    out["ngram_features"] = _with(ENT, candidates("ALL_V2"), CLOSE) + f"SELECT entity_id, target_entity_id, {columns} FROM (SELECT source1_entity_id AS entity_id, target_entity_id, {cosines} FROM (SELECT source1_entity_id, target_entity_id, {listed} FROM close))"
    return out


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    out: dict[str, str] = {}
    n, a = norm("business_name"), norm("business_address")
    tokens = "list_filter(string_split({}, ' '), lambda t: t <> '')"
    out["norm_name_doc"] = _with(ENT) + f"""SELECT entity_id, n AS name_norm, a AS address_norm, {_no_suffix('n')} AS name_no_suffix, regexp_extract(n, '(?:^|\\s)({_SUFFIX})$', 1) AS suffix,
  len({tokens.format('n')}) AS name_tokens, len({tokens.format('a')}) AS address_tokens, length(n) AS name_length, length(a) AS address_length, split_part(n, ' ', 1) AS first_token, split_part(n, ' ', -1) AS last_token
  FROM (SELECT entity_id, {n} AS n, {a} AS a FROM ent)"""
    words = _list(text.LEGAL_WORDS)
    out["legal_suffix_split"] = f"""SELECT name, regexp_extract(name, '(?:^|\\s)({_SUFFIX})$', 1) AS suffix, {_no_suffix('name')} AS without_suffix,
  CASE WHEN list_contains({words}, split_part(name, ' ', -1)) THEN array_to_string(string_split(name, ' ')[:-2], ' ') ELSE name END AS without_word, {_titles('name')} AS without_titles FROM {_names()}"""
    out["ocr_name_fix"] = f"SELECT name, {_misread('name')} AS fixed FROM (SELECT name FROM {_names()} UNION ALL SELECT {norm('url')} FROM pages)"
    out["token_stats_hist"] = f"""SELECT lang, CASE WHEN w < 50 THEN '<50' WHEN w < 100 THEN '50-99' WHEN w < 200 THEN '100-199' WHEN w < 400 THEN '200-399' WHEN w < 800 THEN '400-799' ELSE '800+' END AS bin, count(*) AS n
  FROM (SELECT lang, len({tokens.format(norm('text'))}) AS w FROM documents) GROUP BY 1, 2"""
    out["script_class_doc"] = r"""SELECT lang, CASE WHEN l + d + o = 0 THEN 'empty' WHEN l + d + o > 1 THEN 'mixed' WHEN l = 1 THEN 'latin' WHEN d = 1 THEN 'devanagari' ELSE 'other' END AS script, count(*) AS n
  FROM (SELECT lang, CAST(regexp_matches(x, '\p{Latin}') AS INT) AS l, CAST(regexp_matches(x, '\p{Devanagari}') AS INT) AS d, CAST(regexp_matches(regexp_replace(x, '[\p{Latin}\p{Devanagari}]', '', 'g'), '\p{L}') AS INT) AS o
    FROM (SELECT lang, regexp_replace(text, '[^\p{L}]', '', 'g') AS x FROM documents)) GROUP BY 1, 2"""
    plain = _number(r"regexp_extract(upper(trim(url)), '\p{Nd}+')")
    listed = f"list_transform(regexp_extract_all(upper(trim(url)), '\\p{{Nd}}+'), lambda z: {_number('z')})"
    out["address_number_keys_pages"] = f"SELECT page_id, regexp_extract(u, '\\p{{Nd}}+') AS number_v1, {_house('u')} AS number_v2, {plain} AS first_plain, array_to_string(list_sort(list_distinct({listed})), ',') AS numbers FROM (SELECT page_id, url, {norm('url')} AS u FROM pages)"
    out["address_first_keys_doc"] = _with(ENT) + f"SELECT entity_id, {_FIRST['v1']} AS v1, {_FIRST['v2']} AS v2, {_FIRST['v3']} AS v3, {_FIRST['v4']} AS v4 FROM (SELECT entity_id, {a} AS a FROM ent)"
    out["blocking_or_join"] = _with(ENT, candidates("ALL_V4")) + "SELECT source1_entity_id, target_entity_id, array_to_string(blocks, ',') AS blocks, n_blocks FROM cand"
    out["blocking_and_join"] = _with(ENT, keys("BASELINE"), AND_JOIN) + "SELECT source1_entity_id, target_entity_id FROM both_first"
    out["blocking_intersections"] = _with(ENT, candidates("BASELINE"), HITS) + "SELECT source1_entity_id, target_entity_id, array_to_string(strategies, ',') AS strategies FROM hits"
    parts = ", ".join(candidates(v, f"c_{v}", f"k_{v}") for v in VERSIONS)
    each = " UNION ALL ".join(f"SELECT '{v}' AS variant, (SELECT count(*) FROM truth) AS truth_pairs, (SELECT count(*) FROM truth JOIN c_{v} USING (source1_entity_id, target_entity_id)) AS recovered_pairs, (SELECT count(*) FROM c_{v}) AS total_candidates" for v in VERSIONS)
    share = "CASE WHEN {0}truth_pairs > 0 THEN {0}recovered_pairs / {0}truth_pairs ELSE 1.0 END"
    out["blocking_variant_report"] = _with(ENT, TRUTH, parts, f"report AS ({each})", "base AS (SELECT * FROM report WHERE variant = 'BASELINE')") + f"""SELECT r.variant, r.truth_pairs, r.recovered_pairs, round({share.format('r.')}, 6) AS candidate_recall, r.total_candidates, round(r.total_candidates / (SELECT count(*) FROM ent WHERE source = 1), 6) AS avg_candidates_per_source1,
  round({share.format('r.')} - {share.format('b.')}, 6) AS recall_delta, r.total_candidates - b.total_candidates AS candidates_delta FROM report r, base b"""
    loose = r"split_part(trim(regexp_replace(lower(business_name), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ', 1)"
    out["first_word_block_negatives"] = _with(ENT, TRUTH, f"f AS (SELECT entity_id, source, lower(trim(country)) AS c, {loose} AS w FROM ent)") + "SELECT a.entity_id AS source1_entity_id, count(*) AS n FROM f a JOIN f b ON a.c = b.c AND a.w = b.w AND a.source = 1 AND b.source > 1 WHERE a.w <> '' AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = a.entity_id AND t.target_entity_id = b.entity_id) GROUP BY 1"
    recall = _with(ENT, TRUTH, keys("BASELINE"), AND_JOIN, counts("SELECT * FROM both_first"))
    out["candidate_recall_by_entity"] = recall + "SELECT source1_entity_id, true_count AS gt_count, predicted_count AS candidate_count, tp AS recovered_gt_count, true_count - tp AS missed_gt_count, round(CASE WHEN true_count = 0 THEN 1.0 ELSE tp / true_count END, 6) AS candidate_recall FROM per"
    out["candidate_ceiling"] = recall + "SELECT source1_entity_id, round(CASE WHEN true_count = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / true_count) / (0.25 + tp / true_count) END, 6) AS ceiling_f05 FROM per"
    out["missed_pairs_grouping_sets"] = _with(ENT, candidates("BASELINE"), AND_JOIN, "m AS (SELECT e.country, CAST(e.source AS VARCHAR) AS target_source, array_to_string(blocks, ',') AS keys FROM cand c JOIN ent e ON e.entity_id = c.target_entity_id WHERE NOT EXISTS (SELECT 1 FROM both_first f WHERE f.source1_entity_id = c.source1_entity_id AND f.target_entity_id = c.target_entity_id))") + "SELECT 'country' AS category, country AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'target_source', target_source, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'keys', keys, count(*) FROM m GROUP BY 2"
    out["semi_join_sampled"] = _with(ENT, TRUTH) + "SELECT * FROM truth WHERE source1_entity_id IN (SELECT entity_id FROM ent WHERE country IN ('de', 'fr', 'es'))"
    out["anti_join_negatives"] = _with(ENT, TRUTH, candidates("BASELINE")) + "SELECT source1_entity_id, target_entity_id FROM cand EXCEPT SELECT * FROM truth"
    out["left_join_one_to_one"] = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
    lot = "md5('42|' || source1_entity_id || '|' || target_entity_id)"
    negative = f"neg AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY n_blocks DESC, {lot}, target_entity_id) AS rank FROM cand c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = c.source1_entity_id AND t.target_entity_id = c.target_entity_id))"
    out["topn_hard_negatives"] = _with(ENT, TRUTH, candidates("ALL_V2"), negative) + "SELECT source1_entity_id, target_entity_id, n_blocks FROM neg WHERE rank <= 5"
    out["training_pairs"] = _with(ENT, TRUTH, candidates("ALL_V2"), negative) + """SELECT a.entity_id, b.entity_id AS target_entity_id, 'source' || b.source AS target_source, a.business_name, b.business_name AS target_business_name, p.label, array_to_string(p.blocks, ',') AS matched_blocks, p.kind
  FROM (SELECT source1_entity_id, target_entity_id, blocks, CAST(0 AS BIGINT) AS label, 'hard_negative' AS kind FROM neg WHERE rank <= 3 UNION ALL SELECT source1_entity_id, target_entity_id, blocks, 1, 'positive' FROM cand JOIN truth USING (source1_entity_id, target_entity_id)) p
  JOIN ent a ON a.entity_id = p.source1_entity_id JOIN ent b ON b.entity_id = p.target_entity_id"""
    out["hash_sample_split"] = _with(ENT) + "SELECT entity_id, CASE WHEN r <= 60 THEN 'holdout' WHEN r <= 120 THEN 'dev' ELSE 'train' END AS split FROM (SELECT entity_id, row_number() OVER (ORDER BY md5('2026|' || entity_id), entity_id) AS r FROM ent WHERE source = 1)"
    out["sample_by_group"] = _with(ENT) + "SELECT entity_id, country, CAST(source AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY country, source ORDER BY md5('42|' || entity_id), entity_id) AS r FROM ent) WHERE r <= 10"
    out["dedup_category_priority"] = _with(ENT, candidates("BASELINE"), HITS) + "SELECT source1_entity_id, target_entity_id, list_filter(['I2', 'I1', 'I4', 'I3'], lambda s: list_contains(strategies, s))[1] AS category FROM hits"
    out["oversample_x3"] = _with(ENT, TRUTH, keys("BASELINE"), AND_JOIN) + "SELECT source1_entity_id, target_entity_id, label, unnest(range(1, CASE WHEN label = 1 THEN 4 ELSE 2 END)) AS copy FROM (SELECT f.*, CAST(t.target_entity_id IS NOT NULL AS BIGINT) AS label FROM both_first f LEFT JOIN truth t USING (source1_entity_id, target_entity_id))"
    close = _with(ENT, candidates("ALL_V2"), CLOSE)
    out["indel_ratio_pairs"] = close + f"SELECT source1_entity_id, target_entity_id, round({ratio('x', 'y')}, 6) AS ratio FROM close"
    ordered = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda t: t <> '')), ' ')"
    out["token_sort_ratio_pairs"] = close + f"SELECT source1_entity_id, target_entity_id, round({ratio('x', 'y')}, 6) AS token_sort_ratio FROM (SELECT source1_entity_id, target_entity_id, {ordered.format('x')} AS x, {ordered.format('y')} AS y FROM close)"
    out["token_set_ratio_pairs"] = close + f""", sets AS (SELECT source1_entity_id, target_entity_id, list_filter(list_distinct(string_split(x, ' ')), lambda t: t <> '') AS p, list_filter(list_distinct(string_split(y, ' ')), lambda t: t <> '') AS q FROM close),
  rest AS (SELECT *, length(array_to_string(list_intersect(p, q), ' ')) AS s, array_to_string(list_sort(list_filter(p, lambda t: NOT list_contains(q, t))), ' ') AS u, array_to_string(list_sort(list_filter(q, lambda t: NOT list_contains(p, t))), ' ') AS v FROM sets),
  sized AS (SELECT *, s + CAST(s > 0 AS INT) + length(u) AS m, s + CAST(s > 0 AS INT) + length(v) AS n, coalesce({lcs('u', 'v')}, 0) AS c FROM rest)
  SELECT source1_entity_id, target_entity_id, round(CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 WHEN s > 0 AND (u = '' OR v = '') THEN 100.0
    ELSE greatest(100.0 - 100.0 * (length(u) + length(v) - 2 * c) / (m + n), CASE WHEN s > 0 THEN greatest(100.0 - 100.0 * (m - s) / (s + m), 100.0 - 100.0 * (n - s) / (s + n)) ELSE 0.0 END) END, 6) AS token_set_ratio FROM sized"""
    grams = "CASE WHEN length({x}) < {n} THEN [] ELSE list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})) END"
    norms = "sqrt(CAST(list_sum(list_transform(list_distinct({g}), lambda z: len(list_filter({g}, lambda w: w = z)) ** 2)) AS DOUBLE))"
    cosines = ", ".join(f"round(CASE WHEN len(x{k}) = 0 OR len(y{k}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(x{k}), lambda z: len(list_filter(x{k}, lambda w: w = z)) * len(list_filter(y{k}, lambda w: w = z)))) / ({norms.format(g=f'x{k}')} * {norms.format(g=f'y{k}')}) END, 6) AS cosine_{k}" for k in (3, 4, 5))
    out["char_ngram_cosine"] = close + f"SELECT source1_entity_id, target_entity_id, {cosines} FROM (SELECT source1_entity_id, target_entity_id, " + ", ".join(f"{grams.format(x=c, n=k)} AS {c}{k}" for c in "xy" for k in (3, 4, 5)) + " FROM close)"
    found = "list_distinct(regexp_extract_all(upper(trim({})), '[A-Z0-9]+(?:-[A-Z0-9]+)*'))"
    shared = "len(list_intersect(p, q))"
    out["address_sets_jaccard"] = close + f"""SELECT source1_entity_id, target_entity_id, round(CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1.0 ELSE {shared} / (len(p) + len(q) - {shared}) END, 6) AS jaccard,
  round(CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE {shared} / least(len(p), len(q)) END, 6) AS overlap, CAST(len(p) > 0 AND len(p) = len(q) AND {shared} = len(p) AS DOUBLE) AS same
  FROM (SELECT source1_entity_id, target_entity_id, {found.format('xa')} AS p, {found.format('ya')} AS q FROM close)"""
    out["length_token_features"] = close + "SELECT source1_entity_id, target_entity_id, abs(length(x) - length(y)) AS length_diff, round(CASE WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 ELSE least(length(x), length(y)) / greatest(length(x), length(y)) END, 6) AS length_ratio, abs(len(string_split(x, ' ')) - len(string_split(y, ' '))) AS token_count_diff FROM close"
    flags = {b: f"CAST(list_contains(blocks, '{b}') AS BIGINT)" for b in ("name_first", "name_prefix2", "address_number", "address_first")}
    out["blocking_evidence_features"] = _with(ENT, candidates("ALL_V4")) + f"SELECT source1_entity_id AS entity_id, target_entity_id, n_blocks AS v4_shared_key_count, {flags['name_first']} + {flags['name_prefix2']} AS v4_shared_name_key_count, {flags['address_number']} + {flags['address_first']} AS v4_shared_address_key_count, " + ", ".join(f"{f} AS v4_{b}_match" for b, f in flags.items()) + " FROM cand"
    drawn = "CAST('0x' || substr(md5('42|' || {}), 1, 15) AS BIGINT)"
    out["random_negatives"] = _with(ENT, TRUTH, "z AS (SELECT source, CASE source WHEN 2 THEN 3 ELSE 2 END AS n, greatest(1, count(*) // 64) AS buckets FROM ent WHERE source > 1 GROUP BY 1)",
        f"dealt AS (SELECT e.source, entity_id, {drawn.format('entity_id')} % buckets AS bucket FROM ent e JOIN z ON z.source = e.source)",
        f"want AS (SELECT e.entity_id AS s1, z.*, {drawn.format("e.entity_id || '|' || z.source")} % buckets AS first FROM ent e, z WHERE e.source = 1)",
        "met AS (SELECT s1, w.source, n, entity_id AS t FROM want w JOIN dealt d ON d.source = w.source AND (d.bucket = first OR d.bucket = (first + 1) % buckets) WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.source1_entity_id = s1 AND x.target_entity_id = entity_id))") + "SELECT s1 AS source1_entity_id, t AS target_entity_id, CAST(source AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY md5('42|' || s1 || '|' || t), t) AS r FROM met) WHERE r <= n"
    judged = (ENT, TRUTH, candidates("ALL_V2"), SCORED)
    at = _with(*judged, counts("SELECT source1_entity_id, target_entity_id FROM scored WHERE score >= 0.65"))
    out["macro_f05_at_t"] = at + f"SELECT round(avg({_F05}), 6) AS macro_f05, count(*) AS entities, round(avg(predicted_count), 6) AS avg_predictions FROM per"
    out["micro_pr"] = at + ", s AS (SELECT sum(tp) AS tp, sum(predicted_count - tp) AS fp, sum(true_count - tp) AS fn FROM per), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS q FROM s) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS pair_precision, round(q, 6) AS pair_recall, round(CASE WHEN tp > 0 THEN 1.25 * p * q / (0.25 * p + q) ELSE 0.0 END, 6) AS pair_f05 FROM r"
    ranked = "ranked AS (SELECT s.*, CAST(t.target_entity_id IS NOT NULL AS INT) AS t, row_number() OVER (PARTITION BY s.source1_entity_id ORDER BY score DESC, s.target_entity_id) AS rank FROM scored s LEFT JOIN truth t USING (source1_entity_id, target_entity_id))"
    grid = "grid AS (SELECT CAST(range AS DOUBLE) / 100 AS threshold, k AS top_k FROM range(55, 86), (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k))"
    out["threshold_topk_search"] = _with(*judged, ranked, grid, "ids AS (SELECT e.entity_id AS i, coalesce(n, 0) AS true_count FROM ent e LEFT JOIN (SELECT source1_entity_id, count(*) AS n FROM truth GROUP BY 1) t ON t.source1_entity_id = e.entity_id WHERE source = 1)", "own AS (SELECT threshold, top_k, source1_entity_id AS i, count(*) AS predicted_count, sum(t) AS tp FROM ranked JOIN grid ON score >= threshold AND (top_k = 0 OR rank <= top_k) GROUP BY 1, 2, 3)", "f AS (SELECT g.threshold, g.top_k, ids.true_count, coalesce(o.predicted_count, 0) AS predicted_count, coalesce(o.tp, 0) AS tp FROM grid g CROSS JOIN ids LEFT JOIN own o ON o.threshold = g.threshold AND o.top_k = g.top_k AND o.i = ids.i)") + f"SELECT threshold, CAST(top_k AS BIGINT) AS top_k, round(avg({_F05}), 6) AS macro_f05, round(avg(predicted_count), 6) AS avg_predictions FROM f GROUP BY 1, 2"
    out["error_entity_summary"] = _with(*judged, ranked, counts("SELECT source1_entity_id, target_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, target_entity_id) AS r FROM scored WHERE score >= 0.6) WHERE r <= 3")) + f"SELECT source1_entity_id, true_count, predicted_count, tp, predicted_count - tp AS fp, true_count - tp AS fn, round({_F05}, 6) AS f05 FROM per"
    out["confusion_by_blocks"] = _with(*judged, ranked) + "SELECT CASE WHEN score >= 0.65 AND t = 1 THEN 'TP' WHEN score >= 0.65 THEN 'FP' WHEN t = 1 THEN 'FN' ELSE 'TN' END AS outcome, n_blocks, count(*) AS n FROM ranked GROUP BY 1, 2"
    out["describe_percentiles"] = "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, " + ", ".join(f"round(quantile_cont(o_totalprice, {p / 100}), 4) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM orders GROUP BY 1"
    out["group_mean_median"] = "SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean, round(median(n_chars), 2) AS median FROM documents GROUP BY 1"
    out["gt_match_distribution"] = _with(ENT, TRUTH) + "SELECT n_matches, count(*) AS entities FROM (SELECT e.entity_id, count(t.target_entity_id) AS n_matches FROM ent e LEFT JOIN truth t ON t.source1_entity_id = e.entity_id WHERE e.source = 1 GROUP BY 1) GROUP BY 1"
    out["missing_value_profile"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim(coalesce(CAST({c} AS VARCHAR), '')) = '') AS missing, count(*) AS rows FROM documents" for c in ("doc_id", "text", "lang", "source"))
    out["value_counts_pct"] = "SELECT c_mktsegment, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY 1"
    out["union_tagged"] = "SELECT kind, nationkey, count(*) AS n FROM (SELECT 'customer' AS kind, CAST(c_nationkey AS BIGINT) AS nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1, 2"
    out["intersect_except_ids"] = _with(ENT, candidates("BASELINE", "c1", "k1"), candidates("ALL_V4", "c2", "k2")) + "SELECT CASE WHEN a.source1_entity_id IS NULL THEN 'v4_only' WHEN b.source1_entity_id IS NULL THEN 'baseline_only' ELSE 'both' END AS found_by, count(*) AS n FROM c1 a FULL JOIN c2 b ON a.source1_entity_id = b.source1_entity_id AND a.target_entity_id = b.target_entity_id GROUP BY 1"
    out |= _similar_oracles() | _feature_oracles() | _other_oracles() | _part_oracles(cosines, grams)
    out["best_rule"] = f"SELECT * FROM ({out['threshold_topk_search']}) ORDER BY macro_f05 DESC, threshold, top_k LIMIT 1"
    return out
