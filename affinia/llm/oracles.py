"""DuckDB SQL that gives the same rows as those queries of this subpackage that SQL can express.

It relies on documents and conversations as the driver makes them: one row for each doc_id.
"""

from __future__ import annotations

from affinia.llm import chat, quality

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lines() -> str:
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents),
  k AS (SELECT *, {_ascii_lower(f"trim(line, {_SPACE})")} AS key FROM l),
  f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> holder AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def _contamination() -> str:
    words = f"regexp_extract_all({_ascii_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
  iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
  dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
  h AS (SELECT doc_id, p, iw.n, item FROM dw JOIN iw ON iw.n = dw.n AND iw.key = dw.key),
  c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
  s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""


def _chat() -> str:
    escaped = r"replace(t, '\', '\\')"
    for c in chat.CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
  j AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS said, coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '') AS loss,
    sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(r) + length({escaped})) AS n FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM j"""


def _quality() -> str:
    bare = "t"
    for symbol in quality.SYMBOLS:
        bare = f"replace({bare}, '{symbol}', '')"
    measures = list(quality.MEASURES)
    numbers = {"symbols": "n_symbols * 1000 // n", "lines": "n_dup_lines * 1000 // n", "repeats": "n_repeat_words * 1000 // n", "length": "word_chars * 100 // n"}
    low, mid, high = (f"q{q}" for q in (quality.LOW, quality.MIDDLE, quality.HIGH))
    least = f"min(bin) FILTER (WHERE upto * 100 >= rows * {{q}}) AS q{{q}}"
    quantiles = ", ".join(least.format(q=q) for q in (quality.LOW, quality.MIDDLE, quality.HIGH))

    def merged(name: str, by: str) -> str:
        keys = f"{by}, measure" if by else "measure"
        return f"{name} AS (SELECT {keys}, any_value(rows) AS rows, {quantiles} FROM (SELECT {keys}, bin, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}) AS rows FROM (SELECT {keys}, bin, sum(c) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys})"

    def chosen(q: str) -> str:
        return f"CASE WHEN o.rows >= {quality.MIN_ROWS} THEN o.{q} WHEN l.rows >= {quality.MIN_ROWS} THEN l.{q} ELSE e.{q} END AS {q}"

    slack = "CASE o.measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in quality.MEASURES.items()) + " END AS slack"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS v FROM g WHERE n_words > 0" for m, x in numbers.items())
    upper = {m: f"max(CASE WHEN measure = '{m}' THEN {high} + {quality.ABOVE} * greatest({high} - {mid}, slack) END) AS {m}_upper" for m in measures}
    beyond = " OR ".join([*(f"{x} > {m}_upper" for m, x in numbers.items()), f"{numbers['length']} < length_lower"])
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
  rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
  ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {_SPACE}) <> '' GROUP BY 1),
  f AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length({bare}) AS n_symbols, coalesce(x, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
  g AS (SELECT *, greatest(n_words, 1) AS n FROM f),
  v AS (SELECT lang, source, measure, CAST(v AS BIGINT) AS v FROM ({long})),
  sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin, count(*) AS c FROM v GROUP BY ALL),
  {merged('own', 'lang, source')}, {merged('by_lang', 'lang')}, {merged('every', '')},
  th AS (SELECT o.lang, o.source, o.measure, {', '.join(chosen(q) for q in (low, mid, high))}, {slack} FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN every e ON o.measure = e.measure),
  lim AS (SELECT lang, source, {', '.join(upper.values())}, max(CASE WHEN measure = 'length' THEN {low} - {quality.BELOW} * greatest({mid} - {low}, slack) END) AS length_lower FROM th GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce({beyond}, false) AS kept
FROM g LEFT JOIN lim ON g.lang IS NOT DISTINCT FROM lim.lang AND g.source IS NOT DISTINCT FROM lim.source"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"op1_line_dedup": _lines(), "op5_decontamination": _contamination(), "op9_chat_formatting": _chat(), "op10_quality_rules": _quality()}
