"""Quality rules with thresholds that follow the data instead of fixed cutoffs.

Measures of each text are turned into whole numbers and counted in quantile sketches, one for each
language, source and measure. A sketch is a histogram whose bins widen with the value (a bin is at
most a 32nd of its value wide), so sketches are merged by adding counts, from languages and sources up
to languages and to everything, and the result doesn't depend on how the rows are dealt out. Each
group's thresholds come from its own sketch or, below MIN_ROWS rows, from the next larger one. Rows are
judged by joining the thresholds of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinia import storage

#: Rows from which a group's sketch is used, and how many times its spread above the high or below the
#: low quantile a value is an outlier.
MIN_ROWS, ABOVE, BELOW = 200, 8, 2
#: The quantiles, in percent, that span the usual values; up to 100 - HIGH percent of a group may be bad
#: before its upper thresholds rise.
LOW, MIDDLE, HIGH = 10, 50, 75
#: Measures: symbols and repeated lines and words in 1000 words (judged from above), and characters in
#: 100 words (judged from both sides); the slack is a spread that any group is granted. In a group whose
#: usual value is 0, 240 repeated words pass, fewer than by the base rule, and 32 repeated lines: fewer
#: than there are in a text whose lines have up to seven words and come twice.
MEASURES = {"symbols": 20, "lines": 4, "repeats": 30, "length": 60}
SPACE = " \t\n\x0b\f\r"
#: Characters that count as symbols; a fixed value.
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words that stand in a run of ``window`` words which occurs twice or more in the text."""

    def counted(hashes: Column) -> Column:
        # Places by hash: a run occurs again if its neighbour in this order has the same hash.
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            size = F.size(p)
            return F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get(p, k + 1)["h"] == x["h"])))

        def covered(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

        listed = _let(_let(places, again), lambda p: F.array_sort(F.transform(p, lambda x: x["i"])))
        # Most texts repeat no run: telling that needs no sorting.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(listed, covered))

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    of_words = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(_let(of_words, hashed), counted)).cast("long")


def measures(documents: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text; null: no words."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    text, trimmed = F.col("text"), F.btrim("text", F.lit(SPACE))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    split = rows.withColumns({"words": words, "lines": lines})
    return split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), window).alias("n_repeat_words"),
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def _numbers() -> dict[str, Column]:
    """The measures as whole numbers; only rows with words are judged."""
    words = F.greatest("n_words", F.lit(1))
    return {"symbols": _div(F.col("n_symbols") * 1000, words), "lines": _div(F.col("n_dup_lines") * 1000, words), "repeats": _div(F.col("n_repeat_words") * 1000, words), "length": _div(F.col("word_chars") * 100, words)}


def bin_floor(value: Column) -> Column:
    """The least value of a value's bin: its six leading binary digits, the others zero."""
    more = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, more), more)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and bin: mergeable by adding."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bin_floor(v).alias("bin")) for k, v in _numbers().items()])
    long = measured.select("lang", "source", F.explode(pairs).alias("m"))
    return long.groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merged sketches of each group: rows, and the bins at LOW, MIDDLE and HIGH percent; no group: everything."""
    keys = [*by, "measure"]
    merged = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys)
    ranked = merged.select(*keys, "bin", F.sum("n").over(whole.orderBy("bin")).alias("upto"), F.sum("n").over(whole).alias("rows"))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("bin"))).alias(f"q{q}") for q in (LOW, MIDDLE, HIGH)]
    return ranked.groupBy(*keys).agg(F.first("rows").alias("rows"), *at)


def thresholds(sketch: DataFrame) -> DataFrame:
    """For each lang and source (either may be null) the least and greatest value of each measure that passes."""
    own, by_lang, all_rows = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])

    def named(q: DataFrame, prefix: str, keys: dict[str, str]) -> DataFrame:
        return q.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(prefix + c) for c in ("rows", f"q{LOW}", f"q{MIDDLE}", f"q{HIGH}")])

    lang, every = named(by_lang, "l_", {"lang": "l_lang", "measure": "l_measure"}), named(all_rows, "e_", {"measure": "e_measure"})
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(every, F.col("measure") == F.col("e_measure"))

    def chosen(c: str) -> Column:
        return F.when(F.col("rows") >= MIN_ROWS, F.col(c)).when(F.col("l_rows") >= MIN_ROWS, F.col("l_" + c)).otherwise(F.col("e_" + c))

    low, middle, high = chosen(f"q{LOW}"), chosen(f"q{MIDDLE}"), chosen(f"q{HIGH}")
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
    upper = high + ABOVE * F.greatest(high - middle, slack)
    lower = low - BELOW * F.greatest(middle - low, slack)
    flat = joined.select("lang", "source", "measure", upper.alias("upper"), lower.alias("lower"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("upper", "lower")]
    return flat.groupBy("lang", "source").agg(*wide)


def judge(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The base rule fails texts of fewer than 20 words, or with more than 30 % of their words in repeated
    runs of eight. Other texts are kept unless a measure lies beyond their group's thresholds; one that
    equals a threshold is kept. A null or empty text has no words and fails. Null languages and sources
    are groups of their own; repeated rows are counted each; texts of any length are taken whole, each
    within its row; an empty table gives no rows. Only doc_id, text, lang and source are read.
    """
    measured = storage.materialize(measures(documents), "measures")
    limits = thresholds(sketches(measured.filter("n_words > 0")))
    limits = limits.withColumnRenamed("lang", "t_lang").withColumnRenamed("source", "t_source")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    beyond = F.lit(False)
    for name, value in _numbers().items():
        beyond = beyond | (value > F.col(f"{name}_upper"))
    beyond = beyond | (_numbers()["length"] < F.col("length_lower"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~F.coalesce(beyond, F.lit(False))).alias("kept"))
