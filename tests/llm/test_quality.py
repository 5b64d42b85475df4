import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from affinia.llm import quality


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


ROWS = [
    (1, None, None, None),
    (2, "", None, "z"),
    (None, " a b\n a b\x0b\na b c d e f g h a b c d e f g h" * 3, "xx", None),
    (3, "q" * 30 + " " + "a b c d e f g h " * 40, "en", "s"),
    (3, "q" * 30 + " " + "a b c d e f g h " * 40, "en", "s"),
    (4, "\xa0 é | ü" * 50, "de", "s"),
    (5, "a b c d e f g h", "de", "s"),
    (6, "a b c d e f g h a", "de", "s"),
    (7, "x y " * 20_000, "en", "s"),
    (8, " ".join(map(str, range(30_000))), "en", "s"),
]


def test_measures_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").unionAll(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string"))
    docs = docs.withColumns({"words": F.lit(1), "lines": F.lit("x"), "n_words": F.lit(-1)})
    rows = quality.judge(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((d.doc_id, *measured(d.text)) for d in docs.collect())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_verdicts_follow_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_sketches_merge_by_adding(spark):
    m = quality.measures(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    parts = [quality.sketches(m.filter(F.col("doc_id") % 3 == k)) for k in range(3)]
    merged = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketches(m).collect()))


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 1000, 123_456_789, (1 << 62) + 12345])
def test_bins_are_narrow(spark, value):
    low = spark.range(1).select(quality.bin_floor(F.lit(value).cast("long"))).first()[0]
    assert low <= value <= low + low // 32


def test_empty_table_and_native_plan(spark):
    out = quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))
    assert out.collect() == []
    assert not re.search("Python|Pandas|MapInArrow", out._jdf.queryExecution().toString())


def test_each_measure_alone_rejects(spark):
    draw = random.Random(1)
    fresh = lambda n: [draw.choice("bcdfg") + str(draw.randrange(1000, 10_000)) for _ in range(n)]
    lines, run = [" ".join(fresh(7)) for _ in range(20)], fresh(13)
    repeated = " ".join([*run, *fresh(74), *run])
    planted = {
        "symbols": " ".join(fresh(100)) + " " + "#" * 20 + " ##",
        "lines": "\n".join([*lines, *lines[::-1]]),
        "repeats": repeated,
        "length": " ".join(w * 4 for w in fresh(100)),
    }
    rows = [(i, " ".join(fresh(100)), "en", "s") for i in range(300)] + [(1000 + i, t, "en", "s") for i, t in enumerate(planted.values())]
    # A source with 15 % of bad rows.
    rows += [(2000 + i, repeated if i % 20 < 3 else " ".join(fresh(100)), "en", "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = quality.thresholds(quality.sketches(quality.measures(docs))).filter("source = 's'").first()
    numbers = quality.measures(docs).select("doc_id", *[v.alias(k) for k, v in quality._numbers().items()])
    for r in numbers.filter("doc_id between 1000 and 1003").collect():
        assert [m for m in quality.MEASURES if not limits[f"{m}_lower"] <= r[m] <= limits[f"{m}_upper"]] == [list(planted)[r.doc_id - 1000]]
    judged = quality.judge(docs).collect()
    assert not any(r.base_failed for r in judged)
    assert {r.doc_id for r in judged if not r.kept} == {1000 + i for i in range(4)} | {2000 + i for i in range(300) if i % 20 < 3}
