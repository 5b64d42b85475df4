import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from affinia.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LONG = "A" * 45 + "é"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(rows, min_chars=40, min_documents=5):
    number, holder = Counter(), {}
    rank = lambda i: float("-inf") if i is None else i
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                number[k] += 1
                holder[k] = max(holder.get(k, float("-inf")), rank(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and number[key(x)] >= min_documents and holder[key(x)] != rank(i))]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_edge_cases_and_documents(spark):
    rows = [(None, None), (9001, ""), (9001, ""), (None, LONG + "\nx"), (9002, " " + LONG + "\t\nx\n" + LONG.lower()), (9003, LONG), (9003, LONG + "\n\n"), (-5, LONG), (9004, "É" * 50), (9005, "é" * 50), (9006, "\n".join(f"{k:050d}" for k in range(3000))), (9007, "\n".join(f"{k:050d}" for k in range(3000)))]
    rows += [(9008, "v" * 3_000_000), (9009, "\n" * 200_000 + "v" * 3_000_000)]
    rows += [(None, LONG + f"\n{k}") for k in range(6)]
    rows += [(100 + k, "w" * 39 + "\n" + "v" * 40) for k in range(6)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, line_dedup.digests(docs).collect())) == brute([tuple(r) for r in docs.collect()])


def test_clashing_columns_stay(spark):
    rows = [(k, "same line " * 5 + f"\n{k}", "a", k, "g", "d") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string, gone long, kept_lines string, doc string")
    out = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert set(docs.columns) < set(next(iter(out.values())).asDict())
    assert all(out[k].text == str(k) and out[k].n_dropped == 1 and out[k].gone == k and out[k].lines == "a" for k in range(5))
    assert out[5].text == rows[5][1] and out[5].n_dropped == 0


def test_empty_table_and_no_tables_left(spark):
    assert line_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_no_tables_left_after_a_failure(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.Runs, "keys", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.digests(spark.createDataFrame([(1, LONG)], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def batches(spark):
    for ids, keys in (([9, 8], [1, 2]), ([7], [2]), ([6], [3]), ([5, 4], [2, 1])):
        yield spark.createDataFrame([(i, k, k) for i, k in zip(ids, keys, strict=True)], "doc_id long, h1 long, h2 long")


def test_runs_find_what_is_new(spark):
    """A key is in the run of the batch that had it first, and in no other; later batches add to its count alone."""
    runs = line_dedup.Runs(spark)
    for batch, fresh in zip(batches(spark), ({1: 9, 2: 8}, {}, {3: 6}, {}), strict=True):
        before = {r.h1 for level in runs.runs for name in level for r in spark.table(name).collect()}
        runs.add(batch)
        now = Counter(r.h1 for level in runs.runs for name in level for r in spark.table(name).collect())
        assert set(now) - before == set(fresh) and set(now.values()) == {1}
    found = {r.h1: (r.documents, r.holder) for r in runs.keys().collect()}
    assert found == {1: (2, 9), 2: (3, 8), 3: (1, 6)}
    assert [len(x) for x in runs.runs] == [0, 0, 1]
    paths = list(runs.paths.values())
    runs.drop()
    assert paths and not any(os.path.exists(p) for p in paths)


def test_without_the_anti_join_runs_are_refused(spark, monkeypatch):
    frame = type(spark.range(0))
    real = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: self if how == "left_anti" else real(self, other, on, how))
    runs = line_dedup.Runs(spark)
    with pytest.raises(Exception, match="in two runs"):
        for batch in batches(spark):
            runs.add(batch)
        runs.keys().collect()
    runs.drop()


def test_hot_keys_and_others_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    rows = [(k, "one line that half of all documents have, all of them\n" * (k % 2) + f"line number {k // 6} of a smaller group of documents") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, line_dedup.digests(docs).collect())) == brute(rows)


def test_native_plan(spark):
    plan = line_dedup.line_keys(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 40)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [4, 6])
def test_threshold_of_documents(spark, n):
    docs = spark.createDataFrame([(k, LONG) for k in range(n)], "doc_id long, text string")
    dropped = sum(r.n_dropped for r in line_dedup.digests(docs).collect())
    assert dropped == (0 if n < 5 else n - 1)
