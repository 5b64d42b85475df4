import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest


import corpus_pipeline
from affinia.llm import language_id
from tests.llm import test_decontaminate, test_line_dedup, test_sentencepiece, test_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output as rows."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    assert all(after.columns == COLUMNS for _, after in stages[:-1])


def test_language_stage_keeps_what_it_knows(stages):
    before, after = stages[0]
    network = language_id.fit(before.filter(language_id.fold() != 2))
    judged = {r.doc_id: r for r in language_id.predict(before, network).collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE} and len(kept) >= 0.95 * len(judged)


def test_line_stage(stages):
    before, after = stages[1]
    expected = test_line_dedup.brute([(r.doc_id, r.text) for r in before.collect()])
    import hashlib

    got = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars == len(r.text)) for r in after.collect()}
    assert got == {(i, h, True) for i, _, _, h in expected}


def long_lines(text):
    return [k for k in map(test_line_dedup.key, (text or "").split("\n")) if len(k) >= 40]


def test_near_duplicate_stage(stages):
    before, after = stages[2]
    rows = before.collect()
    expected = test_simhash.brute([(r.doc_id, r.text) for r in rows])
    texts, groups = {r.doc_id: r.text for r in rows}, {}
    for i, _, c in expected:
        groups.setdefault(c, []).append(i)
    assert {r.doc_id for r in after.collect()} == {max(g, key=lambda i: (len(long_lines(texts[i])), i)) for g in groups.values()} and len(expected) > after.count()


def frequent_lines(rows):
    number = Counter(k for _, t in rows for k in set(long_lines(t)))
    return {k for k, n in number.items() if n >= 5}


def test_no_shared_line_is_lost_with_its_copies(spark, stages):
    """Each line that stage 2 takes from some documents is still in a document after stage 3."""
    rows = [(r.doc_id, r.text) for r in stages[1][0].collect()]
    kept = {k for r in stages[2][1].collect() for k in long_lines(r.text)}
    assert frequent_lines(rows) and frequent_lines(rows) <= kept


@pytest.mark.parametrize("holder", [50, 5])
def test_the_holder_of_a_line_stays(spark, holder):
    """Nine documents share a line with one that is a copy of another but for it; the copy has a larger or a smaller doc_id."""
    line = "a line of a licence that nine other documents have as well, word for word"
    body = " ".join(f"word{k}" for k in range(4000))
    rows = [(100 - holder + 7, body), (holder, body + "\n" + line)] if holder == 50 else [(99, body), (holder, body + "\n" + line)]
    rows += [(k - 20, " ".join(f"other{k}x{j}" for j in range(200)) + "\n" + line) for k in range(9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
    cleaned = corpus_pipeline.deduplicate_lines(spark, docs, SF)
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, cleaned, SF).collect()}
    assert sum(line in t for t in out.values()) == 1 and line in out[holder] and len(out) == 10


def test_decontamination_stage(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = test_decontaminate.brute([(r.doc_id, r.text) for r in before.collect()], items, 10)
    assert {r.doc_id for r in after.collect()} == {r[0] for r in expected if not r[-1]} and any(r[-1] for r in expected)


def test_encoding_stage(stages):
    before, after = stages[4]
    table = test_sentencepiece.codec.table(test_sentencepiece.MODEL)
    assert sorted(map(tuple, after.collect())) == sorted((r.doc_id, *table.digest(r.text)) for r in before.collect())


def test_run_equals_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows_go_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "12 34", "en", "s", 5), (2, "the thing and the other thing of the day " * 3, "en", "s", 99), (3, "the thing and the other thing of the day " * 3, None, None, None), (None, "der die das und nicht " * 9, "de", "s", 1)]
    docs = spark.createDataFrame([(*r, "a", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string, score double")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [3, None]


def test_rest_works_without_these_folders(tmp_path):
    """A copy of the repository without this subpackage still imports and has its other queries."""
    root = Path(corpus_pipeline.__file__).parent
    for p in root.rglob("*.py"):
        part = p.relative_to(root)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(p.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and "blocking_or_join" in said.stdout and not re.search(r"op\d+_|pipeline", said.stdout)


