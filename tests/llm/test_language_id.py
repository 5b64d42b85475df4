import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_folds(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", language_id.fold("id").alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def test_labels_outside_the_folds_are_not_seen(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(language_id.fold() == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("none"))
    a, b = (sorted(map(tuple, language_id.held_out_predictions(d).collect())) for d in (docs, other))
    assert a == b


def test_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(None, None, "en"), (900, "", "en"), (901, "123 _ !\n", "en"), (902, "the " * 60_000, None), (903, "the thing", None), (903, "the thing", None), (904, "日本", None)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.held_out_predictions(docs.unionAll(extra).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(3)})).filter("doc_id is null or doc_id >= 900").collect()
    found = {r.doc_id: r for r in out}
    assert len(out) == 7 and all(found[k].lang_pred == "und" and found[k].score == 0 for k in (None, 900, 901))
    assert found[902].lang_pred == found[903].lang_pred == "en" and found[904].lang_pred in {"en", "de", "fr", "es"}


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, None, "en")]])
def test_nothing_to_learn_from(spark, rows):
    out = language_id.held_out_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in out] == ["und"] * len(rows)


def test_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (6, 24)).astype(np.uint8), rng.integers(0, 3, 6)
    net = language_id.train(x, y, ["a", "b", "c"])
    net.training = True
    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    grads = language_id._gradients(net, x, y, language_id._reach())

    def loss():
        p = language_id.softmax(net.logits(x)[0])
        return -np.log(p[np.arange(6), y]).mean()

    for name, at in (("out", (3, 1)), ("out_bias", (2,)), ("bias", (5,)), ("filters", (1, 4)), ("embedding", (int(x[0, 3]), 2))):
        w = getattr(net, name)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_windows_cover_whole_texts():
    """Every run of bytes as long as the widest filter lies in a window, once."""
    w, over = language_id.WINDOW, max(language_id.WIDTHS) - 1
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (0, 1, over, w - 1, w, w + 1, 2 * w - over, 2 * w - over + 1, 1000)]
    windows, number = language_id.windows_of(texts)
    assert number.tolist() == [1, 1, 1, 1, 1, 2, 2, 3, 6]
    at = 0
    for t, n in zip(texts, number.tolist(), strict=True):
        own = [x.tobytes() for x in windows[at : at + n]]
        assert own[0] + b"".join(x[over:] for x in own[1:]) == t.ljust(w + (n - 1) * (w - over), b"\0")
        assert all(a[-over:] == b[:over] for a, b in zip(own, own[1:], strict=False))
        at += n


def brute(net, text):
    """Mean probabilities of a text by plain loops over windows, places, filters and bytes."""
    step, widest = language_id.WINDOW - max(language_id.WIDTHS) + 1, max(language_id.WIDTHS)
    total = np.zeros(len(net.languages))
    starts = [0, *range(step, max(step, len(text) - widest + 1), step)]
    for at in starts:
        window = [*text[at : at + language_id.WINDOW]]
        window += [0] * (language_id.WINDOW + widest - len(window))
        pooled = []
        for f in range(len(net.bias)):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            best = max(sum(float(net.embedding[window[p + k]] @ net.filters[k * language_id.EMBEDDING : (k + 1) * language_id.EMBEDDING, f]) for k in range(width)) for p in range(language_id.WINDOW))
            pooled.append(max(0.0, best + float(net.bias[f])))
        logits = np.array(pooled) @ net.out + net.out_bias
        e = np.exp(logits - logits.max())
        total += e / e.sum()
    return total / len(starts)


def test_predictions_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 30)
    monkeypatch.setattr(language_id, "FILTERS", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    net = language_id.fit(docs)
    for row in docs.filter("length(text) between 20 and 900").orderBy("doc_id").limit(6).collect():
        text = row["text"].encode()
        windows, number = language_id.windows_of([text])
        assert len(windows) == number[0]
        assert net.probabilities(windows).mean(axis=0) == pytest.approx(brute(net, text), abs=1e-4)


def test_ties_take_the_first_language(spark):
    """A network without any weight finds all languages equal."""
    zero = language_id.Network(["aa", "bb"], np.zeros((256, language_id.EMBEDDING), np.float32), np.zeros((max(language_id.WIDTHS) * language_id.EMBEDDING, len(language_id.WIDTHS) * language_id.FILTERS), np.float32), np.zeros(len(language_id.WIDTHS) * language_id.FILTERS, np.float32), np.zeros((len(language_id.WIDTHS) * language_id.FILTERS, 2), np.float32), np.zeros(2, np.float32))
    out = language_id.predict(spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "x " * 500)], "doc_id long, text string"), zero).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("aa", 0.5)] * 3


def test_all_languages_are_learned(spark, monkeypatch):
    """With more languages than rows are allowed, one row of each is taken."""
    monkeypatch.setattr(language_id, "ALL_ROWS", 10)
    monkeypatch.setattr(language_id, "STEPS", 5)
    rows = [(k, f"text number {k}", f"l{k % 300:03d}") for k in range(600)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == [f"l{k:03d}" for k in range(300)]
