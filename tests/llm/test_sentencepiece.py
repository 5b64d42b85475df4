import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from affinia.llm import sentencepiece_codec as codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", "a", " ", "  ", " a", "a ", "aaaaaaaaaaa", "\n", "\t x", "▁", "a▁b", "<s>", "</s>[INST]", "<0x0A>", "日本語のテキスト", "👍🏽 hi", "\x00a", "é́", "    x   y", "ﬁ", "\r\n", "<unk>", "x\u0085y", "a" * 5000, "thion" * 800]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n):
    rng = random.Random(1)
    return CASES + ["".join(rng.choice("ab e\n▁<s>é日👍thion0\\/ \x01") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(library):
    table = codec.table(MODEL)
    for t in texts(3000):
        ids = library.encode(t)
        assert table.encode(t) == ids
        assert table.decode(ids) == library.decode(ids)
        assert table.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_decoding_of_any_ids(library):
    table, rng = codec.table(MODEL), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(9))]
        assert table.decode(ids) == library.decode(ids)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(codec, "REMEMBERED", 50)
    monkeypatch.setattr(codec, "REMEMBERED_PAIRS", 50)
    table = codec.PrefixTable(MODEL)
    fresh = codec.table(MODEL)
    for t in texts(300):
        assert table.digest(t) == fresh.digest(t)
    assert len(table.known) <= 50 and len(table.pairs) <= 50


def test_table_operators(spark, library):
    rows = [(1, None, 5), (1, "a b", 6), (None, "é", 7), (2, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = codec.encode_documents(docs, MODEL)
    assert sorted(out.columns) == ["doc_id", "ids", "text"]
    assert [list(r.ids) for r in out.collect()] == [library.encode(t or "") for _, t, _ in rows]
    back = codec.decode_ids(out.withColumnRenamed("text", "was"), MODEL).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in rows]
    digests = codec.round_trip_digests(docs, MODEL).collect()
    assert [(r.doc_id, r.n_tokens) for r in digests] == [(i, len(library.encode(t or ""))) for i, t, _ in rows]
    assert codec.round_trip_digests(docs.limit(0), MODEL).collect() == []
