import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinia.llm import simple8b, token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(12))
def test_codec_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 9000)) if seed % 3 else int(rng.integers(0, 70))
    bits = rng.integers(0, 65 if seed % 2 else 17, size=n) if seed % 5 else np.zeros(n, int)
    numbers = np.array([int(rng.integers(0, 1 << 62)) * 4 + 3 >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
    words, offsets, escaped = simple8b.encode(numbers)
    assert (simple8b.decode(words, escaped) == numbers).all()
    assert len(words) <= n
    for k in range(len(offsets)):
        assert (simple8b.decode_block(words, offsets, escaped, k) == numbers[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_words_are_packed():
    assert len(simple8b.encode(np.zeros(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(30, 1 << 19, np.uint64))[0]) == 10
    words, _, escaped = simple8b.encode(np.array([1 << 63, (1 << 60) - 1], np.uint64))
    assert len(words) == 2 and escaped.tolist() == [1 << 63]


def test_encoder_equals_the_library():
    library, encode = Tokenizer.from_file(FILE), token_files.encoder(FILE)
    assert encode.pieces
    for t in ["", " a", "a  b", "it's we'll", "\n\n x \n", "é日本👍", "a <|endoftext|> b", "1234 x56", "\x1c\x85\xa0 z", "ab" * 3000, " " * 50]:
        assert encode(t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [1, 100, 1_000_000])
def test_pieces_of_random_texts(monkeypatch, remembered):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    rng = random.Random(remembered)
    letters = [*" \n\t\r\x0b\x1c\x85\xa0\u2009\u3000\u0301aB9'sé日👍.,!-<|>", "<|endoftext|>", "'s", "'ll", "  ", " the", " word,"]
    library, encode = Tokenizer.from_file(FILE), token_files.Encoder(FILE)
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(50)]
        ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, number = encode.encode(np.frombuffer("".join(texts).encode(), np.uint8), ends)
        parts = np.split(ids, np.cumsum(number)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_go_to_the_library_whole():
    file = public_tokenizers.path("word_bpe_49k.json")
    encode = token_files.encoder(file)
    assert not encode.pieces
    assert encode("Hello there") == Tokenizer.from_file(file).encode("Hello there", add_special_tokens=False).ids


def test_long_white_space_and_clashing_names(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, "x" * 300_000), (None, "a"), (None, "b"), (None, "a")]
    docs = spark.createDataFrame([(*r, 1, "s", 7) for r in rows], "doc_id long, text string, start int, file string, text_hash int")
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.checksums(docs, FILE).collect()}
    library = Tokenizer.from_file(FILE)
    assert got == {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows)}


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_files_hold_all_documents(spark, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    rows = [(5000, None), (5001, ""), (5002, "a <|endoftext|> b"), (None, "x"), (5003, "  a\n\n b  "), (5003, "a"), (5004, "word " * 50_000)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, token_files.checksums(docs, FILE).collect()), key=lambda r: r[1])
    library, start, expected = Tokenizer.from_file(FILE), 0, []
    order = docs.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h", "text").collect()
    for i, t in ((r.doc_id, r.text or "") for r in order):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_empty_table(spark):
    assert token_files.checksums(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
