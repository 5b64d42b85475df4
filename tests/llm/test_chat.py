import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinia.llm import chat

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["<", "s>", "/", "</s>", "<s>", "\\", "[INST]", "[/INST]", "a", "\n", "|im_end|>", "<<SYS>>", "é"]


def test_template_is_reversible():
    rng = random.Random(2)
    for _ in range(5000):
        text, role = ("".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.parse(chat.format_turn(role, text) + chat.format_turn("assistant", role)) == [(role, text), ("assistant", role)]


def brute(rows):
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((-(1 << 63) if turn is None else turn, role or "", text or ""))
    out = []
    for c, turns in groups.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(r, t)) for _, r, t in turns)))
    return sorted(out, key=repr)


EXTRA = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (90000, None, None, None), (90000, 1, "assistant", None), (None, 1, "user", "x"),
    (90001, 1, "assistant", "dup"), (90001, 1, "assistant", "dup"), (90002, 0, "user", "long " * 60_000), (90002, 1, "assistant", "y"), (90003, 0, "odd\nrole<s>", "z"),
]


@pytest.mark.parametrize("size", [1 << 16, 100])
def test_digests_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "PACK_TOKENS", size)
    shared = [(91000 + k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 2 else f"own {k % 5}") for k in range(40) for t in range(4)]
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").unionAll(spark.createDataFrame(EXTRA + shared, "conv_id long, turn long, role string, text string"))
    table = table.withColumns({"path": F.lit(1), "turns": F.lit("x"), "node": F.lit(0)})
    got = sorted(map(tuple, chat.formatted_digests(table, FILE).collect()), key=repr)
    assert got == brute([tuple(r)[:4] for r in table.collect()])


def test_shared_tokens_are_emitted_once():
    library, tree = Tokenizer.from_file(FILE), chat.Tree()
    a, b, c, d = ("user", "hi there"), ("assistant", "yes, é日"), ("assistant", ""), ("user", "more <s>")
    ids = {p: library.encode(p, add_special_tokens=False).ids for t in (a, b, c, d) for p in chat.formatted_parts(*t)}
    for i, turns in enumerate(([a, b], [a, b], [a, b, d], [a, c])):
        tree.add(i, turns, ids)
    row = tree.row()
    said = [i for t in (a, b, d, c) for p in chat.formatted_parts(*t) for i in ids[p]]
    assert row["ids"] == said and len(row["nodes"]) == 4
    first, yes, more, zero = row["nodes"]
    assert [n["position"] for n in row["nodes"]] == [0, first["tokens"], first["tokens"] + yes["tokens"], first["tokens"]]
    assert chat.position_ids(row) == [*range(zero["first"]), *range(first["tokens"], first["tokens"] + zero["tokens"])]
    assert more["attends"] == [0, zero["first"]]
    assert zero["attends"] == [0, first["tokens"], zero["first"], zero["first"] + zero["tokens"]]
    read = list(chat.conversations_of(row, chat.codec(FILE).decode))
    assert [f for _, f, _ in read][3] == chat.format_turn(*a) + chat.format_turn(*c)
    assert [x for _, _, x in read] == [["yes, é日"], ["yes, é日"], ["yes, é日"], [""]]


def test_packs_end_where_nothing_is_shared(spark, monkeypatch):
    """Trees longer than a pack stay whole up to OVERLONG packs; longer ones repeat what they share."""
    monkeypatch.setattr(chat, "PACK_TOKENS", 200)
    rows = [(g * 1000 + k, t, "user", f"first of {g}" if t == 0 else f"word {k} " * 3) for g in range(6) for k in range(20 if g else 200) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    packs = chat.pack(chat.assemble(table), FILE).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    decode = chat.codec(FILE).decode
    starts = Counter(decode(p.ids[n.first : n.first + n.tokens]) for p in packs for n in p.nodes if n.parent < 0)
    assert all(starts[chat.format_turn("user", f"first of {g}")] == 1 for g in range(1, 6)) and starts[chat.format_turn("user", "first of 0")] > 1


def test_empty_table(spark):
    assert chat.formatted_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), FILE).collect() == []
