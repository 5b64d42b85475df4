"""Conversations formatted and tokenized into prefix trees.

Conversations are put in the order of their turns, so those that share initial turns stand side by
side. Walking along that order is walking a prefix tree depth first: a turn that the conversation
shares with the one before it is there already, the others are emitted. Each pack (one training
sequence) holds the token ids of its turns once, and for each turn the node above it, its place in the
pack, the position id of its first token counted along its own conversation, which of its tokens are
learned, and the intervals of the pack that it attends to: its ancestors and itself. Once it is
PACK_TOKENS long, a pack ends where a conversation shares nothing with the one before; only a tree that
goes on past OVERLONG times that, and one that lies across two partitions of the sort, is cut, and the
turns shared there are emitted once more. So neither a first turn that very many conversations share
nor a long run of equal ones has to fit into one task.

The template's marks, and the text between them, are tokenized apart, so that tokens are shared, or
learned, as a whole. Control strings inside texts are broken by a backslash, and backslashes doubled, so
the template's own marks are the only ones, and texts come back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia import storage
from affinia.llm import token_files
from affinia.llm.memory import map_batches

#: Strings that tokenizers treat as control tokens; fixed values. A turn is OPEN role \n text CLOSE.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, CLOSE = "<s>", "</s>"
#: The role whose texts are learned, and the tokens after which a pack ends when it can, and how many times as many it may have.
LEARNED, PACK_TOKENS, OVERLONG = "assistant", 1 << 16, 4
#: Characters after which conversations read so far are tokenized, in one call.
TOGETHER = 1 << 20

_breaks = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_back = re.compile(r"\\(\\?)")

NODE = "struct<parent: int, first: int, tokens: int, position: int, learned: boolean, learn_first: int, learn_tokens: int, attends: array<int>>"
PACK = f"ids array<int>, nodes array<{NODE}>, conversations array<struct<conv_id: long, node: int>>"


def escape(text: str) -> str:
    """The text with doubled backslashes, and a backslash after the first character of each control string."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _breaks.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """What escape() was given."""
    return _back.sub(r"\1", text)


def formatted_parts(role: str, text: str) -> tuple[str, str, str]:
    """One turn under the template: its opening mark and role, its text, its closing mark."""
    return f"{OPEN}{quote(role, safe='')}\n", escape(text), CLOSE


def format_turn(role: str, text: str) -> str:
    """One turn under the template."""
    return "".join(formatted_parts(role, text))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unquote(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return turns


def assemble(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) in the order of turn; equal turns stand in order of role and text.

    A null role or text is empty, a null turn comes first, rows with a null conv_id are one conversation.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = conversations.select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


class Codec:
    """Token ids of texts and texts of token ids, for a byte-level vocabulary."""

    def __init__(self, tokenizer_file: str):
        self.encoder = token_files.encoder(tokenizer_file)
        if not self.encoder.pieces:
            raise ValueError("only a byte-level vocabulary gives texts back unchanged")
        # Byte-level vocabularies write bytes without a printable character as characters from U+0100 on.
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        library = self.encoder.library
        tokens = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
        self.bytes_of = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        data = [t.encode() for t in texts]
        ids, number = self.encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        ends = np.cumsum(number).tolist()
        ids = ids.tolist()
        return [ids[end - n : end] for end, n in zip(ends, number.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for."""
        return b"".join([self.bytes_of[i] for i in ids]).decode()


@lru_cache(maxsize=2)
def codec(tokenizer_file: str) -> Codec:
    """The codec of a vocabulary file, made once in each worker."""
    return Codec(tokenizer_file)


def pack(conversations: DataFrame, tokenizer_file: str) -> DataFrame:
    """The packs (columns PACK) of all conversations, one row each, from a table like assemble() gives."""
    path = F.transform("turns", lambda t: F.xxhash64(t.role, t.text))  # only orders; turns are compared themselves
    ordered = conversations.withColumn("path", path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("nodes", pa.list_(pa.struct([(n, pa.bool_() if n == "learned" else pa.int32()) for n in ("parent", "first", "tokens", "position", "learned", "learn_first", "learn_tokens")] + [("attends", pa.list_(pa.int32()))]))), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, use = Tree(), codec(tokenizer_file)
        for batch in batches:
            for some in _groups(batch):
                parts = {p: None for turn in {t: None for _, turns in some for t in turns} for p in formatted_parts(*turn)}
                ids = dict(zip(parts, use.encode(list(parts)), strict=True))
                for conv_id, turns in some:
                    long = max(tree.length, len(tree.conversations)) // PACK_TOKENS
                    if long >= OVERLONG or (long and not tree.shares(turns)):
                        yield pa.RecordBatch.from_pylist([tree.row()], schema)
                        tree = Tree()
                    tree.add(conv_id, turns, ids)
        if tree.conversations:
            yield pa.RecordBatch.from_pylist([tree.row()], schema)
        use.encoder.forget()

    return map_batches(ordered.select("conv_id", "turns"), packs, PACK)


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, list[tuple[str, str]]]]]:
    """Conversations of a batch, as conv_id and turns, in groups of at least TOGETHER characters but for the last."""
    conv_ids, turns = batch.column(0).to_pylist(), batch.column(1)
    roles, texts = (turns.flatten().field(name) for name in ("role", "text"))
    sizes = turns.value_lengths().to_numpy().tolist()
    some, chars, at = [], 0, 0
    for conv_id, n in zip(conv_ids, sizes, strict=True):
        some.append((conv_id, list(zip(roles.slice(at, n).to_pylist(), texts.slice(at, n).to_pylist(), strict=True))))
        at += n
        chars += sum(len(text) for _, text in some[-1][1])
        if chars >= TOGETHER:
            yield some
            some, chars = [], 0
    if some:
        yield some


class Tree:
    """A pack under construction; conversations come in an order that keeps shared beginnings together."""

    def __init__(self):
        self.ids: list[int] = []
        self.nodes: list[dict] = []
        self.conversations: list[dict] = []
        #: Turns of the conversation added last, and their nodes.
        self.open: list[tuple[tuple[str, str], int]] = []

    @property
    def length(self) -> int:
        return len(self.ids)

    def shares(self, turns: list[tuple[str, str]]) -> bool:
        """Whether a conversation begins as the one added last does."""
        return bool(turns and self.open) and self.open[0][0] == turns[0]

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], ids: dict[str, list[int]]) -> None:
        """Emits the turns that the last conversation doesn't share; ids has those of each formatted part."""
        shared = 0
        while shared < min(len(turns), len(self.open)) and self.open[shared][0] == turns[shared]:
            shared += 1
        del self.open[shared:]
        for role, text in turns[shared:]:
            above = self.open[-1][1] if self.open else -1
            head, body, tail = (ids[p] for p in formatted_parts(role, text))
            first, size = self.length, len(head) + len(body) + len(tail)
            last = self.nodes[above] if above >= 0 else {"position": 0, "tokens": 0, "attends": []}
            attends = list(last["attends"])
            if attends and attends[-1] == first:  # intervals are merged where they touch
                attends[-1] += size
            else:
                attends += [first, first + size]
            learned = role == LEARNED
            self.nodes.append({"parent": above, "first": first, "tokens": size, "position": last["position"] + last["tokens"], "learned": learned, "learn_first": first + len(head), "learn_tokens": len(body) if learned else 0, "attends": attends})
            self.open.append(((role, text), len(self.nodes) - 1))
            for part in (head, body, tail):
                self.ids.extend(part)
        self.conversations.append({"conv_id": conv_id, "node": self.open[-1][1] if self.open else -1})

    def row(self) -> dict:
        return {"ids": self.ids, "nodes": self.nodes, "conversations": self.conversations}


def position_ids(row: dict) -> list[int]:
    """The position id of each token of a pack."""
    return [n["position"] + k for n in row["nodes"] for k in range(n["tokens"])]


def conversations_of(row: dict, decode) -> Iterator[tuple[int | None, str, list[str]]]:
    """From a pack: conv_id, the formatted conversation as its last turn attends to it, and the learned texts of it.

    Turns are tokenized apart, so each is decoded once, and intervals, which part the pack between turns, are cut from the text of all.
    """
    ids, nodes = row["ids"], row["nodes"]
    texts = [decode(ids[n["first"] : n["first"] + n["tokens"]]) for n in nodes]
    whole = "".join(texts)
    place = dict(zip([n["first"] for n in nodes] + [len(ids)], accumulate(map(len, texts), initial=0), strict=True))
    said = [decode(ids[n["learn_first"] : n["learn_first"] + n["learn_tokens"]]) if n["learned"] else None for n in nodes]
    for c in row["conversations"]:
        learned: list[str] = []
        at = c["node"]
        attends = nodes[at]["attends"] if at >= 0 else []
        while at >= 0:
            if said[at] is not None:
                learned.append(said[at])
            at = nodes[at]["parent"]
        yield c["conv_id"], "".join([whole[place[attends[k]] : place[attends[k + 1]]] for k in range(0, len(attends), 2)]), learned[::-1]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Packs as Tree.row() gives them, one at a time; numbers leave their arrays together."""
    for k in range(batch.num_rows):
        ids, nodes, conversations = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "nodes", "conversations"))
        table = {f.name: column for f, column in zip(nodes.type, nodes.flatten(), strict=True)}
        attends = table.pop("attends")
        flat, size = attends.flatten().to_numpy().tolist(), attends.value_lengths().to_numpy().tolist()
        ends = list(accumulate(size))
        columns = [table[n].to_numpy(zero_copy_only=False).tolist() for n in table]
        yield {
            "ids": ids.to_numpy().tolist(),
            "nodes": [dict(zip(table, values)) | {"attends": flat[end - n : end]} for *values, end, n in zip(*columns, ends, size, strict=True)],
            "conversations": conversations.to_pylist(),
        }


def _digests(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[pa.RecordBatch]:
    decode = codec(tokenizer_file).decode
    for batch in batches:
        for row in _rows(batch):
            out: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv_id, formatted, learned in conversations_of(row, decode):
                turns = parse(formatted)
                loss = "".join(unescape(x) for x in learned)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                for column, value in zip(out.values(), (conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def formatted_digests(conversations: DataFrame, tokenizer_file: str) -> DataFrame:
    """Packs all conversations, stores the packs, reads them back: one row a conversation.

    Columns conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (the learned texts, unescaped, joined), formatted_chars. A null role or text is an empty
    one and a turn of its own; a null turn comes first; equal turns, and repeated rows, all stay, in
    order of role and text; rows with a null conv_id are one conversation. Texts of any length are taken
    whole, but a conversation must fit into a task. Without rows there are none. Columns besides conv_id,
    turn, role and text are not read.
    """
    packs = storage.materialize(pack(assemble(conversations), tokenizer_file), "packs")
    return map_batches(packs, lambda batches: _digests(batches, tokenizer_file), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
