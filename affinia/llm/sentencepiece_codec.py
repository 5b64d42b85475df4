"""SentencePiece (BPE with byte fallback) encoding and decoding in linear time.

For merge-type vocabularies every prefix of a text has one possible last token. The encoder
walks the text once, takes the tokens that end at each place from an Aho-Corasick automaton,
and keeps the one that is compatible with the last token of the prefix it leaves; ids are then
recovered from the end backwards. Two tokens are compatible if merging their joined text gives
just these two. No priority queue and no repeated merging over the text is needed, so a text
without any space costs as much a character as any other.

No piece holds a space mark after another character (checked when the model is loaded), so
texts fall apart into runs of marks with the characters up to the next mark; the results of
short runs are remembered, within a bound.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.memory import map_batches

MARK = "▁"
UNKNOWN = -1
#: Runs remembered by each worker, and the longest run that is remembered.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Compatible and incompatible pairs remembered by each worker.
REMEMBERED_PAIRS = 250_000


class PrefixTable:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown_id = sp.unk_id()
        plain = [i for i in range(size) if not (i in self.byte_of or i in self.silent or i == self.unknown_id or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain)
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # What the library does to a text before it looks for pieces; this encoder handles the plain case.
        if sp.normalize("a  b") != f"{MARK}a{MARK}{MARK}b" or sp.normalize("ÄＡ\n") != f"{MARK}ÄＡ\n":
            raise ValueError("the model normalizes texts; only identity normalization with a leading space is supported")
        self.digits = [str(i) for i in range(size)]
        self.said = [" ⁇ " if i == self.unknown_id else "" if i in self.silent else x.replace(MARK, " ") for i, x in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        #: Ids of runs as joined digits; only of runs that decode to themselves.
        self.known: dict[str, str] = {}
        self.known_before: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined text of two tokens is encoded as these two; an unknown character joins nothing."""
        if left == UNKNOWN or right == UNKNOWN:
            return True
        found = self.pairs.get(left * len(self.pieces) + right)
        if found is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[left * len(self.pieces) + right] = self.merged(a + b) == [a, b]
        return found

    def encode_run(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks, by the table of its prefixes' last tokens."""
        n, pairs, vocabulary = len(text), self.pairs, len(self.pieces)
        last, length = [UNKNOWN] * (n + 1), [1] * (n + 1)
        at = 0
        # Matches come by their end, the longest first; a character outside the vocabulary ends none.
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if end == at:  # the prefix's token is known
                continue
            start = end - size
            if start and (left := last[start]) >= 0:
                fits = pairs.get(left * vocabulary + token)
                if not (self.compatible(left, token) if fits is None else fits):
                    continue
            last[end], length[end], at = token, size, end
        ids: list[int] = []
        while n:
            if last[n] == UNKNOWN:
                ids.extend(reversed(self._unknown(text[n - 1])))
            else:
                ids.append(last[n])
            n -= length[n]
        ids.reverse()
        return ids

    def _unknown(self, character: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown_id]
        return [self.byte_id[b] for b in character.encode()]

    def split(self, text: str) -> list[str]:
        """The text as the library sees it (a leading mark, marks for spaces), cut where no piece can reach across."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.runs.findall(marked) if self.splits else [marked]

    def encode(self, text: str) -> list[int]:
        """As the library's encode(text)."""
        return [i for run in self.split(text) for i in self.encode_run(run)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): bytes that are no UTF-8 become U+FFFD, one leading space goes."""
        first = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        if first is None:
            return ""
        text = self._decode_inner(ids)
        return text[1:] if self.pieces[ids[first]].startswith(MARK) else text

    def _decode_inner(self, ids: list[int]) -> str:
        """Text of ids that follow other ids: a leading space stays."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.said[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(self.said[i])
        return "".join(out) + _utf8(bytes(held))

    def forget(self) -> None:
        """Drops the runs that are remembered: a worker that goes on to other work doesn't keep them."""
        self.known, self.known_before = {}, {}

    def run(self, text: str, others: dict[str, str]) -> str:
        """A run's ids as joined digits; into others goes what its ids decode to, if that isn't the run."""
        found = self.known_before.get(text)
        if found is None:
            ids = self.encode_run(text)
            found = ",".join([self.digits[i] for i in ids])
            decoded = self._decode_inner(ids)
            if decoded != text.replace(MARK, " "):
                others[text] = decoded
                return found
        if len(text) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:  # runs used since the last turn stay for another one
                self.known, self.known_before = {}, self.known
            self.known[text] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        known, run, others = self.known.get, self.run, {}
        runs = self.split(text)
        joined = ",".join([known(x) or run(x, others) for x in runs])
        decoded = "".join([others.get(x, x) for x in runs] if others else runs).replace(MARK, " ")[1:]
        return joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(data: bytes) -> str:
    """UTF-8 decoding with one U+FFFD for each byte that starts no character."""
    out, i = [], 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4 if data[i] >> 3 == 30 else 1
        try:
            out.append(data[i : i + size].decode())
            i += size
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def table(model_file: str) -> PrefixTable:
    """The encoder of a model file, made once in each worker."""
    gc.set_threshold(200_000, 50, 100)  # what is remembered holds no cycles
    return PrefixTable(model_file)


def encode_documents(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>): the tokens of each text. A null or empty text has none; other columns stay.

    A column already called ``ids`` is replaced. Long texts are taken whole, and no rows give none.
    """

    def encoded(batches):
        codec = table(model_file)
        for batch in batches:
            ids = pa.array([codec.encode(x.as_py() or "") for x in batch.column(text)], pa.list_(pa.int32()))
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], [*keep, "ids"])

    schema = df.drop("ids").withColumn("ids", F.array().cast("array<int>")).schema
    return map_batches(df, encoded, schema)


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text that each row's ids stand for; null ids give an empty text.

    A column already called as ``into`` says is replaced; no rows give none.
    """

    def decoded(batches):
        codec = table(model_file)
        for batch in batches:
            texts = pa.array([codec.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())
            keep = [c for c in batch.schema.names if c != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, into])

    return map_batches(df, decoded, df.drop(into).withColumn(into, F.lit("")).schema)


def round_trip_digests(df: DataFrame, model_file: str) -> DataFrame:
    """Encodes each text, decodes its ids again, and returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle. A null or empty text has no tokens and decodes to an empty text; texts of
    any length are taken whole, in time that grows with their length; repeated rows and null doc_ids stay
    as they are; an empty table gives no rows; columns besides doc_id and text are not read.
    """

    def digests(batches):
        codec = table(model_file)
        for batch in batches:
            rows = [codec.digest(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    return map_batches(df.select(F.col("doc_id").cast("long"), "text"), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
