"""Token ids of all documents, in ascending order of doc_id, in files of Simple-8b words.

A token file is a set of segments, each with whole documents: their ids and lengths, the packed
words, and the offsets of blocks in them. Files are numbered in the order of the documents, so the
place of any id follows from the files' totals. Files are written through Spark (Parquet holds the
segments), which commits each once, on any file system.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinia import storage
from affinia.llm import simple8b, words
from affinia.llm.memory import map_batches

#: Ids after which a segment ends with the current document.
SEGMENT_IDS = 1 << 20
SEGMENT = "file int, start long, doc_ids array<long>, lengths array<long>, words binary, blocks binary, escaped binary"
#: Bytes of text cut and encoded at a time; a longer text is taken whole.
SLICE_BYTES = 4 << 20
#: Pieces and ids of pieces remembered by each worker, the longest piece (in bytes) that is, and pieces encoded in one call.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_BYTES, TOGETHER = 1_000_000, 8_000_000, 64, 2000


#: ASCII marks that never belong to a token with a letter before them; the apostrophe may.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def cuts(data: np.ndarray, marks: str = MARKS) -> np.ndarray:
    """Places at which byte-level words end whatever stands around them.

    Before a space or line feed after no white space, for which printable ASCII and characters of two
    bytes from U+00C0 on are taken; and before one of marks after an ASCII letter. No token reaches
    across such a place, and no rule of the pre-tokenizer looks across it to the left.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    opens = (data[1:] == 0x20) | (data[1:] == 0x0A)
    before = data[:-1]
    shown = (before > 0x20) & (before < 0x7F)
    shown[1:] |= (before[1:] >= 0x80) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in marks]] = True
    letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A)
    return np.flatnonzero((opens & shown) | (mark[data[1:]] & letter)) + 1


class Encoder:
    """Ids as the tokenizers library gives for a vocabulary file, without added special tokens.

    All ids come from the library. With a byte-level pre-tokenizer texts are cut where no token can
    reach across (``cuts``), and each distinct piece is encoded once, many in a call; what is
    remembered is bounded, and what is forgotten is encoded again. Other vocabularies have their texts encoded whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(file)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(self.library.to_str())
        before = spec["pre_tokenizer"] or {}
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"])) for x in spec["added_tokens"])
        self.pieces = level and added and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.marks = "".join(c for c in MARKS if not any(c in x["content"] for x in spec["added_tokens"]))
        #: Bytes that each id stands for; added tokens stand for their own text.
        size = self.library.get_vocab_size(with_added_tokens=True)
        own = {x["id"]: len(x["content"].encode()) for x in spec["added_tokens"]}
        self.bytes_of = np.array([own.get(i, len(self.library.id_to_token(i) or "")) for i in range(size)], np.int64) if self.pieces else None
        self.forget()

    def forget(self) -> None:
        """Drops all remembered pieces."""
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.number = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.held = 0

    def __call__(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0].tolist()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts that the offsets part data into, one after another, and how many each text has."""
        if not self.pieces:
            each = [self.library.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        if self.held > REMEMBERED or self.used > REMEMBERED_IDS:
            self.forget()
        marked = np.zeros(len(data) + 1, bool)
        marked[cuts(data, self.marks)] = marked[offsets] = True
        edge = np.flatnonzero(marked)
        tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(tiles)
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        number = self.number[at]
        total = np.concatenate([[0], np.cumsum(number)])
        shift = (self.first[at] - total[:-1]).astype(np.int32)  # what is remembered, and one slice, have fewer ids than 2**31
        ids = self.ids[np.arange(total[-1], dtype=np.int32) + np.repeat(shift, number)]
        return ids, np.diff(total[np.searchsorted(edge, offsets)])

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of each piece are kept; those not known yet are encoded."""
        known = self.place
        places = [known.get(p, -1) for p in pieces]
        fresh = [k for k, at in enumerate(places) if at < 0]
        joined, alone = [], []
        for k in fresh:
            (joined if _joins(pieces[k]) else alone).append(k)
        for k in range(0, len(alone), TOGETHER):
            self._keep(places, pieces, [[x] for x in alone[k : k + TOGETHER]])
        for k in range(0, len(joined), TOGETHER):
            self._keep(places, pieces, [joined[k : k + TOGETHER]])
        return np.array(places, np.int64)

    def _keep(self, places: list[int], pieces: list[bytes], groups: list[list[int]]) -> None:
        """Encodes the joined pieces of each group and keeps each piece's ids."""
        found = self.library.encode_batch_fast([b"".join([pieces[k] for k in g]).decode() for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, np.uint32)
            if len(group) == 1:
                ends = np.array([len(ids)])
            else:
                reach, size = np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[k]) for k in group])
                ends = np.searchsorted(reach, size) + 1
                if not (reach[ends - 1] == size).all():
                    raise ValueError("a token reaches across the end of a piece")
            self.ids = _grown(self.ids, self.used + len(ids))
            self.first, self.number = _grown(self.first, self.held + len(group)), _grown(self.number, self.held + len(group))
            self.ids[self.used : self.used + len(ids)] = ids
            starts = np.concatenate([[0], ends[:-1]])
            self.first[self.held : self.held + len(group)] = self.used + starts
            self.number[self.held : self.held + len(group)] = ends - starts
            for j, k in enumerate(group):
                places[k] = self.held + j
                if len(pieces[k]) <= REMEMBERED_BYTES:
                    self.place[pieces[k]] = self.held + j
            self.used += len(ids)
            self.held += len(group)


def _joins(piece: bytes) -> bool:
    """Whether a row of such pieces has cuts where they meet."""
    return piece[0] in b" \n" and (0x20 < piece[-1] < 0x7F or piece[-1] >= 0x80 and 0xC3 <= piece[-2] <= 0xDF)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of it with room for size numbers."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker."""
    return Encoder(file)


def write(documents: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> str:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order; returns the path.

    A null or empty text has the end id alone; null doc_ids come first; rows with one doc_id (null or
    not) stand in the order of a hash of their texts, so many of them still make many ranges. A long
    text, of white space alone too, is encoded whole; one document must fit into a task. Columns
    besides doc_id and text are not read, and an empty table makes no segment.
    """
    path = path or storage.new_path(documents.sparkSession, "tokens")
    schema = pa.schema([("file", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("blocks", pa.binary()), ("escaped", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, start = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            words, blocks, escaped = simple8b.encode(np.concatenate(parts))
            lengths = [len(p) for p in parts]
            return pa.RecordBatch.from_pylist([{"file": file, "start": start, "doc_ids": doc_ids, "lengths": lengths, "words": words.tobytes(), "blocks": blocks.tobytes(), "escaped": escaped.tobytes()}], schema)

        size = 0
        for batch in batches:
            doc_ids_here = batch.column(0).to_pylist()
            for first, last, data, offsets in words.slices(batch.column(1), SLICE_BYTES):
                ids, number = encode.encode(data, offsets)
                ends = np.cumsum(number)
                for k in range(last - first):
                    doc_ids.append(doc_ids_here[first + k])
                    parts.append(np.append(ids[ends[k] - number[k] : ends[k]], np.uint32(end_id)))
                    size += len(parts[-1])
                    if size >= SEGMENT_IDS:
                        yield packed()
                        start, size, doc_ids, parts = start + size, 0, [], []
        if parts:
            yield packed()
        encode.forget()

    order = ["doc_id", "text_hash"]
    ordered = documents.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    map_batches(ordered, segments, SEGMENT).write.options(compression="zstd", **storage.LARGE_ROWS).parquet(path)
    return path


def read(spark, path: str, each, fields: str) -> DataFrame:
    """Reads token files: doc_id, start (ids of all documents before it), n_tokens, and what each(ids) gives.

    each takes a document's ids (uint32) and returns the values of fields (a schema string).
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    names = [f.split()[0] for f in fields.split(",")] if fields else []
    schema = "file int, doc_id long, start long, n_tokens long" + (f", {fields}" if fields else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = simple8b.decode(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["escaped"], np.uint64), np.uint32)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if int(ends[-1]) != len(ids):
                    raise ValueError("a segment's documents and its words differ in length")
                more = [each(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]] * len(ends), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": row["start"] + ends - lengths, "n_tokens": lengths} | {n: [m[i] for m in more] for i, n in enumerate(names)})

    # A row for each file, so as many as tasks wrote: its size does not follow the documents.
    totals = files.select("file", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return map_batches(files, rows, schema).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", *names)


def checksums(documents: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers. An empty table gives
    no rows; null, empty and very long texts, repeated rows and clashing columns are as in ``write``.
    """
    path = write(documents, tokenizer_file, end_id)
    return read(documents.sparkSession, path, lambda ids: (zlib.crc32(np.ascontiguousarray(ids, "<u4")),), "ids_crc32 long")
