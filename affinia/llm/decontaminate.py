"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each segment holds the postings of a few megabytes of text,
terms in order of their hashes and, for each, the ascending positions of its occurrences.
Segments are made where the documents are read and are stored as a table, so no word decides
how work is dealt out and nothing is shuffled, however frequent a word is.

A search goes through the segments. In each, a test window starts from the postings of its
rarest term there, shifted by the term's place in the window, and is intersected with the
shifted postings of its other terms, the rarer first. With ``slop`` 0 the matches are exact
phrases; otherwise each word may lie up to ``slop`` places from its own place.

Test items reach the executors in blocks of at most BLOCK_WORDS windows, whatever their number: one
block is broadcast, searched for, its matches written, and the broadcast destroyed before the next.
Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia import storage
from affinia.llm import words
from affinia.llm.memory import map_batches

#: Windows of test items that are sent to the executors at once (about 100 bytes each).
BLOCK_WORDS = 200_000
#: Places looked at in one step of an intersection.
STEP = 2_000_000
INDEX = "segment long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"


def build_index(documents: DataFrame) -> DataFrame:
    """Stores the positional postings of every text in the shared folder; columns INDEX, a row for each segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column(1)):
                terms, counts, positions, before = postings(data, offsets)
                ids = batch.column(0).slice(first, last - first).to_pylist()
                yield pa.RecordBatch.from_pylist([{"segment": 0, "doc_ids": ids, "n_words": np.diff(before).tolist(), "terms": terms.tobytes(), "counts": counts.tobytes(), "positions": positions.tobytes()}], schema)

    made = map_batches(documents.select(F.col("doc_id").cast("long"), "text"), segments, INDEX)
    path = storage.new_path(documents.sparkSession, "postings")
    made.withColumn("segment", F.monotonically_increasing_id()).write.options(**storage.LARGE_ROWS).parquet(path)
    return documents.sparkSession.read.schema(INDEX).parquet(path)


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their numbers of occurrences, all positions by term, and the words before each text.

    One free position lies between texts, so that no phrase reaches from one into the next.
    """
    found, before = words.hashes(data, offsets)
    place = np.arange(len(found)) + np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    order = np.argsort(found, kind="stable")
    found = found[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[starts], np.diff(np.append(starts, len(found))).astype(np.uint32), place[order].astype(np.uint32), before


@dataclass
class Block:
    """Windows of test items: rows of indexes into terms, -1 past a short item's end."""

    items: list[str]
    terms: np.ndarray
    windows: np.ndarray
    item: np.ndarray


def blocks(benchmark: DataFrame, n: int) -> Iterator[Block]:
    """The windows of all items, in blocks of bounded size; an item without words has none."""
    names: list[str] = []
    rows: list[np.ndarray] = []
    item: list[int] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        text = (row["text"] or "").encode()
        found, _ = words.hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if not len(found):
            continue
        names.append(row["i"] or "")
        for at in range(0, max(1, len(found) - n + 1)):
            rows.append(found[at : at + n])
            item.append(len(names) - 1)
            if (size := size + 1) == BLOCK_WORDS:
                yield _block(names, rows, item, n)
                names, rows, item, size = [names[-1]], [], [], 0
    if rows:
        yield _block(names, rows, item, n)


def _block(names: list[str], rows: list[np.ndarray], item: list[int], n: int) -> Block:
    terms, index = np.unique(np.concatenate(rows), return_inverse=True)
    windows = np.full((len(rows), n), -1, np.int32)
    lengths = np.array([len(r) for r in rows])
    windows[np.arange(n) < lengths[:, None]] = index
    return Block(names, terms, windows, np.array(item, np.int32))


def search(block: Block, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, before: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, text, start) of every match in a segment; before: the first place of each text, and one past the last."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    number = np.where(terms[at] == block.terms, counts[at], 0).astype(np.int64)
    used = block.windows >= 0
    often = np.where(used, number[block.windows], np.iinfo(np.int64).max)
    alive = np.flatnonzero(often.min(axis=1) > 0)
    if not len(alive):
        return none
    by_rarity = np.argsort(often[alive], axis=1, kind="stable")
    rarest = np.take_along_axis(block.windows[alive], by_rarity, axis=1)
    begin = np.cumsum(counts, dtype=np.int64) - counts
    span = int(before[-1]) + block.windows.shape[1]
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), counts) * span + positions
    load = np.cumsum(number[rarest[:, 0]])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(load, (load[low - 1] if low else 0) + STEP, "right")))
        seed = rarest[low:high, 0]
        size = number[seed]
        which = np.repeat(np.arange(low, high), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = positions[np.repeat(begin[at[seed]], size) + inner].astype(np.int64)
        text = np.searchsorted(before, place, "right") - 1
        start = place - by_rarity[which, 0]
        if slop:  # the rarest word, too, may be off its place
            start = (start[:, None] + np.arange(-slop, slop + 1)).reshape(-1)
            which, text = np.repeat(which, 2 * slop + 1), np.repeat(text, 2 * slop + 1)
        keep = start >= before[text] - slop
        which, text, start = which[keep], text[keep], start[keep]
        for k in range(1, rarest.shape[1]):
            term = rarest[which, k]
            aim = start + by_rarity[which, k]
            # The first posting of this term from the earliest place on, in this text, must not lie past the latest.
            row = at[np.maximum(term, 0)] * span
            earliest, latest = np.maximum(aim - slop, before[text]), np.minimum(aim + slop, before[text + 1] - 1)
            near = keys[np.minimum(np.searchsorted(keys, row + earliest), len(keys) - 1)] - row
            keep = (term < 0) | ((near >= earliest) & (near <= latest))
            which, text, start = which[keep], text[keep], start[keep]
        if slop:  # a repeated word can give a start more than once
            which, text, start = np.unique(np.stack([which, text, start]), axis=1)
        out.append((alive[which], text, start))
        low = high
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one at a time: a segment takes megabytes."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _first_places(row: dict) -> np.ndarray:
    """The first place of each text of a segment, one free place after each, and one past the last."""
    return np.concatenate([[0], np.cumsum(np.array(row["n_words"], np.int64) + 1)])


def _matches(block: Block, row: dict, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each match in a segment: item, text, first and last-plus-one place."""
    postings_of = (np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["positions"], np.uint32))
    window, text, start = search(block, *postings_of, _first_places(row), slop)
    length = (block.windows[window] >= 0).sum(axis=1)
    return block.item[window], text, start, start + length


def find(index: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """Documents' matches: doc_id, item_id, and the first and last word (from 0) of each occurrence of a window.

    slop 0 finds exact phrases; a larger one finds every start from which each word lies within slop
    places of its own, in the same text.
    """
    schema = "doc_id long, item_id string, first long, last long"
    parts = _by_block(index, blocks(benchmark, n), lambda block, _: map_batches(index, _finder(block, slop), schema))
    return reduce(DataFrame.unionAll, parts) if parts else index.sparkSession.createDataFrame([], schema)


def _by_block(index: DataFrame, every: Iterator[Block], search_for) -> list[DataFrame]:
    """The tables that search_for(broadcast block, number) gives; each is written before the next block is sent."""
    parts = []
    for k, block in enumerate(every):
        sent = index.sparkSession.sparkContext.broadcast(block)
        parts.append(storage.materialize(search_for(sent, k), "matches"))
        sent.destroy()
    return parts


def _finder(block, slop: int):
    def rows(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                item, doc, start, end = _matches(block.value, row, slop)
                before = _first_places(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([row["doc_ids"][d] for d in doc.tolist()], pa.int64()),
                        "item_id": pa.array([block.value.items[i] for i in item.tolist()], pa.string()),
                        "first": pa.array(np.maximum(start - before[doc], 0), pa.int64()),
                        "last": pa.array(np.minimum(end, before[doc + 1] - 1) - before[doc] - 1, pa.int64()),
                    }
                )

    return rows


def _marks(block, first: bool):
    """Per document of a segment: number of words, the runs of hit words, and the items that occur.

    The first block gives a row for every document, later ones only for documents with a match.
    """
    schema = pa.schema([("segment", pa.int64()), ("k", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def rows(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                count = np.array(row["n_words"], np.int64)
                before = _first_places(row)
                runs: dict[int, list[int]] = {}
                items: dict[int, set[str]] = {}
                if block is not None:
                    item, doc, start, end = _matches(block.value, row, 0)
                    change = np.zeros(int(before[-1]) + 1, np.int32)
                    np.add.at(change, start, 1)
                    np.add.at(change, end, -1)
                    inside = np.concatenate([[False], np.cumsum(change) > 0])
                    for at in np.flatnonzero(inside[1:] != inside[:-1]).tolist():
                        d = int(np.searchsorted(before, at, "right")) - 1
                        runs.setdefault(d, []).append(at - int(before[d]))
                    for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
                        items.setdefault(d, set()).add(block.value.items[i])
                which = range(len(count)) if first else sorted(runs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [row["segment"]] * len(which),
                        "k": list(which),
                        "doc_id": [row["doc_ids"][d] for d in which],
                        "n_words": [int(count[d]) for d in which],
                        "runs": [runs.get(d, []) for d in which],
                        "items": [sorted(items.get(d, ())) for d in which],
                    },
                    schema,
                )

    return rows


def _summed(batches):
    """Joins the blocks' marks of each document."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        for doc_id, n_words, runs, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "runs", "items")), strict=True):
            pairs = sorted((r[k], r[k + 1]) for r in runs for k in range(0, len(r), 2))
            hit, reached = 0, 0
            for a, b in pairs:
                hit += max(0, b - max(a, reached))
                reached = max(reached, b)
            names = sorted({x for xs in items for x in xs})
            for k, v in zip(out, (doc_id, n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it stands in any occurrence of any n consecutive words of an item, or of a whole
    item that has fewer. A null or empty text has no words; texts of any length are taken whole, a very
    long one as a segment of its own; a null item_id is named as an empty string; items with one item_id
    count as one; rows that repeat a doc_id, or a text, are judged each by itself; an empty benchmark
    hits nothing, and without documents there are no rows. Of documents only doc_id and text are read,
    of the benchmark item_id and text.
    """
    index = build_index(documents)
    schema = "segment long, k int, doc_id long, n_words long, runs array<long>, items array<string>"
    parts = _by_block(index, blocks(benchmark, n), lambda block, k: map_batches(index, _marks(block, k == 0), schema)) or [map_batches(index, _marks(None, True), schema)]
    if len(parts) == 1:
        marks = parts[0].select("doc_id", "n_words", F.array("runs").alias("runs"), F.array("items").alias("items"))
    else:
        marks = reduce(DataFrame.unionAll, parts).groupBy("segment", "k").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    return map_batches(marks, _summed, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
