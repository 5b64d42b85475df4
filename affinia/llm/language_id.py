"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into windows of a fixed number of bytes, all of it, each beginning with the last bytes of
the one before, so that no run of bytes is lost at a cut. In each window, filters of several widths
run over the embedded bytes at every place, the largest response of each filter in the window goes to a
softmax over the languages, and a text's prediction is the mean over its windows. Training takes the
whole texts of a sample of labelled rows of bounded size, chosen by a hash of doc_id, evenly by
language, and all languages that occur; the trained weights are a few kilobytes and travel with the
tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.memory import map_batches

#: Bytes in a window, windows computed at a time, and texts taken together.
WINDOW, BATCH, TOGETHER = 192, 256, 64
#: Filter widths, filters of each, size of a byte's embedding.
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 16, 8
#: The bound of the training sample: rows a language, and rows in all (but one of each language at least).
ROWS, ALL_ROWS = 800, 8000
#: Steps of training, of TRAIN_BATCH windows each: a row is drawn, then any window of its text.
STEPS, TRAIN_BATCH, RATE, NOISE_SEED = 1600, 64, 3e-3, 7
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights: an embedding for each byte (0 pads), filters over the widest span, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def spans(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of every span that the filters see: (windows, places, span * embedding)."""
        held = np.zeros((len(windows), windows.shape[1] + max(WIDTHS) - 1), np.uint8)
        held[:, : windows.shape[1]] = windows
        embedded = self.embedding[held]
        n, s = embedded.strides[0], embedded.strides[1]
        return np.lib.stride_tricks.as_strided(embedded, (len(windows), windows.shape[1], max(WIDTHS) * EMBEDDING), (n, s, embedded.strides[2])).copy()

    def logits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits, with the spans, responses' places of the maximum, and pooled values that training needs."""
        spans = self.spans(windows)
        response = (spans.reshape(-1, spans.shape[2]) @ self.filters).reshape(*spans.shape[:2], -1)
        where = response.argmax(axis=1) if self.training else None
        pooled = np.maximum(response.max(axis=1) + self.bias, 0)
        return pooled @ self.out + self.out_bias, spans, where, pooled

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax by window, computed a batch at a time."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for k in range(0, len(windows), BATCH):
            out[k : k + BATCH] = softmax(self.logits(windows[k : k + BATCH])[0])
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _reach() -> np.ndarray:
    """Which rows of the filter matrix each filter uses: narrow filters end before the span does."""
    rows = np.arange(max(WIDTHS) * EMBEDDING) // EMBEDDING
    return (rows[:, None] < np.repeat(WIDTHS, FILTERS)).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], number: np.ndarray | None = None) -> Network:
    """A network fitted by Adam to windows (uint8) and the indexes of their rows' languages; the same for the same input.

    number tells how many windows each row has, one if left out. Every step draws rows, each equally
    likely, and any window of each: long texts don't outweigh others, and all of their windows count.
    """
    number = np.ones(len(windows), np.int64) if number is None else number
    begin = np.cumsum(number) - number
    rng = np.random.default_rng(NOISE_SEED)
    reach, k = _reach(), len(languages)
    span, total = reach.shape
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 1, (span, total)) * reach / np.sqrt(reach.sum(axis=0))).astype(np.float32),
        np.zeros(total, np.float32),
        (rng.normal(0, 1, (total, k)) / np.sqrt(total)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    net.embedding[0] = 0
    net.training = True
    names = ("embedding", "filters", "bias", "out", "out_bias")
    first, second = {n: 0.0 for n in names}, {n: 0.0 for n in names}
    for step in range(1, STEPS + 1):
        row = rng.integers(0, len(number), TRAIN_BATCH)
        x, y = windows[begin[row] + rng.integers(0, number[row])], labels[row]
        for n, g in _gradients(net, x, y, reach).items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            getattr(net, n)[...] -= RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    net.training = False
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy."""
    logits, spans, where, pooled = net.logits(x)
    d = softmax(logits)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    back = (d @ net.out.T) * (pooled > 0)  # by window and filter
    rows = np.arange(len(x))[:, None]
    chosen = spans[rows, where]  # (window, filter, span): only the pooled place passes a gradient
    into = back[:, :, None] * net.filters.T[None]
    span = max(WIDTHS)
    held = np.zeros((len(x), x.shape[1] + span - 1), np.uint8)
    held[:, : x.shape[1]] = x
    byte = held[rows[:, :, None], where[:, :, None] + np.arange(span)]
    embedding = np.zeros_like(net.embedding)
    for k in range(EMBEDDING):
        embedding[:, k] = np.bincount(byte.reshape(-1), into.reshape(-1, EMBEDDING)[:, k], 256)
    embedding[0] = 0
    return {"embedding": embedding, "filters": np.einsum("nfs,nf->sf", chosen, back) * reach, "bias": back.sum(axis=0), "out": pooled.T @ d, "out_bias": d.sum(axis=0)}


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, the last of each padded with zeros, and how many each has; an empty text has one.

    Each window but a text's first begins with the last max(WIDTHS) - 1 bytes of the one before.
    """
    step = WINDOW - (max(WIDTHS) - 1)
    size = np.array([len(t) for t in texts], np.int64)
    number = np.maximum(1, -(-(size - (max(WIDTHS) - 1)) // step))
    held = (number - 1) * step + WINDOW  # bytes of each text with its padding
    flat = np.zeros(int(held.sum()), np.uint8)
    begin = np.cumsum(held) - held
    for t, at in zip(texts, begin.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    start = np.repeat(begin, number) + place * step
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8), number


def fold(doc_id: str = "doc_id") -> Column:
    """CRC-32 of doc_id as text, modulo 4; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4))


def fit(labelled: DataFrame) -> Network | None:
    """A network for the languages of labelled (doc_id, text, lang); None if no text has both a language and letters.

    Two passes: languages are counted, then rows of each are drawn by a hash of their doc_id, ROWS at
    most and ALL_ROWS over all languages (with more languages than that, one of each). Of rows with
    the same hash any number may be drawn, ties in order of their texts; a drawn text counts whole.
    """
    rows = labelled.filter("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    take = max(1, min(ROWS, ALL_ROWS // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    # Somewhat more than are needed by chance, then by rank, so that no more than `take` reach the driver.
    limits = F.create_map(*[F.lit(v) for x, n in counts.items() for v in (x, min(1 << 30, (1 << 30) * (2 * take + 20) // n + 1))])
    some = rows.withColumn("draw", draw).filter(F.col("draw") < limits[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.col("doc_id").cast("string"), "text"))
    sample = some.withColumn("rank", rank).filter(F.col("rank") <= take).select("lang", "rank", "text").collect()
    languages = sorted(counts)
    index = {x: i for i, x in enumerate(languages)}
    sample.sort(key=lambda r: (r["lang"], r["rank"]))
    windows, number = windows_of([r["text"].encode() for r in sample])
    return train(windows, np.array([index[r["lang"]] for r in sample]), languages, number)


def predict(documents: DataFrame, network: Network | None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score (0 to 1) to all rows, from the whole of each text.

    A text without a letter, and a null or empty one, is ``und`` with score 0, as is every text without
    a network. Every window of a text counts, however long it is; of languages with equal means the
    first in order of their names is taken; repeated rows are judged alike, and an empty table gives none.
    Columns already called as ``into`` says are replaced; no other column than text is looked at.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best: list[str] = [UNDETERMINED] * batch.num_rows
            score = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if network is not None else 0, TOGETHER):
                texts = [x.as_py() or "" for x in batch.column("text").slice(at, TOGETHER)]
                some = [k for k, t in enumerate(texts) if _LETTER.search(t)]
                if not some:
                    continue
                windows, number = windows_of([texts[k].encode() for k in some])
                mean = np.add.reduceat(network.probabilities(windows).astype(np.float64), np.cumsum(number) - number) / number[:, None]
                for k, row in zip(some, mean, strict=True):
                    best[at + k] = network.languages[int(row.argmax())]
                    score[at + k] = min(1.0, float(row.max()))
            keep = [c for c in batch.schema.names if c not in into]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, *into])

    plain = documents.drop(*into)
    return map_batches(plain, rows, plain.withColumns({into[0]: F.lit(""), into[1]: F.lit(0.0)}).schema)


def held_out_predictions(documents: DataFrame) -> DataFrame:
    """Learns from the rows outside fold 2 and predicts every row: doc_id, held_out, lang_pred, score.

    Rows that repeat a doc_id share its fold. An empty table, or one without labels, learns nothing.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text", "lang")
    network = fit(rows.filter(fold() != 2))
    return predict(rows.select("doc_id", "text", (fold() == 2).alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")
