"""Documents scored by the cross-entropy difference of two n-gram models (Moore and Lewis, 2010).

Target and background models are matched: the same vocabulary, the same order, the same smoothing,
and counts from whole texts. Words and pairs of words are counted one by one, under 64-bit hashes, so
the models grow with the corpus. Background counts come from all documents, target counts from the
documents marked as such. A document's score is the mean over its words of (target loss - background
loss) in nats: the lower, the more it resembles the target.

No task holds a model. Documents are dealt out to chunks, and hashes to ranges, in numbers that follow
the bytes of text. A chunk sends each range the hashes it has there, each once, with their counts; the
range adds up what all chunks sent and answers each chunk with the sums, in the order of its question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm import words
from affinia.llm.memory import release

#: log2 of the least vocabulary that smoothing reckons with (more if the corpus has more words), and of
#: the pairs that a chunk has in ordinary text.
CLASS_BITS, PAIR_BITS = 18, 20
#: What each word has besides its count, and the weight of single words against pairs.
ALPHA, PRIOR = 0.5, 8.0
#: Bytes of text in a chunk: a pair takes about eight.
CHUNK_BYTES = 8 << PAIR_BITS
#: Stands for the word before the first.
START = np.uint64(0)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (START at a text's start) and of the pair; words of each text."""
    found, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in texts.chunks:
        for _, _, data, offsets in words.slices(part):
            word, before = words.hashes(data, offsets)
            found.append(np.maximum(word, np.uint64(1)))
            numbers.append(np.diff(before))
    word, number = np.concatenate(found), np.concatenate(numbers)
    previous = np.concatenate([[START], word[:-1]])[: len(word)]
    previous[(np.cumsum(number) - number)[number > 0]] = START
    with np.errstate(over="ignore"):
        pair = words.mixed(previous * _STEP + word)
    return word, previous, pair, number


def _counted(hashes: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs where marked and anywhere (2 rows)."""
    keys, everywhere = np.unique(hashes, return_counts=True)
    some, there = np.unique(hashes[marked], return_counts=True)
    counts = np.zeros((2, len(keys)), np.int64)
    counts[0, np.searchsorted(keys, some)] = there
    counts[1] = everywhere
    return keys, counts


def _packed(counts: np.ndarray) -> bytes:
    """Counts with their lowest bytes first, then all next bytes, as far as the greatest needs: zeros compress."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return counts.astype("<u8").reshape(-1, 1).view(np.uint8)[:, :width].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """Two rows of n counts."""
    planes = np.zeros((2 * n, 8), np.uint8)
    if n:
        planes[:, : len(data) // (2 * n)] = np.frombuffer(data, np.uint8).reshape(-1, 2 * n).T
    return planes.view("<u8").astype(np.int64).reshape(2, n)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in sorted keys, and their number."""
    at = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))


def _asker(ranges: int):
    def ask(key: tuple, documents: pa.Table, targets: pa.Table) -> pa.Table:
        rows = []
        if len(documents):
            word, _, pair, number = _grams(documents["text"])
            id_ = documents["doc_id"]
            marked = np.isin(id_.fill_null(0).to_numpy(), targets["doc_id"].to_numpy()) & id_.is_valid().to_numpy()
            each = np.repeat(marked, number)
            (one, n_one), (two, n_two) = _counted(word, each), _counted(pair, each)
            starts = [[(marked & (number > 0)).sum()], [(number > 0).sum()]]
            one, n_one = np.concatenate([[START], one]), np.concatenate([starts, n_one], axis=1)
            cut_one, cut_two = _cuts(one, ranges), _cuts(two, ranges)
            for r in range(ranges):
                a, b = slice(*cut_one[r : r + 2]), slice(*cut_two[r : r + 2])
                rows.append((key[0].as_py(), r, one[a].tobytes(), _packed(n_one[:, a]), two[b].tobytes(), _packed(n_two[:, b])))
        out = pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.int64()] * 2 + [pa.binary()] * 4)], ["chunk", "range", "words", "n_words", "pairs", "n_pairs"])
        release()
        return out

    return ask


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct hashes of all chunks, their counts, and the counts in the order of each chunk."""
    each = [np.frombuffer(k, np.uint64) for k in keys]
    found, at = np.unique(np.concatenate(each), return_inverse=True)
    n = np.concatenate([_unpacked(c, len(k)) for c, k in zip(counts, each, strict=True)], axis=1)
    totals = np.stack([np.bincount(at, n[k], len(found)).astype(np.int64) for k in range(2)])
    ends = np.cumsum([len(k) for k in each])
    return found, totals, [_packed(totals[:, at[end - len(k) : end]]) for k, end in zip(each, ends, strict=True)]


def _answer(asked: pa.Table) -> pa.Table:
    """Sums for each chunk that asked, with this range's distinct words and their counts in both models."""
    found, totals, of_words = _summed(asked["words"].to_pylist(), asked["n_words"].to_pylist())
    _, _, of_pairs = _summed(asked["pairs"].to_pylist(), asked["n_pairs"].to_pylist())
    real = found != START
    sizes = [int(real.sum()), *(int(x) for x in totals[:, real].sum(axis=1))]
    columns = [asked["chunk"], asked["range"], pa.array(of_words, pa.binary()), pa.array(of_pairs, pa.binary()), *(pa.array([x] * len(asked), pa.int64()) for x in sizes)]
    release()
    return pa.Table.from_arrays(columns, ["chunk", "range", "n_words", "n_pairs", "vocabulary", "target", "background"])


def losses(word: np.ndarray, previous: np.ndarray, pair: np.ndarray, number: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Summed target and background losses of each text (2 rows)."""
    answers = answers.sort_by("range")
    ranges = len(answers)
    one = np.concatenate([[START], np.unique(word)])
    two, first, at = np.unique(pair, return_index=True, return_inverse=True)

    def counts(keys: np.ndarray, column: str) -> np.ndarray:
        return np.concatenate([_unpacked(data, n) for data, n in zip(answers[column].to_pylist(), np.diff(_cuts(keys, ranges)), strict=True)], axis=1)

    single, both = counts(one, "n_words"), counts(two, "n_pairs")
    size = max(1 << CLASS_BITS, sum(answers["vocabulary"].to_pylist()))
    # A loss for each distinct pair, from the words of its first occurrence.
    last, before = np.searchsorted(one, word[first]), np.searchsorted(one, previous[first])
    text = np.repeat(np.arange(len(number)), number)
    out = np.zeros((2, len(number)))
    for k, column in enumerate(("target", "background")):
        total = sum(answers[column].to_pylist())
        alone = (single[k, last] + ALPHA) / (total + ALPHA * size)
        loss = -np.log((both[k] + PRIOR * alone) / (single[k, before] + PRIOR))
        out[k] = np.bincount(text, loss[at], len(number))
    return out


def _score(documents: pa.Table, answers: pa.Table) -> pa.Table:
    word, previous, pair, number = _grams(documents["text"])
    sums = losses(word, previous, pair, number, answers) if len(documents) else np.zeros((2, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = sums / number
    columns = [pa.array(x, pa.float64(), from_pandas=True) for x in (mean[0], mean[1], mean[0] - mean[1])]
    out = pa.Table.from_arrays([documents["doc_id"], pa.array(number, pa.int64()), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
    release()
    return out


def cross_entropy_difference(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores every row of documents against a target corpus: those documents whose doc_id is in targets.

    doc_id, n_tokens, target_loss, background_loss (means by word) and score, their difference. A null or
    empty text has no words, and null losses; texts of any length are taken whole, one to a task at
    least; a null doc_id is never a target; repeated rows count each time, and get equal scores; without
    targets the target model is the smoothing alone; an empty table gives no rows. Of documents doc_id
    and text are read, of targets doc_id alone.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    doc_id = F.col("doc_id").cast("long")

    def dealt(key):
        return F.pmod(F.xxhash64(key), F.lit(chunks).cast("long")).alias("chunk")

    # Rows without a doc_id are no targets, and may go to any chunk.
    rows = documents.select(dealt(F.coalesce(doc_id, F.xxhash64("text"))), doc_id.alias("doc_id"), "text").groupBy("chunk")
    marks = targets.filter(doc_id.isNotNull()).select(dealt(doc_id), doc_id.alias("doc_id")).distinct().groupBy("chunk")
    asked = rows.cogroup(marks).applyInArrow(_asker(chunks), "chunk long, range long, words binary, n_words binary, pairs binary, n_pairs binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "chunk long, range long, n_words binary, n_pairs binary, vocabulary long, target long, background long")
    return rows.cogroup(answers.groupBy("chunk")).applyInArrow(_score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
