"""Near-duplicate detection on 64-bit SimHash fingerprints.

Fingerprints within ``distance`` differing bits are linked. The distinct ones are sorted by Gray rank,
where neighbours differ in few bits, over range partitions, and cut into groups of bounded size. A
hierarchical index lies over them: each node holds the bits that all fingerprints below it share, and
an upper node factors out what its children share. The index is joined with itself from the top: the
differences in shared bits add up along the way, and two whole groups are dropped as soon as they
exceed the limit. Its upper part, a node for each group, is small whatever the corpus; it tells which
groups can meet at all. A group is sent to those alone, without the fingerprints too far from the other
group's shared bits, and each two groups that meet are a unit of work of their own, so a dense
neighbourhood is spread over tasks. Groups already known to be connected are not compared again, and
no unit yields more links than it has members: what counts is which fingerprints hang together.
Connected components are then found over the distinct fingerprints, with each round written to the
shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia import storage
from affinia.llm.components import connected_components
from affinia.llm.memory import map_batches

DISTANCE, SHINGLE, SEED = 3, 3, 42
#: Children of a node of the index, and pairs of nodes compared in one step.
FANOUT, STEP = 4, 1_000_000
#: Fingerprints of a group, unless there would be more than MOST_GROUPS groups: then groups are larger.
GROUP, MOST_GROUPS = 1 << 15, 1 << 13
GROUPS = "group long, mask long, value long, prints binary"
#: Shingles hashed before their bits are counted.
COUNTED = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a text, as a signed 64-bit number: bit by bit the majority over its shingles, repeats included.

    Zero if there are no words; fewer words than a shingle needs are one shingle.
    """
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(t) for t in zip(*(tokens[k:] for k in range(words)))]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), COUNTED):
        h = np.array([digest(s, SEED) for s in shingles[at : at + COUNTED]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def fingerprints(documents: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (long) of every whole text, in one pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())], ["doc_id", "fingerprint"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, fingerprint long")


def gray_rank(column):
    """The place of a number in the reflected Gray code, as a signed number in unsigned order."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Hierarchical index over nodes in Gray order: fingerprints, or groups of them by the bits they share."""

    def __init__(self, value: np.ndarray, mask: np.ndarray | None = None):
        """value: uint64, in Gray order; mask: the bits that count (all, for fingerprints)."""
        #: By level, from the leaves up: shared bits and their values; first child, from level 1 on.
        self.mask, self.value, self.first = [np.full(len(value), ~np.uint64(0)) if mask is None else mask], [value], [np.zeros(0, np.int64)]
        while len(self.value[-1]) > 1:
            mask, value = self.mask[-1], self.value[-1]
            start = np.arange(0, len(value), FANOUT)
            every = np.bitwise_and.reduceat(mask, start)
            ones, zeros = np.bitwise_and.reduceat(value & mask, start), np.bitwise_and.reduceat(~value & mask, start)
            self.mask.append(every & (ones | zeros))
            self.value.append(ones)
            self.first.append(np.append(start, len(value)))
        self.top = len(self.value) - 1
        #: Bits that a node holds beyond those of its parent: what a step down can add to the differences.
        self.own = [m & ~np.repeat(self.mask[k + 1], np.diff(self.first[k + 1])) for k, m in enumerate(self.mask[:-1])] + [self.mask[-1]]

    def __len__(self) -> int:
        return len(self.value[0])

    def extent(self, parent: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest component below each node of a level."""
        low = high = parent
        for k in range(1, level + 1):
            low, high = np.minimum.reduceat(low, self.first[k][:-1]), np.maximum.reduceat(high, self.first[k][:-1])
        return low, high

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node, and how many it has; at level 0 the node itself."""
        if level == 0:
            return node, np.ones(len(node), np.int64)
        first = self.first[level]
        return first[node], first[node + 1] - first[node]


def meetings(left: GrayIndex, right: GrayIndex, distance: int, skip=None, seen: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves whose shared bits differ in at most distance places, some at a time.

    With one index on both sides each pair comes once, the lesser first, and no leaf meets itself.
    ``skip`` may say which pairs of nodes need no look; ``seen`` counts pairs of nodes that were
    dropped whole (pruned) and pairs of leaves that were compared.
    """
    same = left is right
    if not (len(left) and len(right)):
        return
    both = left.mask[-1] & right.mask[-1]
    root = np.zeros(1, np.int64)
    todo = [(left.top, right.top, root, root, np.bitwise_count((left.value[-1] ^ right.value[-1]) & both).astype(np.uint8))]
    while todo:
        la, lb, a, b, apart = todo.pop()
        if len(a) > max(1, STEP // FANOUT**2):
            half = len(a) // 2
            todo += [(la, lb, a[half:], b[half:], apart[half:]), (la, lb, a[:half], b[:half], apart[:half])]
            continue
        if la == lb == 0:
            keep = (apart <= distance) & ((a < b) if same else True)
            yield a[keep], b[keep]
            continue
        if skip is not None:
            keep = ~skip(la, lb, a, b)
            a, b, apart = a[keep], b[keep], apart[keep]
        # The higher side goes down, or both.
        da, db = la if la >= lb else 0, lb if lb >= la else 0
        (fa, na), (fb, nb) = left.children(da, a), right.children(db, b)
        total = na * nb
        pair = np.repeat(np.arange(len(a)), total)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        x, y = fa[pair] + inner // nb[pair], fb[pair] + inner % nb[pair]
        la, lb = la - (da > 0), lb - (db > 0)
        if same:
            keep = x <= y if la else x < y
            x, y, pair = x[keep], y[keep], pair[keep]
        # Bits that both hold now, less those that both held a step above: differences there were counted.
        gained = (left.own[la][x] if da else np.uint64(0)) | (right.own[lb][y] if db else np.uint64(0))
        fresh = left.mask[la][x] & right.mask[lb][y] & gained
        found = apart[pair] + np.bitwise_count((left.value[la][x] ^ right.value[lb][y]) & fresh)
        near = found <= distance
        if seen is not None:
            seen["compared" if la == lb == 0 else "kept"] += int(near.sum()) if la or lb else len(near)
            seen["pruned"] += int(len(near) - near.sum()) if la or lb else 0
        todo.append((la, lb, x[near], y[near], found[near]))


def forest(left: GrayIndex, right: GrayIndex, distance: int, seen: Counter | None = None) -> np.ndarray:
    """For each leaf (of the left index, then of the right one if it is another) the first that links across lead to."""
    offset = 0 if left is right else len(left)
    parent = np.arange(offset + len(right))
    united = False

    def connected(la: int, lb: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not united or (la == left.top and lb == right.top):
            return np.zeros(len(a), bool)
        low_a, high_a = left.extent(parent[: len(left)], la)
        low_b, high_b = right.extent(parent[offset:], lb)
        return (low_a[a] == high_a[a]) & (low_b[b] == high_b[b]) & (low_a[a] == low_b[b])

    for a, b in meetings(left, right, distance, connected, seen):
        if len(a):
            united = True
            _unite(parent, a, b + offset)
    return parent


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; afterwards parent names each one's least member."""
    while True:
        x, y = parent[a], parent[b]
        keep = x != y
        if not keep.any():
            return
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def gray_groups(distinct: DataFrame, n: int) -> DataFrame:
    """Stores n distinct fingerprints in groups of Gray order, a row each with the bits they share (columns GROUPS)."""
    size = max(GROUP, -(-n // MOST_GROUPS))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[np.ndarray] = []
        held = 0

        def group(prints: np.ndarray) -> pa.RecordBatch:
            index = GrayIndex(prints)
            mask, value = (np.array(x[-1], np.uint64).view(np.int64) for x in (index.mask, index.value))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(mask, pa.int64()), pa.array(value, pa.int64()), pa.array([prints.tobytes()], pa.binary())], ["group", "mask", "value", "prints"])

        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            while held >= size:
                every = np.concatenate(parts)
                yield group(every[:size])
                number, parts, held = number + 1, [every[size:]], held - size
        if held:
            yield group(np.concatenate(parts))

    rank = gray_rank(F.col("fingerprint"))
    ordered = distinct.select("fingerprint").repartitionByRange(max(1, -(-n // size)), rank).sortWithinPartitions(rank)
    path = storage.new_path(distinct.sparkSession, "gray_groups")
    map_batches(ordered, groups, GROUPS).write.options(**storage.LARGE_ROWS).parquet(path)
    return distinct.sparkSession.read.schema(GROUPS).parquet(path)


def links(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all of n distinct fingerprints within distance bits of each other."""
    spark = distinct.sparkSession
    groups = gray_groups(distinct, n)
    # The index above the groups: at most MOST_GROUPS nodes, and one more for each range of the sort.
    nodes = sorted(groups.select("group", "mask", "value").collect())
    upper = spark.sparkContext.broadcast((np.array([r["group"] for r in nodes], np.int64), GrayIndex(*(np.array([r[c] for r in nodes], np.int64).view(np.uint64) for c in ("value", "mask")))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, index = upper.value
        for batch in batches:
            for number, data in zip(batch.column("group").to_pylist(), batch.column("prints"), strict=True):
                prints, at = np.frombuffer(data.as_py(), np.uint64), int(np.searchsorted(numbers, number))
                own = GrayIndex(index.value[0][at : at + 1], index.mask[0][at : at + 1])
                for _, others in meetings(own, index, distance):
                    for other in others.tolist():
                        # Of two groups one goes to the other, now the former, now the latter.
                        if other != at and ((other > at) == bool((other + at) % 2)):
                            continue
                        near = prints if other == at else prints[np.bitwise_count((prints ^ index.value[0][other]) & index.mask[0][other]) <= distance]
                        if len(near):
                            yield pa.RecordBatch.from_arrays([pa.array([numbers[other]], pa.int64()), pa.array([number], pa.int64()), pa.array([b"" if other == at else near.tobytes()], pa.binary())], ["target", "source", "prints"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                prints, own = (batch.column(c)[k].as_py() for c in ("prints", "own"))
                right = GrayIndex(np.frombuffer(own, np.uint64))
                left = GrayIndex(np.frombuffer(prints, np.uint64)) if prints else right
                every = right.value[0] if left is right else np.concatenate([left.value[0], right.value[0]])
                root = forest(left, right, distance)
                linked = root != np.arange(len(root))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (every[linked], every[root[linked]])], ["a", "b"])

    # So many tasks that few targets share one; each row is a unit of work.
    tasks = max(1, min(2 * len(nodes), 1 << 14))
    targets = groups.select(F.col("group").alias("target"), F.col("prints").alias("own")).repartition(tasks, "target")
    pairs = map_batches(groups.select("group", "prints"), sent, "target long, source long, prints binary").repartition(tasks, "target")
    return map_batches(pairs.join(targets.hint("merge"), "target").select("prints", "own"), met, "a long, b long")


def near_duplicates(documents: DataFrame, words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of documents: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links lead to. A null or empty text, or one of white space
    alone, has fingerprint zero, which links like any other; texts of any length are taken whole. A bit
    that exactly half of the shingles have is 0. Rows that repeat a doc_id or a text stay, each with its
    own; a null doc_id never names a component unless all of its members are null, which gives null. An
    empty table gives no rows. Columns besides doc_id and text are not read.
    """
    prints = storage.materialize(fingerprints(documents, words), "fingerprints")
    distinct = storage.materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    found = storage.materialize(links(distinct, distinct.count(), distance).distinct(), "links")
    labels = connected_components(found)
    grouped = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = grouped.filter(F.col("component") != F.col("fingerprint")).groupBy("component").agg(F.min("least").alias("others"))
    of = grouped.join(named, "component", "left")
    leaders = of.filter(F.col("component") == F.col("fingerprint")).select("component", F.least("least", "others").alias("component_id"))
    named = grouped.select("fingerprint", "component").join(leaders, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
