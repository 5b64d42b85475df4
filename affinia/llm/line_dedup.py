"""Line deduplication on levelled sorted runs.

The key of a line is its text without white space at the ends and with A-Z lower-cased; keys are held as
128-bit hashes. A run is a table of distinct keys, hashed into buckets and sorted within them, each
with its holder, the largest doc_id that has it. Documents come in batches of descending doc_id, so the
first batch that has a key has its holder too. A new batch is merge-anti-joined with all runs: the keys
that none of them has become a run of level 0, and no key is ever in two runs. The other keys only add
to counts, which are kept in tables apart. As soon as a level has FANOUT runs (or tables of counts)
they are merged into one of the next level. All have the same buckets, so merge joins between them
shuffle nothing.

Keys found in at least ``min_documents`` documents are dropped from all documents but their holder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia import storage

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches of a whole table, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 2
#: Keys with this share of all rows of keys or more are joined apart; at most HOT of them can exist.
HOT = 1000


def key_hash(line: Column, min_chars: int) -> Column:
    """Two 64-bit hashes of a line's key, or null for a key of fewer characters."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) >= min_chars, _hashes(bare))


def _hashes(bare: Column) -> Column:
    # Plain lower() is right, and fast, where all characters are ASCII; elsewhere only A-Z may change.
    key = F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))
    return F.transform(F.array(key), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))[0]


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, a hash of the text, and the distinct keys (h1, h2) of each row's lines."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), lambda x: key_hash(x, min_chars)), lambda k: k.isNotNull()))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.explode(keys).alias("k")).select("doc_id", "text_hash", "k.h1", "k.h2")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """Levelled sorted runs of new keys, and tables of further counts; all lie in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: By level, the tables of runs and of counts.
        self.runs: list[list[str]] = []
        self.counts: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        """Stores distinct keys in buckets, one sorted file for each."""
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        self.paths[name] = storage.new_path(self.spark, "line_run")
        rows.repartition(self.buckets, "h1").sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        storage.discard(self.spark, self.paths.pop(name))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2), distinct by row of the documents, with doc_ids below all earlier ones."""
        batch = self._write(keys.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc_id").alias("holder")))
        older = [name for level in self.runs for name in level]
        if not older:
            self._place(self.runs, batch, 0)
            return
        rows = self.spark.table(batch)
        fresh = rows
        for name in older:
            fresh = fresh.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(fresh)
        known = rows.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        self._place(self.counts, self._write(known.select("h1", "h2", "documents")), 0)
        self._drop(batch)
        self._place(self.runs, run, 0)

    def _place(self, levels: list[list[str]], name: str, level: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) == FANOUT:
            names, levels[level] = levels[level], []
            self._place(levels, self._write(self._merged(names)), level + 1)
            for old in names:
                self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Tables merged by their order: counts are added, and a key that is in two runs is an error.

        A join, as a union of bucketed tables can't be relied on to keep buckets apart.
        """
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name)
            for c in other.columns[2:]:
                other = other.withColumnRenamed(c, f"other_{c}")
            both = rows.join(other.hint("merge"), ["h1", "h2"], "full")
            count = F.coalesce("documents", F.lit(0)) + F.coalesce("other_documents", F.lit(0))
            if "holder" in rows.columns:
                twice = F.col("documents").isNotNull() & F.col("other_documents").isNotNull()
                count = F.when(twice, F.raise_error(F.lit("a key is in two runs")).cast("long")).otherwise(count)
                rows = both.select("h1", "h2", count.alias("documents"), F.coalesce("holder", "other_holder").alias("holder"))
            else:
                rows = both.select("h1", "h2", count.alias("documents"))
        return rows

    def keys(self) -> DataFrame:
        """All keys with their counts and holders."""
        rows = self._merged([name for level in self.runs for name in level])
        counts = [name for level in self.counts for name in level]
        if not counts:
            return rows
        more = self._merged(counts).withColumnRenamed("documents", "more").hint("merge")
        return rows.join(more, ["h1", "h2"], "left").select("h1", "h2", (F.col("documents") + F.coalesce("more", F.lit(0))).alias("documents"), "holder")

    def drop(self) -> None:
        """Removes all tables."""
        for name in list(self.paths):
            self._drop(name)
        self.runs, self.counts = [], []


def frequent_keys(documents: DataFrame, keys: DataFrame, min_documents: int) -> DataFrame:
    """Keys of at least min_documents rows, with their holder, by adding the stored keys batch after batch."""
    runs = Runs(documents.sparkSession)
    try:
        # A null batch (null doc_ids) comes last, as if below all other doc_ids.
        for batch in range(BATCHES, -1, -1):
            runs.add(keys.filter(F.col("batch") == batch).select("doc_id", "h1", "h2"))
        return storage.materialize(runs.keys().filter(F.col("documents") >= min_documents), "frequent_lines")
    finally:
        runs.drop()


def rows_of(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """All rows of keys that frequent has, with documents and holder.

    A key with a HOTth of all rows could fill a task of its own: such keys, at most HOT of them as
    counts add up to the number of rows, are broadcast; the others meet their rows by a merge join.
    """
    limit = F.lit(max(1, -(-keys.count() // HOT)))
    hot = F.broadcast(frequent.filter(F.col("documents") >= limit))
    rest = frequent.filter(F.col("documents") < limit)
    cold = keys.join(F.broadcast(frequent.filter(F.col("documents") >= limit).select("h1", "h2")), ["h1", "h2"], "left_anti")
    return keys.join(hot, ["h1", "h2"]).unionByName(cold.join(rest, ["h1", "h2"]))


def deduplicate(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """documents with the lines dropped from text, and n_lines (before) and n_dropped.

    Lines whose key has at least min_chars characters and is found in at least min_documents rows stay
    only in the rows with the largest doc_id that holds the key; a line that occurs twice there stays
    twice. A null or empty text is one empty line and becomes an empty text. Rows that repeat a doc_id
    count each, and each keeps the line if theirs is the largest doc_id; a null doc_id counts as less
    than any other. Texts of any length are taken whole; a row must fit into a task, as it does on being
    read. An empty table gives no rows. Columns already called n_lines or n_dropped are replaced, all
    others stay, whatever their names.
    """
    limits = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*[F.lit(k / BATCHES) for k in range(1, BATCHES)]), F.lit(10_000))).first()[0] or []
    doc_id = F.col("doc_id").cast("long")
    batch = sum([F.coalesce((doc_id > x).cast("int"), F.lit(0)) for x in limits], F.when(doc_id.isNull(), 0).otherwise(1))
    keys = storage.materialize(line_keys(documents, min_chars).withColumn("batch", batch), "line_keys", ["batch"])
    frequent = frequent_keys(documents, keys, min_documents)

    # The keys to drop from each row, in 64 parts by hash: looking one up is quick however many there are.
    part = F.pmod("h1", F.lit(64)).cast("int")
    # Rows are told apart by their texts too, so a doc_id that many share (or lack) doesn't gather them.
    gone = rows_of(keys, frequent).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    parts = gone.groupBy("doc_id", "text_hash", part.alias("part")).agg(F.collect_set(F.struct("h1", "h2")).alias("hashes"))
    sets = parts.groupBy(F.col("doc_id").alias("gone_from"), F.col("text_hash").alias("gone_hash")).agg(F.map_from_entries(F.collect_list(F.struct("part", "hashes"))).alias("gone"))

    def stays(line: Column) -> Column:
        def unlisted(k: Column) -> Column:
            return ~F.coalesce(F.array_contains(F.try_element_at(F.col("gone"), F.pmod(k["h1"], F.lit(64)).cast("int")), k), F.lit(False))

        return F.when(F.length(F.btrim(line, F.lit(SPACE))) < min_chars, True).otherwise(F.transform(F.array(key_hash(line, 0)), unlisted)[0])

    # Rows travel as one column, so no name of theirs can meet a name of these steps.
    plain = documents.drop("n_lines", "n_dropped")
    whole = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("doc"))
    joined = whole.join(sets, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("gone_from")) & (F.xxhash64("doc.text") == F.col("gone_hash")), "left")
    lines = joined.withColumn("lines", _lines(F.col("doc.text"))).withColumn("kept_lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    columns = [F.array_join("kept_lines", "\n").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in plain.columns]
    return lines.select(*columns, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays, for each row of documents.

    Null, empty and very long texts, ties, repeated rows and empty tables are as in ``deduplicate``;
    other columns than doc_id and text are not read.
    """
    rows = deduplicate(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
