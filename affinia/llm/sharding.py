"""A reproducible shuffle of all documents into shards, by arithmetic on their global row numbers.

Rows are numbered from 0 in the order of doc_id. A Feistel network over pairs of digits permutes
the smallest rectangle of numbers that holds all row numbers; a number outside them is permuted again
(cycle walking) until it falls among them. The place of a row follows from its number and the key
alone: shard = place mod shards, slot = place div shards. Shard sizes differ by one row at most, and
slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia import storage

#: Rounds of the network, the key, and the most steps of a walk.
ROUNDS, KEY, STEPS = 4, 20_240_601, 64


def _div(number: Column, by: int) -> Column:
    """Whole-number division, exact for every long."""
    return F.call_function("div", number.cast("long"), F.lit(by).cast("long"))


def feistel(number: Column, height: int, width: int, key: int) -> Column:
    """A permutation of the numbers below height * width: two digits take turns in shifting each other."""

    tall, wide = F.lit(height).cast("long"), F.lit(width).cast("long")

    def turn(at: Column, k: Column) -> Column:
        left, right = _div(at, width), at % wide
        shift = F.xxhash64(F.lit(key).cast("long"), k, F.when(k % 2 == 0, right).otherwise(left))
        return F.when(k % 2 == 0, (left + F.pmod(shift, tall)) % tall * wide + right).otherwise(left * wide + (right + F.pmod(shift, wide)) % wide)

    # A fold keeps the expression small: written out, each turn would hold the two before it.
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(2 * ROUNDS - 1).cast("long")), number.cast("long"), turn)


def walking_key(spark: SparkSession, n: int, height: int, width: int, key: int) -> int:
    """The first key from ``key`` on by which every number past the rows comes back among them within STEPS steps.

    Such numbers are fewer than the square root of the rows. A walk through them is then never longer,
    whichever row it starts from; all but very small tables keep the key.
    """
    while height * width > n and spark.range(n, height * width).filter(_walked(F.col("id"), n, height, width, key, STEPS) >= n).limit(1).count():
        key += 1
    return key


def _walked(number: Column, n: int, height: int, width: int, key: int, steps: int) -> Column:
    """The number permuted once, and again until it is below n, steps times at most."""
    # Bound once and used twice: nearly all rows need no second step.
    return F.transform(F.array(feistel(number, height, width, key)), lambda once: F.when(once < n, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda at, _: F.when(at < n, at).otherwise(feistel(at, height, width, key)))))[0]


def place(spark: SparkSession, number: Column, n: int, key: int = KEY) -> Column:
    """The shuffled place, from 0 to n - 1, of row ``number`` among n rows; needs no table."""
    if not n:
        return number
    width = max(1, math.isqrt(max(0, n - 1)) + 1)
    height = max(1, -(-n // width))
    return _walked(number, n, height, width, walking_key(spark, n, height, width, key), STEPS)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number``, gapless from 0 in the given order, and returns the number of rows too.

    Rows are sorted in ranges, which are written once with the place of each row in its range; the
    ranges' lengths, one number for each, turn these into global numbers.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    identity = F.monotonically_increasing_id()
    placed = storage.materialize(ordered.withColumn("range_number", F.shiftright(identity, 33)).withColumn("range_place", identity.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    lengths = placed.groupBy("range_number").agg(F.count("*").alias("length"))
    before = lengths.select("range_number", (F.sum("length").over(Window.orderBy("range_number")) - F.col("length")).alias("rows_before"))
    # One row for each range, as many as there were tasks: not a matter of the documents' number.
    out = placed.join(F.broadcast(before), "range_number").withColumn("row_number", F.col("rows_before") + F.col("range_place"))
    return out.drop("range_number", "range_place", "rows_before"), placed.count()


def shards(documents: DataFrame, number: int = 40, key: int = KEY) -> DataFrame:
    """One row for each row of documents, by the law ``rows``: shard counts differ by one at most.

    Columns doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard (null: this law
    deals all rows anew for another number of shards). A null text has no bytes; null doc_ids come
    first; rows that repeat a doc_id are numbered by their texts' checksums and sizes, and whole copies
    may take each other's places. Texts of any length count by size and checksum alone; an empty table
    gives no rows; columns besides doc_id and text are not read. Equal texts are not kept together: with
    copies of one text in a third of all rows the shards' counts could not be at most one apart.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    table, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = table.withColumn("at", place(documents.sparkSession, F.col("row_number"), n, key))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % number).cast("int").alias("shard"), _div(F.col("at"), number).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
