import math
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from affinia.llm import sharding


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def feistel(x, height, width, key):
    left, right = divmod(x, width)
    for k in range(sharding.ROUNDS):
        left = (left + hashed(key, 2 * k, right) % height) % height
        right = (right + hashed(key, 2 * k + 1, left) % width) % width
    return left * width + right


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1003])
def test_places_equal_arithmetic(spark, n):
    width = math.isqrt(max(0, n - 1)) + 1
    height = max(1, -(-n // width))
    key = sharding.walking_key(spark, n, height, width, sharding.KEY)

    def place(x):
        x = feistel(x, height, width, key)
        while x >= n:
            x = feistel(x, height, width, key)
        return x

    got = [r[0] for r in spark.range(n).select(sharding.place(spark, F.col("id"), n)).collect()]
    assert got == [place(x) for x in range(n)] and sorted(got) == list(range(n))


def test_laws_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(None, None), (None, ""), (5, "é"), (5, "é"), (6, "x" * 300_000)], "doc_id long, text string")).withColumn("size", F.lit("mine"))
    rows = sharding.shards(docs, 40).collect()
    number = Counter(r.shard for r in rows)
    assert len(number) == 40 and max(number.values()) - min(number.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in number.items())
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d.doc_id, len(data(d.text)) + 16, zlib.crc32(data(d.text))) for d in docs.collect())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    again = sharding.shards(docs.repartition(7), 40)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))


def test_empty_table_and_native_plan(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shards(none).collect() == []
    out = sharding.shards(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")))
    assert not re.search("Python|Pandas|MapInArrow", out._jdf.queryExecution().toString())
