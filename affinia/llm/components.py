"""Connected components by alternating star contractions (Kiveris et al., 2014).

Each round lets every node point its larger neighbours at the least one it knows, then the same
among smaller ones; a number of rounds that grows with the logarithm of the longest path is enough.
Rounds are written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia import storage


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b: long, no nulls) the columns node and component, the least node of each component.

    Nodes without a link to another don't occur. No group is gathered: each step is a join or a
    minimum by key.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark, before, path = links.sparkSession, None, None
    while True:
        last, path = path, storage.new_path(links.sparkSession, "round")
        edges = storage.materialize(_small_star(_large_star(edges)), "round", path=path)
        if last:
            storage.discard(spark, last)
        # Equal sums over hashes of all edges in two rounds: nothing moved.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(state)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node get the least of its neighbours and itself."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
