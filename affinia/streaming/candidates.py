"""Candidate pairs for a stream of target records against a fixed table of source1 records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinia.operators import blocking
from affinia.sources.records import RECORD


def record_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Records from tab-separated files as they arrive, ``files`` of them in a batch."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).csv(path, sep="\t", header=True).fillna("")


def candidate_stream(targets: DataFrame, source1: DataFrame, variant: blocking.Variant = blocking.VARIANTS["ALL_V4"]) -> DataFrame:
    """One row for each shared key: a stream-static join without state; the pair's keys are collected by the sink."""
    left = blocking.exploded(blocking.with_keys(source1, variant), "source1_entity_id")
    right = blocking.exploded(blocking.with_keys(targets, variant), "target_entity_id")
    return right.join(left, ["block", "block_country", "value"])


def write_candidates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's distinct pairs with their blocks; a batch that is repeated replaces its own output."""

    def put(batch: DataFrame, number: int) -> None:
        pairs = batch.groupBy("source1_entity_id", "target_entity_id").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
        pairs.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
