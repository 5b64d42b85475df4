"""Documents made ready for training, in five stages; each is written as Parquet before the next reads it.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the
last return the columns of documents. A row with a null doc_id, or one that shares its doc_id with
others, goes through like any other; where a stage drops rows by doc_id, rows that share it go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia import storage
from affinia.llm import decontaminate, language_id, line_dedup, sentencepiece_codec, simhash

#: Below this score a text's language is taken as unknown.
LEAST_SCORE = 0.3
#: Columns for a prediction that no table of documents has.
JUDGED = ("pipeline_lang_pred", "pipeline_lang_score")

#: No SQL can express the network of the first stage; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without letters, and those it can't place, go."""
    network = language_id.fit(docs.filter(language_id.fold() != 2))
    judged = language_id.predict(docs, network, JUDGED)
    return judged.filter((F.col(JUDGED[0]) != language_id.UNDETERMINED) & (F.col(JUDGED[1]) >= LEAST_SCORE)).drop(*JUDGED)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share (but for one copy); n_chars follows."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the most long lines of each group of near-duplicates, the largest doc_id among equals.

    The stage before leaves a long line that many share in the largest doc_id that has it; of documents
    alike but for such a line that one has most, and of those that had the same lines the largest has
    kept them. Rows without a doc_id go if their group has one with.
    """
    groups = storage.materialize(simhash.near_duplicates(docs).select("doc_id", "component_id").distinct(), "groups")
    long_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: line_dedup.key_hash(x, 40).isNotNull()))
    sizes = docs.groupBy(F.col("doc_id").cast("long").alias("sized_id")).agg(F.max(long_lines).alias("size"))
    sized = groups.join(sizes, F.col("doc_id") == F.col("sized_id"), "left")
    rank = F.struct(F.coalesce("size", F.lit(0)), "doc_id")
    kept = sized.filter("doc_id is not null").groupBy(F.col("component_id").alias("of")).agg(F.max_by("doc_id", rank).alias("kept_id"))
    copies = groups.join(kept, F.col("component_id") == F.col("of")).filter("doc_id is null or doc_id <> kept_id").select("doc_id").distinct()
    return _without(docs, copies)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated").select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them."""
    return sentencepiece_codec.round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids, a null one included."""
    gone = ids.withColumnRenamed("doc_id", "gone")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]), "left_anti")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents and returns the last one's rows; what the stages leave behind is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = storage.mark()
    for name, stage in STAGES:
        path = storage.new_path(spark, f"pipeline_{name}")
        docs = storage.materialize(stage(spark, docs, sf_dir), name, path=path)
        storage.discard_since(spark, since, (path,))
    return docs
