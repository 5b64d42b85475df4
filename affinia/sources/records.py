"""Schemas, readers, writers, and checks for records, truth, pairs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.functions.text import normalized


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Column for a row that does not fit the schema.
BAD = "_malformed"
#: Characters of a text that nearly always hold its first 15 words.
BEGIN = 300
#: Column names that must be these.
RECORD = _strings("entity_id", "business_name", "business_address", "country")
TRUTH = _strings("source1_entity_id", "matched_entity_ids")
CANDIDATE = _strings("source1_entity_id", "target_entity_id")
TRAINING_PAIR = _strings("entity_id", "business_name", "business_address", "country", "target_source", "target_entity_id", "target_business_name", "target_business_address", "target_country", "label", "matched_block")
SPLIT = _strings("entity_id")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """All columns as text, as written: no value counts as missing. tolerant: malformed rows are kept out, else they fail.

    Only the columns asked for are parsed; a tolerant scan judges a row by all of them, whichever are
    asked for. Rows kept out are in malformed_rows().
    """
    if tolerant:
        return _with_malformed(spark, path, schema).filter(_malformed(schema) == "").select(*schema.names).fillna("")
    return spark.read.schema(schema).csv(path, sep="\t", header=True, mode="FAILFAST", nullValue="\u0000", emptyValue="").fillna("")


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that a tolerant scan keeps out, as written: one column, ``malformed``; for a count or a sink."""
    return _with_malformed(spark, path, schema).select(_malformed(schema).alias("malformed")).filter("malformed <> ''")


def _malformed(schema: T.StructType) -> Column:
    """The row if it is malformed, else an empty text. Spark refuses to read that column alone: nothing of another is added."""
    return F.concat(F.coalesce(BAD, F.lit("")), F.substring(F.coalesce(F.col(schema.names[0]), F.lit("")), 1, 0))


def _with_malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    held = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(held).option("columnPruning", False).csv(path, sep="\t", header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, nullValue="\u0000", emptyValue="")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Tab-separated text with a header; existing output fails unless mode says overwrite or append."""
    df.write.mode(mode).csv(path, sep="\t", header=True, emptyValue="") if not partition_by else df.write.mode(mode).partitionBy(*partition_by).csv(path, sep="\t", header=True, emptyValue="")


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of figures as JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)


def require_columns(df: DataFrame, names: list[str] | tuple[str, ...], what: str = "table") -> DataFrame:
    """The table, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def first_rows(df: DataFrame, n: int, order: str = "entity_id") -> DataFrame:
    """The n first rows in a stated order."""
    return df.orderBy(order).limit(n)


def only_ids(df: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows whose id is listed; ids has one column."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows whose id isn't listed."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct (source1_entity_id, target_entity_id) from comma-separated lists; an empty list has none."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return truth.select("source1_entity_id", F.explode(ids).alias("target_entity_id")).distinct()


def source_name(source: Column) -> Column:
    """S2 or S3 for the names in use; anything else is an error."""
    name = F.lower(F.trim(source))
    return F.when(name.isin("source2", "s2"), "S2").when(name.isin("source3", "s3"), "S3").otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(source, F.lit("null")))))


def numbers(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """Columns as doubles; what is no number is 0."""
    return df.withColumns({n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) for n in names})


def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records of three sources: id, source 1 to 3, words 1-4 as name, 5-14 as address, language as country."""
    text = normalized(F.col("text"), unicode=False)  # the documents are in NFKC; blocking and features normalize fully
    # What follows a 15th word, even one cut short, can't change the first 14: few texts are normalized as a whole for them.
    begin = F.split(normalized(F.substring("text", 1, BEGIN), unicode=False), " ")
    words = F.when(F.size(begin) > 14, begin).otherwise(F.split(text, " "))
    number = F.substring("source", 4, 9).cast("int")
    source = F.when(number < 7, 1).when(number < 14, 2).otherwise(3)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("w"), source.alias("source"), F.col("lang").alias("country"), F.md5(text).alias("text_key"))
    return rows.select(
        F.concat(F.lit("S"), F.col("source"), F.lit("-"), F.col("doc_id")).alias("entity_id"),
        "source",
        F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
        F.array_join(F.slice("w", 5, 10), " ").alias("business_address"),
        "country",
        "text_key",
    )


def unique_ids(df: DataFrame, column: str = "entity_id") -> bool:
    """Whether every row has an id of its own; counted at once."""
    return not df.groupBy(column).count().filter((F.col("count") > 1) | F.col(column).isNull()).limit(1).count()
