"""Registered queries that write tables as files into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia import storage
from affinia.sources import records as R

CUSTOMER = R._strings("c_custkey", "c_name", "c_mktsegment")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(*[F.col(c).cast("string").alias(c) for c in CUSTOMER.names])


def _written(spark: SparkSession, sf_dir: str, **options) -> str:
    """Where all customers lie as tab-separated text."""
    path = storage.new_path(spark, "customers")
    R.write_tsv(_customers(spark, sf_dir), path, **options)
    return path


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, written as tab-separated text over an older table and read again."""
    path = _written(spark, sf_dir)
    R.write_tsv(_customers(spark, sf_dir), path, mode="overwrite")
    return R.read_tsv(spark, path, CUSTOMER)


def tsv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of the text table, counted: the others are not parsed."""
    return R.read_tsv(spark, _written(spark, sf_dir), CUSTOMER).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def tsv_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty first customers by name."""
    return R.first_rows(R.read_tsv(spark, _written(spark, sf_dir), CUSTOMER), 20, "c_name")


def tsv_tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which every tenth line lacks a column and every seventh has one more: lines kept, and lines kept out."""
    path, key = storage.new_path(spark, "lines"), F.col("c_custkey").cast("long")
    line = F.when(key % 10 == 0, F.concat_ws("\t", "c_custkey", "c_name")).when(key % 7 == 0, F.concat_ws("\t", *CUSTOMER.names, F.lit("more"))).otherwise(F.concat_ws("\t", *CUSTOMER.names))
    # Without a header line the reader's own takes the place of the first line of each file.
    rows = _customers(spark, sf_dir).select(line.alias("value")).coalesce(1)
    spark.range(1).select(F.lit("\t".join(CUSTOMER.names)).alias("value")).unionAll(rows).coalesce(1).write.text(path)
    kept = R.read_tsv(spark, path, CUSTOMER, tolerant=True).select(F.lit("kept").alias("kind"), "c_custkey")
    out = R.malformed_rows(spark, path, CUSTOMER).select(F.lit("kept out").alias("kind"), F.split_part("malformed", F.lit("\t"), F.lit(1)).alias("c_custkey"))
    return kept.unionAll(out)


def tsv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appended to a table that has them already: every key twice."""
    path = _written(spark, sf_dir)
    R.write_tsv(_customers(spark, sf_dir), path, mode="append")
    return R.read_tsv(spark, path, CUSTOMER).groupBy("c_custkey").agg(F.count("*").alias("n"))


def tsv_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one market segment, from a table with a folder for each."""
    path = _written(spark, sf_dir, partition_by=["c_mktsegment"])
    return R.read_tsv(spark, f"{path}/c_mktsegment=BUILDING", R._strings("c_custkey", "c_name"))


def id_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers told apart by whether a list of ids has them."""
    path, all_rows = storage.new_path(spark, "ids"), _customers(spark, sf_dir)
    R.write_tsv(all_rows.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("entity_id")), path)
    ids = R.read_tsv(spark, path, R.SPLIT)
    listed, others = R.only_ids(all_rows, ids, "c_custkey"), R.without_ids(all_rows, ids, "c_custkey")
    return listed.select("c_custkey", F.lit("listed").alias("kind")).unionAll(others.select("c_custkey", F.lit("other").alias("kind")))


def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by market segment, written as JSON lines and read again."""
    path = storage.new_path(spark, "metrics")
    R.write_metrics(_customers(spark, sf_dir).groupBy("c_mktsegment").agg(F.count("*").alias("n")), path)
    return spark.read.schema("c_mktsegment string, n long").json(path)


def truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from comma-separated lists: each customer with the orders of its key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("source1_entity_id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ", ").alias("matched_entity_ids"))
    path = storage.new_path(spark, "truth")
    R.write_tsv(orders, path)
    return R.truth_pairs(R.read_tsv(spark, path, R.TRUTH))


def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names as numbers: what is none is 0; and source names in one spelling."""
    rows = R.numbers(_customers(spark, sf_dir), ["c_custkey", "c_name"])
    alias = F.when(F.col("c_custkey") % 2 == 0, " Source2").otherwise("s3 ")
    return rows.select("c_custkey", "c_name", R.source_name(alias).alias("source"))


def queries() -> dict:
    """Queries by name."""
    every = (tsv_scan, tsv_columns, tsv_first_rows, tsv_tolerant_scan, tsv_append, tsv_by_category, id_list_lookup, metrics_file, truth_lists, coerced_numbers)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    columns = "CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment"
    return {
        "tsv_scan": f"SELECT {columns} FROM customer",
        "tsv_columns": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
        "tsv_first_rows": f"SELECT {columns} FROM customer ORDER BY c_name LIMIT 20",
        "tsv_tolerant_scan": "SELECT CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN 'kept out' ELSE 'kept' END AS kind, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer",
        "tsv_append": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(2 AS BIGINT) AS n FROM customer",
        "tsv_by_category": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
        "id_list_lookup": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'listed' ELSE 'other' END AS kind FROM customer",
        "metrics_file": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
        "truth_lists": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source1_entity_id, CAST(o_orderkey AS VARCHAR) AS target_entity_id FROM orders",
        "coerced_numbers": "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, coalesce(try_cast(c_name AS DOUBLE), 0.0) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'S2' ELSE 'S3' END AS source FROM customer",
    }
