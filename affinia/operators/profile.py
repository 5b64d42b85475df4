"""Descriptions of tables: missing values, counts, distributions, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing (null or blank), rows: one pass over the table."""
    counted = df.agg(F.count("*").alias("rows"), *[F.sum((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("int")).alias(c) for c in columns])
    return counted.unpivot(["rows"], columns, "column_name", "missing").select("column_name", F.col("missing").cast("long").alias("missing"), "rows")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of values and their percentage of all rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.join(df.agg(F.count("*").alias("total")), how="cross").withColumn("pct", F.col("n") * 100 / F.col("total")).drop("total")


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, in one pass: category (the column), value, n."""
    for_sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    which = [F.col("g") == full ^ (1 << (len(columns) - 1 - i)) for i in range(len(columns))]
    category = F.coalesce(*[F.when(w, F.lit(c)) for w, c in zip(which, columns, strict=True)])
    value = F.coalesce(*[F.when(w, F.coalesce(F.col(c).cast("string"), F.lit(""))) for w, c in zip(which, columns, strict=True)])
    return for_sets.select(category.alias("category"), value.alias("value"), "n")


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, max and interpolated percentiles, exact."""
    value = F.col(column).cast("double")
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    aggs.append(F.percentile(value, F.array(*[F.lit(p / 100) for p in PERCENTILES])).alias("percentiles"))  # one count of values for all
    rows = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return rows.withColumns({f"p{p}": F.col("percentiles")[k] for k, p in enumerate(PERCENTILES)}).drop("percentiles")


def group_statistics(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """count, mean and median by group, to two places."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(column), 2).alias("mean"), F.round(F.median(column), 2).alias("median"))


def bins(value: Column, edges: tuple[int, ...] = (40, 60, 70, 80, 90)) -> Column:
    """Half-open bins by their edges: <40, 40-59, ..., 90+."""
    out = F.when(value < edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, f"{low}-{high - 1}")
    return out.when(value >= edges[-1], f"{edges[-1]}+")


def histogram(df: DataFrame, value: Column, edges: tuple[int, ...] = (40, 60, 70, 80, 90)) -> DataFrame:
    """Counts by bin."""
    return df.groupBy(bins(value, edges).alias("bin")).agg(F.count("*").alias("n"))


def match_distribution(truth_pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """n_matches and how many entities have so many, those with none included."""
    counts = truth_pairs.groupBy("source1_entity_id").agg(F.count("*").alias("n_matches"))
    ids = entities.select(F.col(entities.columns[0]).alias("source1_entity_id"))
    return ids.join(counts, "source1_entity_id", "left").fillna(0, ["n_matches"]).groupBy("n_matches").agg(F.count("*").alias("entities"))


def match_summary(truth_pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities with no, one and several matches, the most matches, and matches by target source."""
    per = match_distribution(truth_pairs, entities)
    counts = per.agg(
        F.coalesce(F.sum(F.when(F.col("n_matches") == 0, F.col("entities"))), F.lit(0)).alias("zero"), F.coalesce(F.sum(F.when(F.col("n_matches") == 1, F.col("entities"))), F.lit(0)).alias("one"),
        F.coalesce(F.sum(F.when(F.col("n_matches") > 1, F.col("entities"))), F.lit(0)).alias("several"), F.max("n_matches").alias("most"),
    )
    source = F.substring("target_entity_id", 1, 2)
    return counts.join(truth_pairs.agg(F.count_if(source == "S2").alias("to_s2"), F.count_if(source == "S3").alias("to_s3")), how="cross")
