"""Data audit: counts, missing values, duplicate keys, label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_and_duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, n_columns, dup_keys, missing_<column> for every column; null keys equal each other."""
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in df.columns]
    distinct = F.count_distinct(F.col(key)) + F.max(F.col(key).isNull().cast("int"))
    out = df.agg(F.count("*").alias("n_rows"), (F.count("*") - distinct).alias("dup_keys"), *nulls)
    return out.withColumn("n_columns", F.lit(len(df.columns))).na.fill(0)


def id_list(matched: Column) -> Column:
    """Ids of a comma-joined string; null and blank have none."""
    return F.when(F.trim(F.coalesce(matched, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.split(matched, ","))


def label_counts(truth: DataFrame) -> DataFrame:
    """Ground truth (source1_entity_id, matched_entity_ids): positives, negatives, multi_match, duplicate_ids."""
    n = F.size(id_list(F.col("matched_entity_ids")))
    return truth.agg(
        F.count_if(n > 0).alias("positives"), F.count_if(n == 0).alias("negatives"), F.count_if(n > 1).alias("multi_match"),
        (F.count("*") - F.count_distinct("source1_entity_id")).alias("duplicate_ids"),
    )


def match_count_distribution(truth: DataFrame, top: int = 10) -> DataFrame:
    """match_count, n: how many records have so many matches; the most common counts first, ties by count."""
    n = F.size(id_list(F.col("matched_entity_ids"))).alias("match_count")
    return truth.groupBy(n).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match_count").limit(top)
