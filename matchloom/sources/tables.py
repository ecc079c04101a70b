"""Readers and writers: delimited text, Parquet, JSON, submissions, resumable stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieve import Retriever

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: Fields that a well-known reader takes for missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, null_tokens: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Tab-separated text with a header, all columns as strings; only the empty field is null unless null_tokens says more."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, recursiveFileLookup=recursive)
    if not null_tokens:
        return df
    return df.select(*(F.when(~F.col(c).isin(null_tokens), F.col(c)).alias(c) for c in df.columns))


def pick(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*(c for c in wanted if c in df.columns))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key; the same ones on every run."""
    return df.orderBy(key).limit(n)


def part_of(df: DataFrame, key: str, part: int, parts: int) -> DataFrame:
    """One of `parts` disjoint slices, stable under re-reading."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def write_candidates(df: DataFrame, path: str) -> None:
    """Parquet, one folder for each view."""
    df.write.mode("overwrite").partitionBy("view").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; make() is written there first unless a finished one is there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def convert(df: DataFrame, transform, path: str) -> dict[str, int]:
    """Write transform(df) as Parquet; rows in and out and missing addresses, counted on the way."""
    seen = Observation()
    out = transform(df).observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum("address_missing"), F.lit(0)).alias("address_missing"))
    out.write.mode("overwrite").parquet(path)
    return dict(seen.get)


def save_index(retriever: Retriever, path: str) -> None:
    """A fitted index as Parquet tables."""
    retriever.save(path)


def load_index(spark: SparkSession, kind: type[Retriever], path: str, tokenizer) -> Retriever:
    """A saved index of a kind (TfidfRetriever, Bm25Retriever), ready to search without fitting; its tokenizer must be the one it was made with."""
    return kind.load(spark, path, tokenizer)


def write_submission(matches: DataFrame, candidates: DataFrame, every: DataFrame, path: str) -> None:
    """Matches and candidate pairs as two TSV tables, after checks.

    matches: source1_entity_id, matched_entity_ids; candidates: source1_entity_id, candidate_entity_ids; every: s1_id.
    """
    if matches.columns != ["source1_entity_id", "matched_entity_ids"] or candidates.columns != ["source1_entity_id", "candidate_entity_ids"]:
        raise ValueError("unexpected columns in a submission")
    rows, ids = matches.agg(F.count("*"), F.count_distinct("source1_entity_id")).first()
    wanted = every.select(F.col("s1_id").alias("source1_entity_id"))
    for name, table in (("matches", matches), ("candidates", candidates)):
        if not table.join(wanted, "source1_entity_id", "left_anti").isEmpty():
            raise ValueError(f"{name} have ids that the clean source has not")
    if rows != ids or not wanted.join(matches, "source1_entity_id", "left_anti").isEmpty():
        raise ValueError("a submission has one row for each record of the clean source")
    own = matches.join(candidates, "source1_entity_id", "left")
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")
    if not own.where(F.size(F.array_except(split("matched_entity_ids"), split("candidate_entity_ids"))) > 0).isEmpty():
        raise ValueError("a match is no candidate")
    write_tsv(matches, f"{path}/matches")
    write_tsv(candidates, f"{path}/candidate_pairs")
