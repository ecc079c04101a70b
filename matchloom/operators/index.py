"""Postings, vocabularies and weights as plain long tables.

A posting is (id, term, tf). Every table is partitioned by term or by id through ordinary shuffles;
nothing is held as a driver-side dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """id, term, tf of every record with at least one token."""
    return df.select(F.col(key).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(posts: DataFrame, min_df: int = 1, max_df: int | None = None, max_features: int | None = None, by: str = "df") -> DataFrame:
    """term, df; optionally the terms within df bounds, and of them those of largest `by`: df or tf, the uses in all records (ties by term)."""
    vocab = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    if max_df is not None:
        vocab = vocab.where(F.col("df") <= max_df)
    if max_features:
        vocab = vocab.orderBy(F.desc(by), "term").limit(max_features)
    return vocab.select("term", "df")


def tfidf_vocabulary(posts: DataFrame, n_docs: int, max_features: int | None = None) -> DataFrame:
    """term, df, idf = ln((1 + N) / (1 + df)) + 1; max_features takes the terms used most often."""
    idf = F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    return vocabulary(posts, max_features=max_features, by="tf").withColumn("idf", idf)


def evidence_idf(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """term, idf = ln(N / (df + 1)); N counts records without text too, df does not; may be negative."""
    n = df.count()
    vocab = vocabulary(postings(df, key, F.array_distinct(tokens)))
    return vocab.select("term", F.ln(F.lit(float(n)) / (F.col("df") + 1)).alias("idf"))


def tfidf_weights(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, term, df, weight: tf * idf over the norm of the record's known terms."""
    raw = posts.join(vocab, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "df", (F.col("raw") / norm).alias("weight"))


def bm25_weights(posts: DataFrame, lengths: DataFrame, vocab: DataFrame, n_docs: int, k1: float = 1.5, b: float = 0.75, scaled: bool = True) -> DataFrame:
    """id, term, df, weight of a BM25 index; lengths has id, dl for every record, also those without postings.

    scaled: with the factor k1 + 1, which changes no order.
    """
    mean = lengths.agg(F.avg("dl").alias("avgdl"))  # one row
    idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (k1 + 1 if scaled else 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    joined = posts.join(vocab, "term").join(lengths, "id").join(F.broadcast(mean))
    return joined.select("id", "term", "df", (idf * part).alias("weight"))
