"""A pipeline over `documents`: toxicity, line dedup, near duplicates, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All stages but the
last return the columns of documents; n_chars follows the text. Rows are matched by doc_id and a
hash of the text, so null doc_ids and repeated rows are handled by the operators' own rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import linededup, neardup, packing, substring, toxicity
from matchloom.llm.common import stored, table
from matchloom.session import ship

#: SQL cannot train the toxicity model of the first stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def _as_documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, from row (a struct of them) and the new text; n_chars counted anew."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half."""
    model = toxicity.train(docs, table(ship(spark), sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines or more go; documents of which nothing is left go too.

    Shorter ones are left to the passages stage, so that near copies come whole to the stage that looks for them.
    """
    less = linededup.cut(docs, words=None)
    return _as_documents(less.where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t\\n\\r\\x0B\\f]")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id."""
    return neardup.keep_one(ship(spark) and docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; documents of which nothing is left go too."""
    less = substring.cut(ship(spark) and docs)
    return _as_documents(less.where((F.col("n_removed") == 0) | (F.col("text") != "")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(ship(spark) and docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
