"""License scan by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of every text is hashed (k is BASE_K for the base phrases, K for templates) and joined with the
k-grams of the templates, a broadcast table whose size the template list fixes. A hit counts if the words themselves are equal. Hits vote
for a diagonal, text position minus template position; neighbouring diagonals are merged, so that inserted or lost
words do not break a match: they may lie DRIFT apart, or a tenth of a long template. A span is verified by the share of the
template's words that stand in it; of templates that begin at about the same place the best counts. Base phrases must stand whole on one diagonal.

Templates are a parameter; the default holds public notices and bodies. A template of fewer than K words is not found.

Null and empty texts have no words and no labels. Repeated rows give repeated rows; rows are told apart by doc_id
and a hash of the text, null doc_ids included. Other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_texts import TEMPLATES

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_K, K, DRIFT, COVERAGE = 2, 3, 2, 0.8


def word_array(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """word_array for one text."""
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def gram_hash(ws: list[str]) -> int:
    """The hash that xxhash64() gives to these words as columns, as a signed number."""
    h = 42
    for w in ws:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def grams(templates: list[tuple[str, str]]) -> list[tuple[int, list[str], int, int, str, int, int]]:
    """hash, words, position, template, label, words of the template, k; base phrases have negative template numbers."""
    rows = [(-1 - i, label, phrase.split(), BASE_K) for i, (phrase, label) in enumerate(BASE.items())]
    rows += [(i, label, plain_words(text), K) for i, (text, label) in enumerate(templates)]
    return [(gram_hash(ws[p : p + k]), ws[p : p + k], p, t, label, len(ws), k) for t, label, ws, k in rows for p in range(len(ws) - k + 1)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE, drift: int = DRIFT) -> tuple[DataFrame, DataFrame]:
    """Two frames: each row's doc_id, row key and n_words; and the verified spans.

    A span has row key, template, label, base, first, last (word positions, inclusive) and coverage.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), word_array(docs["text"]).alias("w"))
    sized = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    table = grams(templates)
    known = spark.createDataFrame(table, "h long, words array<string>, tpos int, template int, label string, len int, k int")

    def rolling(k: int) -> Column:
        """(pos, h, words) of the k-grams whose hash some template has."""
        hashes = sorted({r[0] for r in table if r[-1] == k})
        all_ = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get("w", i + j) for j in range(k))).alias("h")))
        held = F.filter(all_, lambda x: x["h"].isin(hashes))
        found = F.transform(held, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.slice("w", x["pos"] + 1, k).alias("words")))
        return F.when(F.size("w") >= k, found).otherwise(F.array().cast("array<struct<pos:int,h:bigint,words:array<string>>>"))

    met = rows.select("doc_id", "th", F.explode(F.concat(*(rolling(k) for k in sorted({BASE_K, K})))).alias("x")).select("doc_id", "th", "x.*")
    hits = met.join(F.broadcast(known), ["h", "words"])  # as many rows as the templates have words
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = hits.groupBy("doc_id", "th", "template", "diagonal").agg(
        F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.first("label").alias("label"), F.first("len").alias("len"), F.first("k").alias("k"),
    )
    reach = F.greatest(F.lit(drift), F.floor(F.col("len") / 10))
    order = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    apart = (F.col("template") < 0) | (F.col("diagonal") - F.lag("diagonal").over(order) > reach)
    apart = apart | (F.col("first") > F.lag("last").over(order) + F.col("len")) | (F.col("last") + F.col("len") < F.lag("first").over(order))
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("doc_id", "th", "template", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.first("label").alias("label"), F.first("len").alias("len"), F.first("k").alias("k"),
    ).withColumn("last", F.col("last") + F.col("k") - 1)
    stand = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    share = stand / F.col("len")
    every = F.size("seen") == F.col("len") - F.col("k") + 1
    whole = F.when(F.col("template") < 0, every).otherwise((share >= coverage) & (F.col("last") - F.col("first") + 1 <= F.col("len") + 2 * reach))
    spans = spans.withColumn("coverage", share).withColumn("base", F.col("template") < 0).where(whole)
    place = Window.partitionBy("doc_id", "th").orderBy(F.col("first").cast("long")).rangeBetween(-2 * drift, 2 * drift)
    best = F.max(F.when(~F.col("base"), F.col("coverage"))).over(place)
    spans = spans.withColumn("best", best).where(F.col("base") | (F.col("coverage") >= F.col("best")))
    return sized, spans.select("doc_id", "th", "template", "label", "base", "first", "last", "coverage")


def label(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's coverage)."""
    sized, spans = scan(docs, templates)
    base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "th").agg(
        F.count(base("first")).alias("n_base"),
        F.min(base("first")).cast("long").alias("first_word"),
        F.max(base("first")).cast("long").alias("last_word"),
        joined(base("label")).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    same = reduce(lambda a, b: a & b, (sized[c].eqNullSafe(found[c]) for c in ("doc_id", "th")))
    return sized.join(found, same, "left").select(
        sized["doc_id"], "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
