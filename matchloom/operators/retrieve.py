"""Top-k similarity joins: postings joined on term, weights summed by pair, ranked by query.

Scores are rounded to 9 digits before ranking, so that the order of a distributed sum cannot
decide a tie; ties go to the smaller candidate id. Output columns: s1_id, s2_id, rank, score.

A search is exact, but does not sum all pairs that share a term. A few rare terms of each query give a pool whose exact scores
bound the k-th best from below; the most frequent terms of the query that cannot reach that bound together then bring in no candidates of their own,
and are looked up only for candidates that can still reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from . import index

DIGITS = 9
#: Postings of the rare terms that give a query's first pool, in candidates wanted; and room for rounding in bounds.
SEED_POSTINGS, ROOM = 20, 1e-6


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query by (score desc, s2_id); ranks from 1."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("score"), "s2_id")
    rounded = scored.withColumn("score", F.round("score", DIGITS))
    ranked = rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("s1_id", "s2_id", "rank", "score")


def sum_products(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """s1_id, s2_id, score: sum of weight products over shared terms; both sides have id, term, weight."""
    a = queries.select(F.col("id").alias("s1_id"), "term", F.col("weight").alias("wq"))
    b = corpus.select(F.col("id").alias("s2_id"), "term", F.col("weight").alias("wd"))
    return a.join(b, "term").groupBy("s1_id", "s2_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def sum_within(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """sum_products for the pairs (s1_id, s2_id) alone: the corpus is met by (record, term), never by a term."""
    wanted = pairs.select("s1_id", "s2_id").join(queries.select(F.col("id").alias("s1_id"), "term", F.col("weight").alias("wq")), "s1_id")
    held = corpus.select(F.col("id").alias("s2_id"), "term", F.col("weight").alias("wd"))
    return wanted.join(held, ["s2_id", "term"]).groupBy("s1_id", "s2_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def search_pruned(queries: DataFrame, corpus: DataFrame, k: int, unit: bool) -> DataFrame:
    """top_k of sum_products, positive scores only. Both sides have id, term, weight >= 0; unit: no corpus record has a norm above 1."""
    known = corpus.join(queries.select("term").distinct(), "term", "left_semi")
    corpus = stored(known.select("id", "term", "weight"), "postings")
    tops = corpus.groupBy("term").agg(F.max("weight").alias("top"), F.count("*").alias("posts"))
    rarest, commonest = (Window.partitionBy("id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("posts", "term"), (F.desc("posts"), F.desc("term"))))
    asked = queries.join(tops, "term").select("id", "term", "weight", "posts", (F.col("weight") * F.col("top")).alias("most"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(commonest))
    sums = F.sum("most").over(commonest)
    asked = asked.withColumns({"met": F.sum("posts").over(rarest) - F.col("posts"), "rest": F.least(sums, norm) if unit else sums})
    asked = stored(asked, "asked-terms")
    first = sum_products(asked.where(F.col("met") < SEED_POSTINGS * k), corpus)
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "s2_id")
    pool = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k)
    exact = sum_within(pool, asked, corpus).withColumn("place", F.row_number().over(best)).where(F.col("place") == k)
    bound = exact.select(F.col("s1_id").alias("id"), F.col("score").alias("bound"))
    asked = stored(asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - ROOM), "bound-terms")
    idle = F.col("rest") < F.col("bound")
    part = sum_products(asked.where(~idle), corpus)
    spare = asked.where(idle).groupBy("id").agg(F.max("rest").alias("spare"), F.max("bound").alias("bound"))
    part = part.join(spare.withColumnRenamed("id", "s1_id"), "s1_id", "left")
    part = part.where(F.col("spare").isNull() | (F.col("score") + F.col("spare") >= F.col("bound"))).drop("bound")
    part = stored(part, "candidates")
    open_ = part.where("spare is not null")
    more = sum_within(open_, asked.where(idle), corpus)
    both = part.where("spare is null").select("s1_id", "s2_id", "score").union(open_.select("s1_id", "s2_id", "score")).union(more)
    return top_k(both.groupBy("s1_id", "s2_id").agg(F.sum("score").alias("score")).where(F.col("score") > 0), k)


def padded(found: DataFrame, queries: DataFrame, key: str, ids: DataFrame, k: int) -> DataFrame:
    """found (top k of positive scores) filled up to k rows a query with zero scores, smallest ids first. ids: id of every record.

    If fewer than k candidates score, at least k + 1 of the 2k smallest ids score zero, so those suffice.
    """
    asked = queries.select(F.col(key).alias("s1_id"))
    first = ids.select(F.col("id").alias("s2_id")).orderBy("s2_id").limit(2 * k)
    zero = asked.join(F.broadcast(first)).select("s1_id", "s2_id", F.lit(0.0).alias("score"))  # 2k rows a query
    every = found.select("s1_id", "s2_id", "score").unionByName(zero).groupBy("s1_id", "s2_id").agg(F.max("score").alias("score"))
    return top_k(every, k)


class Retriever:
    """An index over one corpus view: weights (id, term, df, weight), vocab (term, df, ...) and ids (id of every record)."""

    #: What a saved index holds besides its tables.
    SETTINGS: tuple[str, ...] = ()

    def __init__(self, tokenizer: Callable[[Column], Column], weights: DataFrame, vocab: DataFrame, ids: DataFrame, **settings):
        self.tokenizer, self.weights, self.vocab, self.ids = tokenizer, weights, vocab, ids
        for name in self.SETTINGS:
            setattr(self, name, settings.get(name))

    def save(self, path: str) -> None:
        """The index as Parquet tables and its settings as JSON."""
        spark = self.weights.sparkSession
        for name in ("weights", "vocab", "ids"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        settings = ", ".join(f"{name} {'array<string>' if isinstance(getattr(self, name), list) else 'long'}" for name in self.SETTINGS)
        if settings:
            spark.createDataFrame([tuple(getattr(self, name) for name in self.SETTINGS)], settings).write.mode("overwrite").json(f"{path}/settings", ignoreNullFields=False)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Callable[[Column], Column]) -> Retriever:
        """A saved index, ready to search; tokenizer must be the one it was made with."""
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("weights", "vocab", "ids")]
        settings = spark.read.json(f"{path}/settings").first().asDict() if cls.SETTINGS else {}
        return cls(tokenizer, *tables, **settings)


class TfidfRetriever(Retriever):
    """TF-IDF cosine over one corpus view; fit once, search with any queries."""

    @classmethod
    def fit(cls, corpus: DataFrame, key: str, text: str, tokenizer: Callable[[Column], Column], max_features: int | None = None) -> TfidfRetriever:
        posts = index.postings(corpus, key, tokenizer(F.col(text)))
        posts = stored(posts, "term-counts")
        vocab = stored(index.tfidf_vocabulary(posts, corpus.count(), max_features), "vocabulary")
        return cls(tokenizer, stored(index.tfidf_weights(posts, vocab), "term-weights"), vocab, corpus.select(F.col(key).alias("id")))

    def transform(self, queries: DataFrame, key: str, text: str, max_df: int | None = None) -> DataFrame:
        """id, term, df, weight of the queries; unknown terms are dropped before the norm, terms above max_df after it."""
        q = index.tfidf_weights(index.postings(queries, key, self.tokenizer(F.col(text))), self.vocab)
        return stored(q if max_df is None else q.where(F.col("df") <= max_df), "query-weights")

    def search(self, queries: DataFrame, key: str, text: str, k: int, max_df: int | None = None) -> DataFrame:
        """Cosine top-k with positive scores; masked if max_df is given."""
        return search_pruned(self.transform(queries, key, text, max_df), self.weights, k, unit=True)

    def search_padded(self, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
        """Cosine top-k that fills up with zero scores, smallest ids first."""
        return padded(self.search(queries, key, text, k), queries, key, self.ids, k)

    def search_blocked(self, queries: DataFrame, key: str, text: str, k: int, max_posting: int = 50_000, max_terms: int = 10, max_pool: int = 2000) -> DataFrame:
        """Candidates by the rarest terms first, then exact cosine over them.

        Terms run by (df, term). One with a posting above max_posting is skipped unless it is the first; at most
        max_terms are used, and none once the pool holds more than max_pool; the pool is cut to max_pool by (first term, id).
        """
        q = self.transform(queries, key, text)
        rarest = Window.partitionBy("id").orderBy("df", "term")
        usable = q.withColumn("n", F.row_number().over(rarest)).where((F.col("df") <= max_posting) | (F.col("n") == 1))
        usable = usable.withColumn("turn", F.row_number().over(rarest)).where(F.col("turn") <= max_terms)
        hits = usable.select(F.col("id").alias("s1_id"), "term", "turn").join(self.weights.select(F.col("id").alias("s2_id"), "term"), "term")
        pool = stored(hits.groupBy("s1_id", "s2_id").agg(F.min("turn").alias("turn")), "pool")
        added = pool.groupBy("s1_id", "turn").agg(F.count("*").alias("n"))
        before = Window.partitionBy("s1_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        allowed = added.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") <= max_pool)
        pool = pool.join(allowed.select("s1_id", "turn"), ["s1_id", "turn"])
        cut = Window.partitionBy("s1_id").orderBy("turn", "s2_id")
        pool = pool.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= max_pool)
        return top_k(sum_within(pool, q, self.weights).where(F.col("score") > 0), k)


class Bm25Retriever(Retriever):
    """BM25 over one corpus view.

    length_tokenizer counts a record's length (it may keep stop words that the index drops); query_stop
    and max_posting act at query time, min_df, max_df and max_features when the index is built.
    """

    SETTINGS = ("query_stop", "max_posting")

    @classmethod
    def fit(cls, corpus: DataFrame, key: str, text: str, tokenizer: Callable[[Column], Column], length_tokenizer: Callable[[Column], Column] | None = None, min_df: int = 1, max_df: int | None = None,
            max_features: int | None = None, query_stop: list[str] | None = None, max_posting: int | None = None, scaled: bool = True) -> Bm25Retriever:
        count = length_tokenizer or tokenizer
        posts = stored(index.postings(corpus, key, tokenizer(F.col(text))), "term-counts")
        lengths = corpus.select(F.col(key).alias("id"), F.size(count(F.col(text))).alias("dl"))
        vocab = stored(index.vocabulary(posts, min_df, max_df, max_features), "vocabulary")
        weights = stored(index.bm25_weights(posts, lengths, vocab, corpus.count(), scaled=scaled), "term-weights")
        return cls(tokenizer, weights, vocab, corpus.select(F.col(key).alias("id")), query_stop=query_stop or [], max_posting=max_posting)

    def search(self, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
        """Top-k by the summed weights of a query's distinct terms."""
        terms = queries.select(F.col(key).alias("id"), F.explode(F.array_distinct(self.tokenizer(F.col(text)))).alias("term"))
        terms = terms.where(~F.col("term").isin(self.query_stop)) if self.query_stop else terms
        index_ = self.weights if self.max_posting is None else self.weights.where(F.col("df") <= self.max_posting)
        return search_pruned(stored(terms.withColumn("weight", F.lit(1.0)), "query-terms"), index_, k, unit=False)

    def search_padded(self, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
        """Exactly k rows a query, or all records if they are fewer; zero scores fill up, smallest ids first."""
        return padded(self.search(queries, key, text, k), queries, key, self.ids, k)


def exact_lookup(queries: DataFrame, key: str, text: Column, corpus: DataFrame, corpus_key: str, corpus_text: Column, most: int = 100) -> DataFrame:
    """Candidates of equal non-empty text, the first `most` by id; score 1."""
    a = queries.select(F.col(key).alias("s1_id"), text.alias("t")).where("t <> ''")
    b = corpus.select(F.col(corpus_key).alias("s2_id"), corpus_text.alias("t"))
    order = Window.partitionBy("t").orderBy("s2_id")
    b = b.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return a.join(b, "t").select("s1_id", "s2_id", "rank", F.lit(1.0).alias("score"))


def encode(df: DataFrame, key: str, text: str, make_encoder: Callable[[], Callable]) -> DataFrame:
    """id, v: unit vectors of the texts that are not blank.

    make_encoder runs once in each worker and returns a function from a list of texts to rows of numbers (a sentence model, say). Where it raises
    ImportError or OSError, as for a model that is not there, no text gets a vector.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        try:
            encoder = make_encoder()
        except (ImportError, OSError):
            encoder = None
        for batch in batches:
            batch = batch[batch["text"].str.strip() != ""] if encoder else batch[:0]
            if len(batch):
                v = np.asarray(encoder(batch["text"].tolist()), dtype=float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": batch["id"], "v": list(v)})

    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, v array<double>")


def dense(queries: DataFrame, corpus: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Dot-product top-k of vectors, stored ones or those of encode(), no score filter. Both sides have id, v (array of double); null vectors take no part.

    Queries and corpus meet in blocks of bounded size, one native dot product a pair.
    """
    a = queries.where("v is not null").select(F.col("id").alias("s1_id"), F.col("v").alias("vq"))
    b = corpus.where("v is not null").select(F.col("id").alias("s2_id"), F.col("v").alias("vd"))
    n = max(1, -(-b.count() // block))
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = b.withColumn("block", F.pmod(F.xxhash64("s2_id"), F.lit(n)).cast("int"))
    dot = F.aggregate(F.zip_with("vq", "vd", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return top_k(a.join(b, "block").select("s1_id", "s2_id", dot.alias("score")), k)
