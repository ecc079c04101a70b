"""Cosine top-k of many queries against many short records, block by block.

Partial sums of pairs never travel. Records are dealt into blocks; one task indexes a block in arrays, the queries are streamed past it, and
only each query's k best of the block leave the task. Within a block a query is pruned as retrieve.search_pruned prunes it: exact scores of a first
pool bound the k-th best from below, the commonest terms that cannot reach that bound together bring in no candidates, and every score is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import index

#: Records whose postings one task makes; postings of a block, which bounds a worker's memory, and records that a block holds at least; postings of
#: the rare terms that give a query's first pool, in candidates wanted; share of the bound that terms without candidates reach at most, so that few
#: candidates are scored in vain; room for rounding in bounds; digits that decide an order.
TASK_RECORDS, BLOCK_POSTINGS, LEAST_RECORDS = 20_000, 4_000_000, 2000
SEED_POSTINGS, IDLE, ROOM, DIGITS = 20, 0.5, 1e-6, 9


def lists(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of all rows in one array, where each row's begin (and the last one's end), and their unit weights."""
    counts = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
    flat = pa.chunked_array([c.flatten() for c in table.column("terms").chunks], pa.string()).combine_chunks()
    raw = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("raw").chunks])
    return flat, np.concatenate([[0], np.cumsum(counts)]), raw / np.repeat(table.column("norm").to_numpy(), counts)


class Block:
    """The records of a block, smallest id first, by term and by record."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(batches)
        self.k, self.ids = k, table.column("s2_id").combine_chunks()
        flat, self.start, self.weights = lists(table)
        coded = flat.dictionary_encode()
        self.terms, self.codes = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(self.codes, kind="stable")
        self.records = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.start))[order]
        self.held = self.weights[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(self.terms)))])
        self.top = np.maximum.reduceat(self.held, self.at[:-1]) if len(self.held) else self.held
        self.sums, self.asked = np.zeros(len(self.ids)), np.zeros(len(self.terms))

    def add(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Add the products of these terms to the records' sums; the records met, once a posting."""
        spans = list(zip(self.at[terms].tolist(), self.at[terms + 1].tolist(), weights.tolist(), strict=True))
        met = np.concatenate([self.records[a:b] for a, b, _ in spans])
        np.add.at(self.sums, met, np.concatenate([self.held[a:b] * w for a, b, w in spans]))
        return met

    @staticmethod
    def distinct(records: np.ndarray) -> np.ndarray:
        """The same records, each once, smallest first."""
        records = np.sort(records)
        return records[np.concatenate([[True], records[1:] != records[:-1]])] if len(records) else records

    def exact(self, records: np.ndarray) -> np.ndarray:
        """Whole scores of these records for the query in self.asked."""
        begin = self.start[records]
        counts = self.start[records + 1] - begin
        first = np.cumsum(counts) - counts
        places = np.repeat(begin - first, counts) + np.arange(counts.sum())
        return np.add.reduceat(self.asked[self.codes[places]] * self.weights[places], first)

    def bound(self, terms: np.ndarray, weights: np.ndarray, posts: np.ndarray) -> float:
        """No more than the k-th best score, from the best of the records that hold the rarest terms; zero if fewer than k hold any term."""
        least = SEED_POSTINGS * self.k
        while True:
            n = min(len(terms), int(np.searchsorted(np.cumsum(posts[::-1]), least)) + 1)
            pool = self.distinct(self.add(terms[-n:], weights[-n:]))
            found = self.sums[pool]
            self.sums[pool] = 0
            if len(pool) >= self.k:
                pool = pool[np.argpartition(-found, 2 * self.k)[: 2 * self.k]] if len(pool) > 2 * self.k else pool
                return float(np.partition(self.exact(pool), -self.k)[-self.k]) - ROOM
            if n == len(terms):
                return 0.0
            least *= 4

    def best(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records and scores of a query's k best, ties to smaller ids."""
        posts = self.at[terms + 1] - self.at[terms]
        order = np.argsort(-posts, kind="stable")
        terms, weights, posts = terms[order], weights[order], posts[order]
        self.asked[terms] = weights
        bound = self.bound(terms, weights, posts)
        rest = np.minimum(np.cumsum(weights * self.top[terms]), np.sqrt(np.cumsum(weights * weights)))
        idle = int(np.searchsorted(rest, bound * IDLE))
        met = self.add(terms[idle:], weights[idle:]) if idle < len(terms) else np.empty(0, np.int32)
        records = self.distinct(met[self.sums[met] + (rest[idle - 1] if idle else 0.0) >= bound])
        scores = self.exact(records) if len(records) else np.empty(0)
        self.sums[met] = 0
        self.asked[terms] = 0
        rounded = np.round(scores, DIGITS)
        first = np.lexsort((records, -rounded))[: self.k]
        first = first[rounded[first] > 0]
        return records[first], scores[first]

    def answers(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        flat, start, weights = lists(pa.Table.from_batches([queries]))
        codes = pc.fill_null(pc.index_in(flat, value_set=self.terms), -1).to_numpy()
        asks, records, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for i in range(queries.num_rows):
            own = slice(start[i], start[i + 1])
            known = codes[own] >= 0
            if known.any():
                found, score = self.best(codes[own][known], weights[own][known])
                asks.append(np.full(len(found), i)), records.append(found), scores.append(score)
        asks, records, scores = map(np.concatenate, (asks, records, scores))
        return pa.RecordBatch.from_arrays([queries.column("s1_id").take(pa.array(asks)), self.ids.take(pa.array(records)), pa.array(scores)], ["s1_id", "s2_id", "score"])


def cosines(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, tokenizer: Callable[[Column], Column], k: int,
            max_features: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """s1_id, s2_id, score: the k best positive TF-IDF cosines of each query in each block of the corpus, unranked.

    Records are dealt by id once, as texts; their postings, weights and norms are made where they lie. The vocabulary, max_features terms at
    most, goes to every executor.
    """
    cores, n = corpus.sparkSession.sparkContext.defaultParallelism, corpus.count()
    parts = lambda n: max(cores, -(-n // TASK_RECORDS))
    dealt = lambda df, n, id_, x: index.postings(df.select(id_, x).repartition(parts(n), id_), id_, tokenizer(F.col(x)))
    posts, asked = dealt(corpus, n, key, text), dealt(queries, queries.count(), query_key, query_text)
    sought = asked.select("term").distinct().withColumn("sought", F.lit(True))
    vocab = stored(index.tfidf_vocabulary(posts, n, max_features).join(sought, "term", "left"), "vocabulary")
    total = vocab.agg(F.sum(F.when(F.col("sought"), F.col("df")))).first()[0] or 0
    blocks = max(1, -(-total // block_postings), min(cores, n // LEAST_RECORDS))
    blocks = -(-blocks // cores) * cores if blocks > cores else blocks

    def vectors(rows: DataFrame) -> DataFrame:
        """id, terms and raw weights of those that queries hold, norm of all."""
        raw = rows.join(F.broadcast(vocab), "term").select("id", F.when(F.col("sought"), F.col("term")).alias("term"), (F.col("tf") * F.col("idf")).alias("raw"))
        return raw.groupBy("id").agg(
            F.collect_list("term").alias("terms"), F.collect_list(F.when(F.col("term").isNotNull(), F.col("raw"))).alias("raw"),
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        )

    kinds = [df.schema[x].dataType.simpleString() for df, x in ((queries, query_key), (corpus, key))]
    shown = ["block", "s1_id", "s2_id", "terms", "raw", "norm"]
    a = vectors(posts).where(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    a = a.select("block", F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("s1_id"), F.col("id").alias("s2_id"), "terms", "raw", "norm")
    b = vectors(asked).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = b.select("block", F.lit(True).alias("asks"), F.col("id").alias("s1_id"), F.lit(None).cast(kinds[1]).alias("s2_id"), "terms", "raw", "norm")
    met = a.union(b).repartitionById(blocks, "block").sortWithinPartitions("asks", "s2_id").select("asks", *shown[1:])

    def run(batches: Iterator) -> Iterator:
        held, block = [], None
        for batch in batches:
            records = pc.sum(pc.invert(batch.column("asks"))).as_py() or 0
            if records:
                held.append(batch.slice(0, records))
            if records < batch.num_rows and (held or block):
                block = block or Block(held, k)
                held = []
                yield block.answers(batch.slice(records))

    return met.mapInArrow(run, f"s1_id {kinds[0]}, s2_id {kinds[1]}, score double")
