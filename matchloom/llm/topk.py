"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. A block of rows is held as bit slices, one bitmap for
each bit of each attribute. A query's score is summed for all rows of a block at once with
bitmap additions over the high slices; the low slices only bound the error. The best rows
are then selected from the most significant slice of the sum downward, and the rows whose
bounds reach the k-th are resolved with exact integer products.

Every block of rows meets every block of queries in one task, which slices the rows once and then streams the queries past them,
so it holds one bounded block, whatever the table's size. Rows whose numbers are too great for sums in 64 bits are kept beside
the slices and scored with unbounded integers, as are all rows for such a query.

Vectors that are null, empty, or hold a null or non-finite component take no part; all others do, however great.
A query meets only vectors of its own length. Equal scores go to the smaller vec_id, rows that repeat a vec_id each
take a rank; rows of the query's own vec_id are no candidates. Of queries that share a vec_id the one of smallest vector asks.
Scores beyond a long are ranked exactly and returned as the nearest long. Other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
#: Rows of a block, which a task holds, and queries that it streams; rows of a block at least, when there are cores to spare.
ROW_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 65_536, 131_072, 4096
#: Low bits of each attribute that are bounded, not added.
LOW_BITS = 3
#: beyond: a score past a long, shifted to be positive, as bytes that sort like numbers; else null.
SCHEMA = "query_id long, vec_id long, score long, beyond binary"
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Bytes of `beyond`: products of two doubles' integers, scaled, and any number of them summed.
BEYOND_BYTES = 320


class BitSlicedIndex:
    """Bit slices of one block of integer rows."""

    def __init__(self, rows: np.ndarray, low_bits: int = LOW_BITS):
        self.rows = rows
        self.n, self.dims = rows.shape
        self.base = rows.min(0)
        spans = (rows - self.base).max(0)
        self.low = min(low_bits, max(int(spans.max(initial=0)).bit_length(), 1) - 1)
        high = (rows - self.base) >> self.low
        self.slices = [[self.pack((high[:, d] >> b) & 1) for b in range(max((int(spans[d]) >> self.low).bit_length(), 1))] for d in range(self.dims)]
        self.all = self.pack(np.ones(self.n, dtype=np.uint8))

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits.astype(np.uint8), bitorder="little")
        out = np.zeros(-(-len(raw) // 8) * 8, dtype=np.uint8)
        out[: len(raw)] = raw
        return out.view(np.uint64)

    def unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    @staticmethod
    def add(total: list[np.ndarray], term: list[np.ndarray]) -> list[np.ndarray]:
        """Ripple-carry sum of two numbers held as slices, least significant first."""
        if len(total) < len(term):
            total, term = term, total
        out, carry = [], None
        for i, a in enumerate(total):
            if i < len(term):
                b = term[i]
                half = a ^ b
                if carry is None:
                    out.append(half)
                    carry = a & b
                else:
                    out.append(half ^ carry)
                    carry = (a & b) | (half & carry)
            elif carry is None:
                out.append(a)
            else:
                out.append(a ^ carry)
                carry = a & carry
        if carry is not None and carry.any():
            out.append(carry)
        return out

    def weighted(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum |q_d| * y_d, y_d the high part of the attribute, complemented where q_d < 0."""
        size = [int(abs(q)) for q in query]
        terms = [[~s for s in sl] if q < 0 else sl for q, sl in zip(query, self.slices, strict=True)]
        total: list[np.ndarray] = []
        for bit in range(max(size, default=0).bit_length() - 1, -1, -1):
            if total:
                total = [np.zeros_like(self.all), *total]
            level = [terms[d] for d in range(self.dims) if size[d] >> bit & 1]
            while len(level) > 1:  # pairwise, so that sums stay narrow
                level = [self.add(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            if level:
                total = self.add(total, level[0]) if total else list(level[0])
        return total

    def best(self, total: list[np.ndarray], k: int, among: np.ndarray) -> int:
        """The k-th largest sum among the marked rows, found from the most significant slice downward."""
        value, undecided, found = 0, among, 0
        for b in range(len(total) - 1, -1, -1):
            ones = undecided & total[b]
            n = int(np.bitwise_count(ones).sum())
            if found + n >= k:
                value, undecided = value | 1 << b, ones
            else:
                found += n
                undecided = undecided & ~total[b]
        return value

    def at_least(self, total: list[np.ndarray], value: int) -> np.ndarray:
        """Bitmap of the rows whose sum is at least value."""
        above, equal = np.zeros_like(self.all), self.all
        for b in range(max(len(total), value.bit_length()) - 1, -1, -1):
            s = total[b] if b < len(total) else None
            if value >> b & 1:
                equal = equal & s if s is not None else np.zeros_like(self.all)
            elif s is not None:
                above = above | (equal & s)
                equal = equal & ~s
        return above | equal

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best rows and all that tie with the last of them."""
        mine = ids == own
        among = self.all & ~self.pack(mine) if mine.any() else self.all
        here = int(self.n - mine.sum())
        if not here:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        rows = self.unpack(among)
        if here > k:
            total = self.weighted(query)
            # the dropped low bits add from 0 to this much, in units of the sum
            slack = int(np.abs(query).sum()) * ((1 << self.low) - 1) >> self.low
            rows = self.unpack(self.at_least(total, max(0, self.best(total, k, among) - slack - 1)) & among)
        scores = self.rows[rows] @ query
        if len(rows) > k:
            last = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= last], scores[scores >= last]
            order = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
        return rows, scores


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id, v of every vector that takes part; v as it is stored."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return rows.where(finite & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


class Quantised:
    """Vectors of one length as integers floor(scale * x): an array where sums fit 64 bits, lists of unbounded integers elsewhere."""

    def __init__(self, batches: list[pa.RecordBatch], scale: int):
        table = pa.Table.from_batches(batches)
        grid = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        ids = table.column("vec_id").to_numpy()
        self.limit = float(1 << (62 - grid.shape[1].bit_length()) // 2)
        fits = (np.abs(grid) * scale < self.limit - 1).all(1)
        self.ids, self.rows = ids[fits], np.floor(grid[fits] * scale).astype(np.int64)
        self.wide_ids = ids[~fits]
        whole = lambda x: int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale)
        self.wide = [[whole(x) for x in row] for row in grid[~fits].tolist()]


def long_columns(scores: list[int]) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores held within a long, and for those at or past its ends the bytes that sort them."""
    inside = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in scores], dtype=np.int64)
    half = 1 << (8 * BEYOND_BYTES - 1)
    return inside, [None if LONG_MIN < s < LONG_MAX else (s + half).to_bytes(BEYOND_BYTES, "big") for s in scores]


def wide_best(query: list[int], own: int, k: int, parts: list[tuple[np.ndarray, list]]) -> tuple[list[int], list[int]]:
    """vec_ids and exact scores of the k best among parts (ids, rows of unbounded integers)."""
    scored = [(-sum(a * b for a, b in zip(query, row, strict=True)), int(i)) for ids, rows in parts for i, row in zip(ids, rows, strict=True) if i != own]
    best = sorted(scored)[:k]
    return [i for _, i in best], [-s for s, _ in best]


class Block:
    """A block of rows, sliced, that answers queries."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, scale: int):
        self.k, self.scale, self.held = k, scale, Quantised(batches, scale)
        self.index = BitSlicedIndex(self.held.rows) if len(self.held.rows) else None

    def answers(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        q_ids, r_ids, scores, beyond = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []

        def give(own: int, ids, inside: np.ndarray, past: list[bytes | None]) -> None:
            q_ids.append(np.full(len(ids), own, np.int64)), r_ids.append(np.array(ids, np.int64)), scores.append(inside), beyond.extend(past)

        held, asking = self.held, Quantised([queries], self.scale)
        for own, q in zip(asking.ids.tolist(), asking.rows, strict=True):
            if self.index is not None:
                found, exact = self.index.search(q, self.k, held.ids, own)
                give(own, held.ids[found], exact, [None] * len(found))
            if held.wide:
                ids, exact = wide_best(q.tolist(), own, self.k, [(held.wide_ids, held.wide)])
                give(own, ids, *long_columns(exact))
        for own, q in zip(asking.wide_ids.tolist(), asking.wide, strict=True):
            ids, exact = wide_best(q, own, self.k, [(held.ids, held.rows.tolist()), (held.wide_ids, held.wide)])
            give(own, ids, *long_columns(exact))
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in (q_ids, r_ids, scores)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(beyond, pa.binary())], ["query_id", "vec_id", "score", "beyond"])


def runs(batch: pa.RecordBatch):
    """dim, whether they ask, and rows, for each stretch of rows equal in both."""
    dim, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "asks"))
    cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield int(dim[a]), bool(asks[a]), batch.select(["vec_id", "v"]).slice(a, b - a)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of `vectors` for every vec_id of `queries`.

    Both frames have vec_id and v (array of float or double), as vectors_of gives them.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "v"), "slices-rows")
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "slices-queries")
    n = rows.count()
    nr = max(1, -(-n // row_block), min(spark.sparkContext.defaultParallelism, n // min(LEAST_BLOCK, row_block)))
    nq = max(1, -(-asked.count() // query_block))
    part = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shown = "rb", "qb", F.size("v").alias("dim"), "asks", "vec_id", "v"
    a = rows.withColumn("rb", part(nr)).withColumn("asks", F.lit(False)).withColumn("qb", every(nq)).select(*shown)
    b = asked.withColumn("qb", part(nq)).withColumn("asks", F.lit(True)).withColumn("rb", every(nr)).select(*shown)
    met = a.union(b).repartitionById(nr * nq, F.col("rb") * nq + F.col("qb")).sortWithinPartitions("dim", "asks")

    def run(batches):
        now, held, block = None, [], None
        for batch in batches:
            for dim, asks, part_ in runs(batch):
                if dim != now:
                    now, held, block = dim, [], None
                if not asks:
                    held.append(part_)
                elif held or block:
                    block = block or Block(held, k, scale)
                    held = []
                    yield block.answers(part_)

    found = met.select("dim", "asks", "vec_id", "v").mapInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
