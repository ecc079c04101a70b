"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts lie together. Exact byte
counts below candidate boundaries are taken in rounds: each round refines only the cells
that hold a wanted quantile, until every splitter is within tolerance; one exchange then
deals the rows. The driver sees at most CELLS counts for each splitter and round. Shards are cut further, with a looser
tolerance, into parts of about PART_ROWS rows, as many as it takes; each part is one partition of the exchange.

Law `bytes`: shard sizes are near equal. Equal texts stay in one shard unless their group is
larger than the tolerance; then it is cut by doc_id. Rows that agree in text and doc_id are
never parted. Null texts have size 1, null doc_ids hash like any value, other columns pass
through `shard` unless they clash with the added ones, an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_size

#: Adds up to unsigned order.
HALF = Decimal(1 << 63)
BITS = 8
CELLS = 1 << BITS
#: Allowed gap between a shard's boundary and its quantile, as a share of a shard; the same for parts of a shard.
TOLERANCE, PART_TOLERANCE = 0.002, 0.25
#: Rows that one task of the exchange sorts.
PART_ROWS = 2_000_000


@dataclass
class Splitter:
    """A wanted byte count, how far off it may be, and the boundary (128-bit key, exclusive upper end) found so far."""

    want: int
    slack: float
    key: int = 0
    below: int = 0
    cell: int = 0
    done: bool = False


def key_columns(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Two longs whose unsigned order is the sort order; the sign bit is flipped so that signed order agrees."""
    return F.xxhash64(text), F.xxhash64(doc_id, F.lit(1))


def splitters(keyed: DataFrame, wants: list[tuple[int, float]]) -> list[tuple[int, int]]:
    """Boundaries (hi, lo) as signed longs, ascending: rows at or above the i-th follow splitter i. wants: byte counts and slacks.

    keyed has hi, lo (long) and size (long). Each round counts exact bytes in CELLS cells of every open prefix.
    """
    open_ = [Splitter(*w) for w in wants]
    for level in range(0, 128, BITS):
        prefixes = sorted({s.cell for s in open_ if not s.done})
        if not prefixes:
            break
        bits = min(BITS, 128 - level)
        cell = cell_of(level + bits)
        rows = keyed if level == 0 else keyed.where(inside(level, prefixes))
        got = rows.groupBy(*cell).agg(F.sum("size").alias("bytes")).collect()  # at most CELLS a splitter
        counts = {(int(r[0]) << max(0, level + bits - 64) | int(r[1])): r["bytes"] for r in got}
        by: dict[int, list[int]] = {}
        for c in sorted(counts):
            by.setdefault(c >> bits, []).append(c)
        for s in open_:
            if s.done:
                continue
            run, last = s.below, s.cell << bits
            for c in by.get(s.cell, []):
                if run + counts[c] > s.want:
                    last = c
                    break
                run, last = run + counts[c], c + 1
            held = counts.get(last, 0)
            s.below, s.cell = run, last
            if s.want - run <= s.slack:
                s.done, s.key = True, last << (128 - level - bits)
            elif run + held - s.want <= s.slack:
                s.done, s.key, s.below = True, (last + 1) << (128 - level - bits), run + held
            else:
                s.key = (last + (run + held - s.want < s.want - run)) << (128 - level - bits)
    top = (1 << 128) - 1
    signed = lambda v: v - (1 << 63)
    return [(signed(min(s.key, top) >> 64), signed(min(s.key, top) & ((1 << 64) - 1))) for s in open_]


def unsigned_top(c: str, bits: int) -> Column:
    """The highest bits of a column in flipped unsigned order."""
    flipped = F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, 64 - bits) if bits < 64 else F.col(c)


def cell_of(bits: int) -> list[Column]:
    """Columns that name the cell of so many leading bits: the part in hi, the part in lo."""
    if bits < 64:
        return [F.lit(0).alias("a"), unsigned_top("hi", bits).alias("b")]
    hi = (F.col("hi").cast("decimal(20,0)") + F.lit(HALF)).alias("a")
    lo = F.lit(0) if bits == 64 else unsigned_top("lo", bits - 64)
    if bits == 128:
        lo = F.col("lo").cast("decimal(20,0)") + F.lit(HALF)
    return [hi, lo.alias("b")]


def inside(level: int, prefixes: list[int]) -> Column:
    """Rows whose leading bits are one of the prefixes."""
    if level < 64:
        return unsigned_top("hi", level).isin(prefixes)
    low = level - 64
    found = F.lit(False)
    for p in prefixes:
        hit = F.col("hi") == F.lit((p >> low) - (1 << 63))
        found = found | (hit & (unsigned_top("lo", low) == F.lit(p & ((1 << low) - 1))) if low else hit)
    return found


def place(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or below a row's key, as a balanced decision tree."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        hi, lo = bounds[mid]
        under = (F.col("hi") < F.lit(hi)) | ((F.col("hi") == F.lit(hi)) & (F.col("lo") < F.lit(lo)))
        return F.when(under, tree(a, mid)).otherwise(tree(mid + 1, b))

    return tree(0, len(bounds)).cast("int")


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS, carry: list[Column] | None = None) -> DataFrame:
    """docs with size, shard and slot (its place in the shard's key order, gapless from 0).

    carry: what the exchange takes along in place of the columns of docs. Ties of the whole key are rows
    equal in doc_id and text; their order among themselves is free.
    """
    carry = carry or [docs[c] for c in docs.columns if c not in ("size", "shard", "slot")]
    hi, lo = key_columns(docs["text"], docs["doc_id"])
    rows = docs.select(F.struct(*carry).alias("row"), hi.alias("hi"), lo.alias("lo"), text_size(docs["text"]).alias("size"))
    rows = rows.withColumn("size", F.col("size") + 1)
    keys = stored(rows.groupBy("hi", "lo").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-keys")
    total, n = keys.agg(F.sum("size"), F.sum("n")).first()
    if not n:
        return rows.select("row.*", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    finer = max(1, -(-n // (shards * part_rows)))
    parts = shards * finer
    slack = lambda i: total / shards * tolerance if i % finer == 0 else total / parts * PART_TOLERANCE
    bounds = sorted(splitters(keys, [(total * i // parts, slack(i)) for i in range(1, parts)]))
    starts = dict(keys.groupBy(place(bounds).alias("p")).agg(F.sum("n")).collect())  # one row a part
    first, run = {}, 0
    for p in range(parts):
        run = 0 if p % finer == 0 else run
        first[p], run = run, run + starts.get(p, 0)
    offsets = F.create_map(*(F.lit(x) for p in first for x in (p, first[p])))
    dealt = rows.withColumn("part", place(bounds)).repartitionById(parts, "part")
    order = Window.partitionBy("part").orderBy("hi", "lo")
    slot = (offsets[F.col("part")] + F.row_number().over(order) - 1).cast("long")
    return dealt.select("row.*", "size", F.floor(F.col("part") / finer).cast("int").alias("shard"), slot.alias("slot"))
