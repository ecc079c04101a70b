"""SimHash near-duplicates with a pigeonring filter.

A fingerprint's bit is set if it is set in over half of the shingles' hashes. To find all
pairs within `radius` bits, the 64 bits are cut into segments on a ring. If a pair is within the
radius, some chain of consecutive segments starting somewhere on the ring has, for every
length l, at most floor(l * radius / segments) differing bits. The leading segments whose budget is 0 are
an equi-join key; the rest of the chain is checked in the join's condition before the full Hamming check.

Only distinct fingerprints are joined. The more there are, the more segments the ring has, since the head of a chain of more segments has more
bits: with 5 segments 25, with 9 28, with 15 29. A key that is shared by more than BUCKET fingerprints all the same is not
paired: its members are linked exactly through the values at distance one, which any
two fingerprints within two bits share; each such value has at most 65 members.

Null and empty texts have fingerprint zero and link like any other. Null doc_ids are kept and never
name a component unless it has no other. Repeated rows give repeated rows, other columns are ignored,
an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, slices, stored
from .components import components

SEED, RADIUS, BUCKET = 42, 2, 128
#: Numbers of segments to choose from.
SEGMENTS = (5, 9, 15)
#: Hashes whose bits are unpacked at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included; the whole sequence if it is shorter."""
    ws = (text or "").encode().translate(ASCII_LOWER).split()
    if not ws:
        return np.empty(0, dtype=np.uint64)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], dtype=np.uint64)
    line, digest = b" ".join(ws), xxhash.xxh64_intdigest
    stops = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = [0, *(stops[:-1] + 1).tolist()]
    stops = stops.tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops[size - 1 :], strict=False)], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    set_ = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every whole text."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint_of(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def ring(segments: int) -> list[int]:
    """The bit mask of each segment, as signed longs."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def chain_holds(differ: Column, start: int, masks: list[int], radius: int) -> Column:
    """The chain from `start` stays within its budgets; its last length is the full Hamming check."""
    m, held, mask = len(masks), F.lit(True), 0
    for length in range(1, m + 1):
        mask |= masks[(start + length - 1) % m]
        budget = length * radius // m
        if budget or length == m:
            held = held & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= budget)
    return held


def head(segments: int, radius: int) -> int:
    """The length of the longest chain whose budget is 0."""
    return max(n for n in range(1, segments + 1) if n * radius // segments == 0)


def segments_for(n: int, radius: int, bucket: int) -> int:
    """The fewest segments with which a key of n random fingerprints is shared by a quarter of a bucket, or the most there are."""
    return next((m for m in SEGMENTS if n >> (64 * head(m, radius) // m) <= bucket // 4), SEGMENTS[-1])


def near_pairs(fps: DataFrame, radius: int = RADIUS, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges u, v that connect exactly the distinct fingerprints within `radius` bits of each other.

    Nodes that are no fingerprint may occur in between (values at distance one). radius is at most 2.
    """
    if radius > 2:
        raise ValueError("crowded keys are linked through values at distance one, which needs radius <= 2")
    segments = segments or segments_for(fps.count(), radius, bucket)
    masks, lead = ring(segments), head(segments, radius)
    keys = []
    for i in range(segments):
        mask = 0
        for j in range(lead):
            mask |= masks[(i + j) % segments]
        keys.append(F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = stored(fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.ring", "k.key"), "ring-keys")
    sizes = keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1")
    few, many = sizes.where(F.col("n") <= bucket), sizes.where(F.col("n") > bucket)
    left = keyed.join(few.drop("n"), ["ring", "key"], "left_semi")
    a, b = left.alias("a"), left.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    chain = F.lit(False)
    for i in range(segments):
        chain = F.when(F.col("a.ring") == i, chain_holds(differ, i, masks, radius)).otherwise(chain)
    same = (F.col("a.ring") == F.col("b.ring")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    paired = a.join(b, same & chain).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowd = keyed.join(many.drop("n"), ["ring", "key"], "left_semi").select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = crowd.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("value"))
    meet = ball.groupBy("value").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    linked = meet.select(F.explode("members").alias("u"), "v").where("u <> v")  # 65 members at most
    return paired.union(linked).distinct()


def group(docs: DataFrame, size: int = 3, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most `radius` bits)."""
    rows = stored(fingerprints(docs, size), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reach = stored(components(near_pairs(fps.select("fp"), radius, segments)), "components")
    named = fps.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
