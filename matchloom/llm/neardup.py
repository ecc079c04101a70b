"""Near-duplicate groups by SimHash sketches, for similarities that one 64-bit fingerprint cannot separate.

At a Jaccard similarity of 0.8 over five-word shingles whole-text SimHashes differ in about ten of 64 bits, too many for
a selective join. So each text gets SKETCHES fingerprints, each the SimHash of its SAMPLE smallest
shingles under one hash order; texts of similarity s share a given sketch with probability s ** SAMPLE.
Sketches are linked by the pigeonring join of `simhash`, texts that share one meet the LEADERS smallest documents among
them if their numbers of shingles allow the similarity, and a meeting counts only if the exact Jaccard similarity
of all shingles reaches the bound. Groups are connected components.

Where more texts share a sketch than meet its leaders, and these did not join all of them, the rest is found by an exact prefix filter
over the shingles of all such texts, the rarest first: two sets of n and m that share o >= s / (1 + s) * (n + m) have their first
common shingle among the first n - o + 1 and m - o + 1. So every similar pair with a common sketch ends in one group.

Equal word sequences are one node, so groups of copies cost one row each. Texts without words are equal to each
other. Null doc_ids come last in the order; of repeated rows one stays. Extra columns pass through, an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, give_back, hot_join, slices, stored
from .components import components
from .simhash import fingerprint_of, near_pairs, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, SAMPLE, LEADERS = 12, 3, 4
#: Texts with a common shingle meet in blocks of about so many.
BLOCK = 1024
LAST = (1 << 63) - 1
ODD = [np.uint64(int(x)) for x in np.random.default_rng(11).integers(1 << 40, 1 << 63, size=64, dtype=np.int64) | 1]


def mixed(hashes: np.ndarray, order: int) -> np.ndarray:
    """The hashes under one of the orders."""
    x = (hashes ^ ODD[order]) * ODD[order]
    x = (x ^ (x >> np.uint64(31))) * ODD[-1]
    return x ^ (x >> np.uint64(29))


def sketches(distinct: np.ndarray, count: int = SKETCHES, sample: int = SAMPLE) -> list[int]:
    """The SimHash, as a signed number, of the smallest hashes under each order; none for a text without words."""
    if not len(distinct):
        return []
    out = []
    for t in range(count):
        x = mixed(distinct, t)
        low = np.sort(np.partition(x, sample - 1)[:sample]) if len(x) > sample else x
        out.append(int(np.uint64(fingerprint_of(low)).astype(np.int64)))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """d, th, c (hash of the lower-cased words), n (distinct shingles), fps of every whole text."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(docs["text"]).alias("th"), docs["text"])

    def run(batches):
        for batch in slices(batches, 500):
            c, n, fps = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                line = b" ".join((text or "").encode().translate(ASCII_LOWER).split())
                c.append(xxhash.xxh64_intdigest(line))
                hashes = np.unique(shingle_hashes(text, SHINGLE))
                n.append(len(hashes))
                fps.append(sketches(hashes))
            made = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["d", "th", "c", "n", "fps"])
        give_back()

    return rows.mapInArrow(run, "d long, th long, c long, n long, fps array<long>")


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """u, v of the pairs (c, leader, a, b: both texts) whose shingle sets have at least this Jaccard similarity."""

    def run(batches):
        held, leader = None, None
        for batch in slices(batches, 200):
            out = []
            for c, v, a, b in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if v != leader:
                    held, leader = np.unique(shingle_hashes(b, SHINGLE)), v
                own = np.unique(shingle_hashes(a, SHINGLE))
                both = len(np.intersect1d(own, held, assume_unique=True))
                if both and both >= least * (len(own) + len(held) - both) - 1e-9:
                    out.append((c, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    return pairs.select("c", "leader", "a", "b").mapInArrow(run, "u long, v long")


def shingles(texts: DataFrame) -> DataFrame:
    """c, component, n, h: a row for each distinct shingle of the texts (c, component, text)."""

    def run(batches):
        for batch in slices(batches, 200):
            sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(2)]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            whole = np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64)
            made = [np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*made, np.repeat(n, n), whole)], ["c", "component", "n", "h"])

    return texts.select("c", "component", "text").mapInArrow(run, "c long, component long, n long, h long")


def unmet(texts: DataFrame, least: float) -> DataFrame:
    """c, leader: pairs of different components among the texts (c, component, text), with all that are similar."""
    rows = stored(shingles(texts), "shingles")
    often = stored(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    # shingles of one text alone come first; they take places but match nothing
    own = Window.partitionBy("c")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h"))
    keyed = hot_join(rows, often, ["h"], "df").withColumn("at", place).where(F.col("at") <= F.col("n") * F.lit(1 - least) + 1 + 1e-9)
    keyed = stored(keyed.select("h", "c", "component", "n", "at"), "prefixes")
    # a pair of two components has a side outside the largest, so that one's members are not paired with each other
    sizes = keyed.groupBy("h", "component").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("h").agg(F.max_by("component", "k").alias("main"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
    held = hot_join(keyed, stored(sizes, "prefix-sizes"), ["h"], "k").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    a = held.where("component <> main").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).alias("a")
    b = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    common = F.lit(least / (1 + least)) * (F.col("a.n") + F.col("b.n")) - 1e-9
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + 1
    meet = (F.col("a.h") == F.col("b.h")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.component") != F.col("b.component")) & (left >= common)
    return a.join(b, meet).select(F.greatest("a.c", "b.c").alias("c"), F.least("a.c", "b.c").alias("leader")).distinct()


def chosen(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """d, th of the one document that stays of each group: the one of smallest doc_id."""
    signed = stored(signatures(docs), "signatures")
    nodes = signed.groupBy("c").agg(F.min(F.struct("d", "th")).alias("rep"), F.first("n").alias("n"), F.first("fps").alias("fps"))
    pool = stored(nodes.select("c", "rep", "n", F.explode("fps").alias("fp")), "sketches")
    links = near_pairs(pool.select("fp").distinct(), 2)
    to = links.union(links.select("v", "u")).groupBy(F.col("u").alias("fp")).agg(F.min("v").alias("to"))
    named = pool.join(stored(to, "sketch-links"), "fp", "left").select("c", "rep", "n", F.least("fp", F.coalesce("to", "fp")).alias("fp"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("rep"))
    lead = named.withColumn("place", place).where(F.col("place") <= LEADERS)
    lead = lead.select("fp", F.col("rep").alias("before"), F.col("c").alias("leader"), F.col("n").alias("m"))
    close = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9
    meet = named.join(lead, "fp").where((F.col("before") < F.col("rep")) & close).select("c", "leader").distinct()
    meet = stored(meet, "meetings")
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(docs["text"]).alias("th"), docs["text"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        reps = nodes.join(wanted, "c", "left_semi").select("c", "rep.*")
        return stored(rows.join(reps, ["d", "th"]).groupBy("c").agg(F.min("text").alias("text")), "texts")

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        a = texts.withColumnRenamed("text", "a")
        b = texts.select(F.col("c").alias("leader"), F.col("text").alias("b"))
        return stored(similar(pairs.join(a, "c").join(b, "leader"), least), "similar")

    linked = components(verified(meet, texts_of(meet.select("c").union(meet.select("leader")).distinct())))
    # sketches whose texts neither all met nor all joined
    part = named.select("c", "fp").join(linked.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    parted = part.groupBy("fp").agg(F.count("*").alias("k"), F.min("component").alias("a"), F.max("component").alias("b"))
    parted = parted.where((F.col("k") > LEADERS + 1) & (F.col("a") < F.col("b")))
    rest = stored(part.join(parted.select("fp"), "fp", "left_semi").select("c", "component").distinct(), "rest")
    if not rest.isEmpty():
        texts = texts_of(rest)
        late = verified(stored(unmet(texts.join(rest, "c"), least), "unmet"), texts)
        linked = components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late))
    whole = nodes.select("c", "rep").join(linked.withColumnRenamed("node", "c"), "c", "left")
    whole = whole.withColumn("component", F.coalesce("component", "c"))
    return whole.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.*")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without all but one of each group of near copies; the columns of docs."""
    stay = chosen(docs, least)
    keys = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(docs["text"]).alias("th")
    stay = stay.join(docs.select(*keys).groupBy("d", "th").agg(F.count("*").alias("n")), ["d", "th"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(stay, ["d", "th"])
    once = rows.where("n = 1").select("row.*")
    return once.unionByName(rows.where("n > 1").dropDuplicates(["d", "th"]).select("row.*"))
