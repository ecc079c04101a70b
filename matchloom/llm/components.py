"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Every round is a few shuffles of what edges remain; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at

ROUNDS = 60


def _contract(batches):
    """Union-find over the edges of one partition: the same components as stars, with fewer edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [(x, r) for x in list(parent) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([n[i] for n in nodes], pa.int64()) for i in (0, 1)], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's greater (large) or smaller (small) neighbours go to the least node around it."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = around.join(least, F.col("u") == F.col("c"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge. edges: u, v (long)."""
    spark = edges.sparkSession
    now, path = stored_at(edges.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    mark = None
    for _ in range(ROUNDS):
        was = mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        after, new = stored_at(_star(_star(now, True), False), "edges")
        discard(spark, path)
        now, path = after, new
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
