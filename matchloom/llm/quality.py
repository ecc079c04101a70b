"""Quality rules with an isolation forest over rule statistics.

Every text is measured once; the statistics (a few numbers a document) go to the shared
folder. Each rule's statistic is a ratio, and its limits are the outermost that labelled good rows reach, but for a share
of them (LIMIT_SHARE). A forest of random splits is grown over how far documents lie outside the limits, each tree on a
subsample drawn from all documents that pass the base rules. Path lengths give each document an anomaly score, and the threshold is the one
that keeps the wanted share of labelled good rows. Limits and threshold are exact order statistics of all
labelled rows, counted in the executors.

Null texts have no words and fail the base rules. Rows are never merged: repeated rows give
repeated results. Without labelled good rows only the base rules reject. Other columns are
ignored, an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, smallest_by_hash, stored, words

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_marks", "n_digits", "n_upper",
]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TREES, TREE_ROWS = 100, 64
#: Share of labelled good rows past the base rules that lies within a rule's limit on one side, and that the threshold keeps.
LIMIT_SHARE, KEEP_GOOD = 0.999, 0.995
#: Bits of a value that a round of counting settles.
ROUND_BITS = 11


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    ws = words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    threes = list(zip(ws, ws[1:], ws[2:], strict=False))
    repeated = 0
    if len(set(threes)) < len(threes):
        found, upto = Counter(threes), 0
        for i, x in enumerate(threes):
            if found[x] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    size = len(raw)
    return (
        len(ws),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(raw.translate(None, b".,;:!?")),
        size - len(raw.translate(None, b"0123456789")),
        size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text."""

    def run(batches):
        for batch in slices(batches):
            rows = [measure(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


RULES = ["symbols a word", "repeated lines", "repeated words", "letters a word", "digits", "marks a word", "capitals", "words a line"]


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The statistic of each rule, none below 0."""
    c = {k: np.asarray(v, dtype=float) for k, v in counts.items()}
    n, lines, chars = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    return np.column_stack([
        c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, chars / n,
        c["n_digits"] / chars, c["n_marks"] / n, c["n_upper"] / chars, n / lines,
    ])


@dataclass
class Limits:
    """What each rule allows; outside() is 0 within and grows with the distance, in widths of the allowed range."""

    low: np.ndarray
    high: np.ndarray

    def outside(self, x: np.ndarray) -> np.ndarray:
        width = np.maximum(self.high - self.low, 1e-3)
        return np.log1p((np.maximum(0, x - self.high) + np.maximum(0, self.low - x)) / width * 10)


@dataclass
class Rank:
    """The value wanted at a share of a named list of values, and the leading bits of it found so far."""

    name: int
    share: float
    upper: bool
    prefix: int = 0
    place: int = -1


def order_statistics(values: DataFrame, wanted: list[Rank]) -> list[float] | None:
    """Exact values at the wanted ranks of `values` (name int, bits long: the bits of a double >= 0); None if a list is empty.

    The bits of such doubles are in their order. Each round counts the values by their next ROUND_BITS bits, so the driver sees
    at most 2 ** ROUND_BITS counts for each rank.
    """
    known = 63
    while known:
        shift = max(0, known - ROUND_BITS)
        near = reduce(lambda a, b: a | b, ((F.col("name") == r.name) & (F.shiftright("bits", known) == r.prefix) for r in wanted))
        counted = (values if known == 63 else values.where(near)).groupBy("name", F.shiftright("bits", shift).alias("bits")).agg(F.count("*").alias("n"))
        found: dict[int, list[tuple[int, int]]] = {}
        for name, bits, n in counted.collect():
            found.setdefault(name, []).append((bits, n))
        for r in wanted:
            own = sorted(x for x in found.get(r.name, []) if x[0] >> (known - shift) == r.prefix)
            if not own:
                return None
            if r.place < 0:
                at = r.share * (sum(n for _, n in own) - 1)
                r.place = int(np.ceil(at - 1e-9) if r.upper else np.floor(at + 1e-9))
            for bits, n in own:
                if r.place < n:
                    r.prefix = bits
                    break
                r.place -= n
        known = shift
    return np.array([r.prefix for r in wanted], dtype=np.int64).view(np.float64).tolist()


def listed(stats: DataFrame, made) -> DataFrame:
    """name, bits of the columns of made(counts), a matrix of numbers >= 0, for every row of stats."""

    def run(batches):
        for batch in batches:
            x = made({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}) + 0.0
            names = np.tile(np.arange(x.shape[1], dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))], ["name", "bits"])

    return stats.select(*COUNTS).mapInArrow(run, "name int, bits long")


class IsolationForest:
    """Random splits on bounded subsamples; a short mean path marks an anomaly."""

    def __init__(self, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        self.trees, self.rows, self.seed = trees, rows, seed
        self.grown: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def mean_path(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def fit(self, x: np.ndarray) -> IsolationForest:
        """x: rows in random order, enough for every tree; with fewer, trees share them."""
        rng = np.random.default_rng(self.seed)
        size = min(self.rows, len(x))
        apart = len(x) >= size * self.trees
        limit = int(np.ceil(np.log2(max(size, 2))))
        self.norm = max(self.mean_path(size), 1e-9)
        for tree in range(self.trees):
            column, cut, left, right, path = [], [], [], [], []
            own = np.arange(tree * size, (tree + 1) * size) if apart else rng.choice(len(x), size, replace=False)
            todo = [(own, 0, -1, 0)]
            while todo:
                rows, depth, parent, side = todo.pop()
                node = len(column)
                if parent >= 0:
                    (left, right)[side][parent] = node
                low, high = x[rows].min(0), x[rows].max(0)
                open_ = np.flatnonzero(high > low)
                leaf = depth >= limit or len(rows) < 2 or not len(open_)
                k = 0 if leaf else int(rng.choice(open_))
                at = 0.0 if leaf else float(rng.uniform(low[k], high[k]))
                column.append(k), cut.append(at), left.append(node), right.append(node)
                path.append(depth + self.mean_path(len(rows)) if leaf else 0.0)
                if not leaf:
                    below = x[rows, k] < at
                    todo += [(rows[below], depth + 1, node, 0), (rows[~below], depth + 1, node, 1)]
            self.grown.append(tuple(map(np.array, (column, cut, left, right, path))))
        self.depth = limit
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1); 0.5 is ordinary."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for column, cut, left, right, path in self.grown:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = np.where(x[every, column[node]] < cut[node], left[node], right[node])
            total += path[node]
        return 2.0 ** (-total / max(len(self.grown), 1) / self.norm)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sample(stats: DataFrame, rows: int) -> dict[str, np.ndarray]:
    """The counts of at most `rows` rows, those of smallest hash."""
    got = smallest_by_hash(stats, ["doc_id", *COUNTS], rows).select(*COUNTS).toPandas()
    return {c: got[c].to_numpy() for c in COUNTS}


def labelled(passing: DataFrame, labels: DataFrame, value: int) -> DataFrame:
    """The rows of documents that have this quality label."""
    ids = labels.where(F.col("quality") == value).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return passing.join(ids, "doc_id", "left_semi")


def fit_limits(good: DataFrame, share: float = LIMIT_SHARE) -> Limits | None:
    wanted = [Rank(i, q, up) for q, up in ((1 - share, False), (share, True)) for i in range(len(RULES))]
    got = order_statistics(listed(good, ratios), wanted)
    return got and Limits(*np.array(got).reshape(2, -1))


def threshold(good: DataFrame, bad: DataFrame, scored, keep_good: float) -> float:
    """Keeps the wanted share of the good rows; half way to the bad rows' low end where that lies higher."""
    cut = order_statistics(listed(good, scored), [Rank(0, keep_good, True)])
    low = order_statistics(listed(bad, scored), [Rank(0, 1 - keep_good, False)])
    if not cut:
        return float("inf")
    return (cut[0] + low[0]) / 2 if low and low[0] > cut[0] else cut[0]


def judge(docs: DataFrame, labels: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, keep_good: float = KEEP_GOOD) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly, kept for every document.

    The driver holds the subsamples of the trees, trees * tree_rows rows of counts.
    """
    stats = stored(statistics(docs), "quality-statistics").withColumn("base_failed", base_failed())
    passing = stats.where(~F.col("base_failed"))
    good, bad = (stored(labelled(passing, labels, y), "quality-labelled") for y in (1, 0))
    limits = fit_limits(good)
    forest, cut = None, float("inf")

    def scored(counts: dict[str, np.ndarray]) -> np.ndarray:
        return forest.score(limits.outside(ratios(counts)))

    if limits:
        forest = IsolationForest(trees, tree_rows).fit(limits.outside(ratios(sample(passing, trees * tree_rows))))
        cut = threshold(good, bad, lambda counts: scored(counts)[:, None], keep_good)

    def run(batches):
        for batch in batches:
            scores = scored({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}) if limits else np.zeros(batch.num_rows)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            extra = [pa.array(scores), pa.array(~failed & (scores <= cut))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "anomaly", "kept"])

    return stats.mapInArrow(run, SCHEMA + ", base_failed boolean, anomaly double, kept boolean")
