"""Substring dedup over words with an FM-index for each shard.

A window is `window` consecutive words. Windows are routed by their minimizer, the smallest hash of a word
k-gram inside them; equal windows share it. Runs of windows with one minimizer that two documents or more
hold are candidates. Candidate runs are dealt into shards by minimizer, each shard builds a
compressed FM-index of them, and streams the runs backward through it for matching
statistics: the windows that also occur in a run of a smaller doc_id. Documents then lose the words such
windows cover. Equal runs, those of whole copies too, are one string of the index, whose number is their smallest doc_id.

A minimizer with over CROWD places sends its windows one by one, dealt by their words, so
no shard gathers it. A run that very many documents hold is joined with its result by broadcast, and documents that lose nothing are not shuffled.

Null doc_ids have no order: such rows are kept whole and are no source. Null texts have no words. Rows that share a
doc_id do not remove each other's words. Extra columns pass through, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, hot_join, key_filter, release, slices, stored_at, words
from .fmindex import FmIndex, earlier_windows

WINDOW, GRAM = 13, 6
#: Windows of a run at most, places of a minimizer from which its windows go alone, words of a shard.
RUN_WINDOWS, CROWD, SHARD_WORDS = 24, 10_000, 800_000
#: Bytes of runs that a task combines at once.
COMBINE_BYTES = 1 << 25
MIX = np.uint64(0x9E3779B97F4A7C15)


class Line:
    """The words of a text joined by one space, and where each starts and stops."""

    def __init__(self, text: str):
        self.text = b" ".join(text.encode().split())
        raw = np.frombuffer(self.text, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if len(raw) else np.empty(0, dtype=np.int64)
        self.stops = np.append(gaps, len(raw)) if len(raw) else self.starts

    def part(self, start: int, stop: int) -> bytes:
        return self.text[self.starts[start] : self.stops[stop - 1]]

    def hashes(self) -> np.ndarray:
        """A hash of each word: a polynomial of its bytes, from sums over blocks of the line; words over LONG_WORD bytes by XXH64."""
        out, at = np.empty(len(self.starts), dtype=np.uint64), 0
        while at < len(out):
            first = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.stops, first + LINE_BLOCK, side="right")))
            here = slice(at, upto)
            if self.stops[upto - 1] - first <= LINE_BLOCK:
                raw = np.frombuffer(self.text, dtype=np.uint8, count=self.stops[upto - 1] - first, offset=first)
                sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS[: len(raw)], dtype=np.uint64)])
                a, b = self.starts[here] - first, self.stops[here] - first
                out[here] = (sums[b] - sums[a]) * BACK[a]
            for i in np.flatnonzero(self.stops[here] - self.starts[here] > LONG_WORD) + at:
                out[i] = xxhash.xxh64_intdigest(self.part(i, i + 1))
            at = upto
        return (out ^ (out >> np.uint64(32))) * MIX


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Bytes that are summed at once, and of a word from which it is hashed on its own.
LINE_BLOCK, LONG_WORD = 1 << 18, 64
BASE = 0x9E3779B97F4A7C15
POWERS, BACK = powers(BASE, LINE_BLOCK), powers(pow(BASE, -1, 1 << 64), LINE_BLOCK)


def window_minima(line: Line, window: int, gram: int) -> np.ndarray:
    """The minimizer of every window of the words."""
    if len(line.starts) < window:
        return np.empty(0, dtype=np.int64)
    h = line.hashes()
    n = len(h) - gram + 1
    g = h[:n].copy()
    for i in range(1, gram):
        g = (g * MIX + h[i : n + i]) ^ (g >> np.uint64(29))
    g = (g ^ (g >> np.uint64(32))) * MIX
    m, have, width = g, 1, window - gram + 1
    while have < width:
        by = min(have, width - have)
        m = np.minimum(m[:-by], m[by:])
        have += by
    return m.view(np.int64)


def runs_of(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of windows of each run with one minimizer, RUN_WINDOWS at most."""
    if not len(minima):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts = np.concatenate([[0], np.flatnonzero(minima[1:] != minima[:-1]) + 1])
    counts = np.diff(np.append(starts, len(minima)))
    if counts.max() > RUN_WINDOWS:
        cut = [(a, min(RUN_WINDOWS, c - o)) for s, c in zip(starts.tolist(), counts.tolist(), strict=True) for o in range(0, c, RUN_WINDOWS) for a in [s + o]]
        starts, counts = (np.array(x) for x in zip(*cut, strict=True))
    return starts, counts


def minimizers(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """mh, doc_id, th, start, windows of every run of every whole text."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["mh", "doc_id", "th", "start", "windows"]

    def run(batches):
        for batch in slices(batches):
            out = []
            for d, th, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                minima = window_minima(Line(t), window, gram)
                if len(minima):
                    at, n = runs_of(minima)
                    out.append((minima[at], np.full(len(at), d), np.full(len(at), th), at, n))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, types, strict=True)], names)

    return rows.mapInArrow(run, "mh long, doc_id long, th long, start int, windows int")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text; th tells texts apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"])


STRINGS = "route long, words binary, doc_id long, th long, start int, windows int"


class StringRows:
    """Candidate runs of documents as rows of STRINGS."""

    TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    NAMES = [c.split()[0] for c in STRINGS.split(", ")]

    def __init__(self, window: int):
        self.window, self.rows = window, []

    def add(self, d: int, th: int, line: Line, runs) -> None:
        """runs: start, windows, mh, crowd."""
        window = self.window
        for s, n, mh, crowd in runs:
            if crowd:
                for i in range(s, s + n):
                    part = line.part(i, i + window)
                    self.rows.append((xxhash.xxh64_intdigest(part) >> 1, part, d, th, i, 1))
            else:
                self.rows.append((mh, line.part(s, s + n + window - 1), d, th, s, n))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(self.NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.TYPES, strict=True)], self.NAMES)


def strings(rows: DataFrame, places: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """STRINGS of the runs (places, from minimizers) whose minimizer is shared (mh, n). Documents without such a run are not shuffled."""
    found = hot_join(places, shared, ["mh"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "windows", "mh", (F.col("n") > CROWD).alias("crowd"))).alias("runs"))
    runs = stored_at(found, "document-runs")[0]
    maybe = key_filter(runs.select(F.xxhash64("doc_id", "th").alias("key")), "key")
    held = maybe.keep(rows, F.xxhash64("doc_id", "th")).join(runs, ["doc_id", "th"]).select("doc_id", "th", "text", "runs")

    def run(batches):
        made = StringRows(window)
        for batch in slices(batches, 500):
            d, th, t, runs = batch.columns
            upto = np.cumsum(np.concatenate([[0], runs.value_lengths().to_numpy()]))
            start, windows, mh, crowd = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            for i in range(batch.num_rows):
                own = slice(upto[i], upto[i + 1])
                made.add(d[i].as_py(), th[i].as_py(), Line(t[i].as_py()), zip(*(x[own].tolist() for x in (start, windows, mh, crowd)), strict=True))
            yield made.take()

    return held.mapInArrow(run, STRINGS)


#: The seed of the second key: the hash of the int 1 that goes before the line.
SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def line_keys(line: Column) -> tuple[Column, Column]:
    """A 128-bit hash of a line of words; shard() computes the same one."""
    return F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")


def combined(runs: DataFrame) -> DataFrame:
    """shard, words, first, last, n: equal runs of a task (of COMBINE_BYTES of it) as one row, with the smallest and largest doc_id and their number."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            if held:
                table = pa.Table.from_batches(held).group_by(["shard", "words"], use_threads=False)
                made = table.aggregate([("doc_id", "min"), ("doc_id", "max"), ("doc_id", "count")])
                held.clear()
                yield from made.rename_columns(["shard", "words", "first", "last", "n"]).combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > COMBINE_BYTES:
                yield from flush()
        yield from flush()

    return runs.select("shard", "words", "doc_id").mapInArrow(run, "shard int, words binary, first long, last long, n long")


def search_shards(runs: DataFrame, window: int) -> DataFrame:
    """k1, k2, first, last, n, mask: of each distinct run its smallest doc_id and the windows that occur below it (bit i: window i).

    runs: shard, words, doc_id. They are combined before and after the one exchange, so a shard meets a run once for each task that holds it.
    """

    def shard(parts: pa.Table) -> pa.Table:
        table = parts.group_by("words", use_threads=False).aggregate([("first", "min"), ("last", "max"), ("n", "sum")])
        table = table.rename_columns(["words", "first", "last", "n"])
        whole = table.column("words").to_pylist()
        keys = (pa.array(np.array([xxhash.xxh64_intdigest(x, seed) for x in whole], dtype=np.uint64).view(np.int64)) for seed in (42, SECOND))
        lines = [x.split(b" ") for x in whole]
        first = table.column("first").to_numpy()
        ids: dict[bytes, int] = {}
        symbols = np.array([i for ws in lines for i in (*(ids.setdefault(w, len(ids) + 1) for w in ws), 0)], dtype=np.int64)
        lengths = np.array([len(ws) for ws in lines])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        ranks = np.unique(first, return_inverse=True)[1]
        index = FmIndex(symbols, starts, ranks, int(lengths.max()) + 1)
        hits = earlier_windows(index, symbols, starts, lengths, ranks, window)
        mask = [sum(1 << int(i) for i in np.flatnonzero(h)) for h in hits]
        counts = (table.column(c) for c in ("first", "last", "n"))
        return pa.Table.from_arrays([*keys, *counts, pa.array(mask, pa.int64())], ["k1", "k2", "first", "last", "n", "mask"])

    return combined(runs).groupBy("shard").applyInArrow(shard, "k1 long, k2 long, first long, last long, n long, mask long")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, th, marks of the documents that lose words: an array of start and mask (bit i: the window at start + i)."""
    spark = docs.sparkSession
    rows = hashed(docs).where("doc_id is not null and text is not null")
    every, every_path = stored_at(minimizers(rows, window, gram), "minimizers")
    spots = every.groupBy("mh").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    shared, shared_path = stored_at(spots.where("a < b").select("mh", "n"), "shared-minimizers")
    del spots
    release(spark)
    found = strings(rows, every, shared, window)
    discard(spark, every_path)
    release(spark)
    runs, runs_path = stored_at(found, "candidate-runs")
    shards = max(1, -(-(runs.agg(F.sum(F.col("windows").cast("long") + window)).first()[0] or 0) // shard_words))
    shard = F.pmod(F.col("route"), F.lit(shards)).cast("int").alias("shard")
    judged, judged_path = stored_at(search_shards(runs.withColumn("shard", shard), window).where("mask <> 0 or first < last"), "judged-runs")
    del found
    release(spark)
    wanted = key_filter(judged.select("k1"), "k1")  # of runs that some document loses
    places = wanted.keep(runs.select(*line_keys(F.col("words")), "doc_id", "th", "start", "windows"), F.col("k1"))
    places, places_path = stored_at(places, "run-places")
    discard(spark, runs_path)
    met = hot_join(places, judged, ["k1", "k2"])
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("windows")) - 1
    mask = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("mask"))
    gone = met.select("doc_id", "th", "start", mask.alias("mask")).where("mask <> 0")
    marks, _ = stored_at(gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("marks")), "marks")
    del met, gone
    for path in (shared_path, places_path, judged_path):
        discard(spark, path)
    release(spark)
    return marks


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (with doc_id, th) and their marks, null for documents that lose nothing: these are not shuffled."""
    maybe = key_filter(marks.select(F.xxhash64("doc_id", "th").alias("key")), "key")
    whole = maybe.keep(rows, F.xxhash64("doc_id", "th"), "left_anti").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    return whole.union(maybe.keep(rows, F.xxhash64("doc_id", "th")).join(marks, ["doc_id", "th"], "left").select(*whole.columns))


def covered(n: int, marks: list[dict], window: int) -> np.ndarray:
    """Which of n words the marked windows cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for m in marks:
        bits, s = m["mask"], m["start"]
        while bits:
            i = (bits & -bits).bit_length() - 1
            edge[s + i] += 1
            edge[s + i + window] -= 1
            bits &= bits - 1
    return np.cumsum(edge[:-1]) > 0


def kept_words(text: str | None, marks: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, the kept words joined by one space."""
    ws = words(text)
    if not marks:
        return len(ws), 0, b" ".join(ws)
    off = covered(len(ws), marks, window)
    return len(ws), int(off.sum()), b" ".join([w for w, x in zip(ws, off.tolist(), strict=True) if not x])


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    marks = removals(docs, window, gram)

    def run(batches):
        for batch in slices(batches):
            got = [kept_words(t.as_py(), m.as_py(), window) for t, m in zip(batch.column(1), batch.column(2), strict=True)]
            cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = marked(hashed(docs), marks).select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row (a struct of all columns of docs but text), text without the covered words, n_removed; a text that loses none stays as it is."""
    marks = removals(docs, window, gram)
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    keys = docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th")
    rows = marked(docs.select(others, docs["text"], *keys), marks).select("row", "text", "marks")
    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in slices(batches):
            texts, removed = [], []
            for t, m in zip(batch.column(1), batch.column(2), strict=True):
                _, n, left = kept_words(t.as_py(), m.as_py(), window) if m.is_valid else (0, 0, b"")
                texts.append(left.decode() if n else t.as_py())
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["row", "text", "n_removed"])

    return rows.mapInArrow(run, schema)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the covered words taken out; all columns of docs."""
    return cut(docs, window, gram).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
