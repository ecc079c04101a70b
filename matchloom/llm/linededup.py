"""Line dedup by winnowing, with DataFrame operations only.

Lines are split at line feeds; lines of white space alone are neither compared nor deleted. A window is
RUN consecutive lines, or fewer if they hold WORDS words or more (with words None: RUN lines only). Of every window the smallest line hash is
selected as its fingerprint, so any two equal windows select the same one, at the same place in them.

Positions of selected lines are joined with the fingerprints that occur at two places or more, and carry the hashes of the
lines around them. Each is extended both ways, line by line, to the windows that selected it; a window whose lines, told apart
by 128-bit hashes, also stand at an earlier place (smaller doc_id, or earlier in the document) marks
its lines. Overlapping windows make up runs of any length. Marked lines are deleted; the first place of a run stays.

The repeated fingerprints meet the positions as a bitmap of at most 32 MB, which lets through a few others too, so no task gathers a
common line. Windows with over one in HOT_SHARE of all places are joined by broadcast: there are at most so many of them. Documents
that lose nothing are not shuffled.

Null texts stay null, null doc_ids come after all others, rows that agree in doc_id and
text are one place and treated alike. Extra columns pass through, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, key_filter, stored

RUN, WORDS = 3, 13
#: Columns that tell documents apart and put them in order: null doc_ids come last.
KEYS = ["none", "d", "th"]
_IN, _OUT = r"[^ \t\r\x0B\f]", r"[ \t\r\x0B\f]"


def keys_of(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("d"), F.xxhash64(docs["text"]).alias("th")]


def numbered(text: Column) -> Column:
    """Structs (raw line number, line) of the lines that hold more than white space."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(_IN))


def hashed_lines(text: Column, words: int | None) -> Column:
    """Structs (a, b, n) of the numbered lines: two hashes and the number of words, `words` at most; 0 if words do not matter."""

    def one(x: Column) -> Column:
        line = x["line"]
        if words is None:
            return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), F.lit(0).alias("n"))
        full = line.rlike(f"^{_OUT}*+(?:{_IN}++{_OUT}++){{{words - 1}}}{_IN}") if words > 1 else F.lit(True)
        n = F.when(full, words).otherwise(F.regexp_count(line, F.lit(f"{_IN}+")))
        return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), n.alias("n"))

    return F.transform(numbered(text), one)


def enough(part: Column, size: int, run: int, words: int | None) -> Column:
    """Whether a stretch of `size` lines is a window."""
    return F.lit(True) if size == run else F.aggregate(part, F.lit(0), lambda s, x: s + x["n"]) >= words


def sizes(run: int, words: int | None) -> range:
    return range(run if words is None else 1, run + 1)


def selected(run: int, words: int | None) -> Column:
    """Places (from 1) of the lines that some window selects: its smallest hash, the first on ties."""

    def of_start(start: Column) -> Column:
        found = []
        for size in sizes(run, words):
            part = F.slice("lines", start, size)
            hashes = F.transform(part, lambda x: x["a"])
            holds = (F.size(part) == size) & enough(part, size, run, words)
            found.append(F.when(holds, start + F.array_position(hashes, F.array_min(hashes)).cast("int") - 1))
        return F.array(*found)

    starts = F.sequence(F.lit(1), F.size("lines"))
    places = F.array_distinct(F.flatten(F.transform(starts, of_start)))
    return F.when(F.size("lines") > 0, F.filter(places, lambda p: p.isNotNull()))


def positions(docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """KEYS, p, fp, at, around: selected lines; around holds the lines up to run - 1 away, the selected one at place `at` of it."""
    rows = docs.select(*keys_of(docs), hashed_lines(docs["text"], words).alias("lines"))

    def one(p: Column) -> Column:
        first = F.greatest(p - (run - 1), F.lit(1))
        around = F.slice("lines", first, p - first + run)
        return F.struct(p.alias("p"), F.element_at("lines", p)["a"].alias("fp"), (p - first + 1).alias("at"), around.alias("around"))

    return rows.select(*KEYS, F.explode(F.transform(selected(run, words), one)).alias("x")).select(*KEYS, "x.*")


def extended(run: int, words: int | None) -> Column:
    """Of a position the windows around it that selected it: structs (start, size, k1, k2)."""
    found = []
    for size in sizes(run, words):
        for before in range(size):
            first = F.col("at") - before
            part = F.slice("around", F.greatest(first, F.lit(1)), size)
            hashes = F.transform(part, lambda x: x["a"])
            holds = (first >= 1) & (F.size(part) == size) & (F.array_position(hashes, F.array_min(hashes)) == before + 1)
            holds = holds & enough(part, size, run, words)
            k1, k2 = F.xxhash64(F.lit(size), hashes), F.xxhash64(F.lit(-size), F.transform(part, lambda x: x["b"]))
            found.append(F.when(holds, F.struct((F.col("p") - before).alias("start"), F.lit(size).alias("size"), k1.alias("k1"), k2.alias("k2"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def repeated(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """KEYS, windows: per document the windows (start from 1 among its numbered lines, size) that also stand earlier."""
    prints = positions(docs, run, words).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    shared = key_filter(stored(prints.select("fp"), "line-prints"), "fp")
    joined = shared.keep(positions(docs, run, words), F.col("fp"))
    reach = stored(joined.select(*KEYS, F.explode(extended(run, words)).alias("x")).select(*KEYS, "x.*"), "line-windows")
    place = F.struct(*KEYS, "start")
    firsts = reach.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first < last")
    firsts = stored(firsts.select("k1", "k2", "first", "n"), "line-firsts")
    met = hot_join(reach, firsts, ["k1", "k2"])
    return met.where(place > F.col("first")).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "size")).alias("windows"))


def cut(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """row (a struct of all columns of docs), text without later repeated runs, n_lines, n_removed."""
    marked = stored(repeated(docs, run, words), "line-marks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keys_of(docs))
    maybe = key_filter(marked.select(F.xxhash64(*KEYS).alias("key")), "key")
    whole = maybe.keep(rows, F.xxhash64(*KEYS), "left_anti").withColumn("windows", F.lit(None).cast(marked.schema["windows"].dataType))
    rows = whole.union(maybe.keep(rows, F.xxhash64(*KEYS)).join(marked, KEYS, "left").select(*whole.columns))
    lines, held = F.split("row.text", "\n", -1), numbered(F.col("row.text"))
    rows = rows.withColumn("numbers", F.transform(held, lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["start"], w["start"] + w["size"] - 1))))
    rows = rows.withColumn("gone", F.transform(covered, lambda p: F.element_at("numbers", p)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    less = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    return rows.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(less).alias("text"),
        F.coalesce(F.when(F.col("numbers").isNotNull(), F.size("numbers")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text; all columns of docs."""
    less = cut(docs, run, words)
    return less.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
