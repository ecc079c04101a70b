"""Hierarchical multi-length packing.

Documents are cut into whole windows of the largest tier; what remains is routed to the
smallest context tier that holds it. Each tier is packed into windows of its size, gaps of
longer windows are filled with documents of shorter tiers, best fit first, and the last gap
by cutting a document. The rest of the last window is cut into windows whose sizes are powers of two,
which need no padding. Windows of one size are numbered across all tasks and dealt into step groups of equal token counts:
of the groups of a size only the last can be short.

Packing runs inside each task over a bounded buffer: a task's result
depends on its rows and their order alone. Sequence ids are unique, not gapless.

Texts are encoded as the tokenizers library does by default: strings of special tokens become their ids, unless
special_as_text is set. Null texts count as empty: they have the end id only. Repeated rows are packed as often as
they occur, null doc_ids stay null, other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

WINDOW, SHORTEST = 2048, 128
END_ID = 1
END = array("I", [END_ID]).tobytes()
#: Tokens that a task holds back before it packs them, and tokens of a step group.
BUFFER_TOKENS, STEP_TOKENS = 1 << 20, 1 << 16
#: nth: the number of the window among those of its size in its task.
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, task int, nth long"
)


class WordTokenizer:
    """A tokenizers file whose pre-tokens are encoded one by one, so that ids are kept by pre-token.

    The split is the file's own; a text with characters on which regex engines could differ goes through the library whole.
    Ids are held as little-endian bytes, for joining.
    """

    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    #: Printable ASCII, usual white space and Latin letters, which are the same in every Unicode version.
    PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]*")
    #: Pre-tokens of the newer of two generations.
    HELD = 200_000

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte_chars = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(rest)})
        probe = "It's 12 Éü, <|end|> ??  x\ny Straße_9 l'été"
        self.split_ok = self.by_word(probe) == self.whole(probe)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word(self, w: str) -> bytes:
        """The ids of a pre-token: its bytes as the characters that stand for them, merged by the model."""
        return array("I", [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.byte_chars))]).tobytes()

    def by_word(self, text: str) -> bytes:
        split, new, old = self.SPLIT.findall(text.lower()), self.new, self.old
        for w in set(split):
            if w not in new:
                found = old.get(w)
                new[w] = self.word(w) if found is None else found
        out = b"".join(map(new.__getitem__, split))
        if len(new) > self.HELD:
            self.old, self.new = new, {}
        return out

    def encode(self, text: str) -> np.ndarray:
        plain = self.split_ok and self.PLAIN.fullmatch(text) and not self.special.search(text)
        ids = self.by_word(text) if plain else self.whole(text)
        return np.frombuffer(ids + END, dtype="<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path, special_as_text)


class Packer:
    """Turns id arrays into pieces of sequences; holds at most a buffer of ids."""

    def __init__(self, task: int, window: int = WINDOW, shortest: int = SHORTEST, buffer: int = BUFFER_TOKENS):
        self.window, self.buffer = window, buffer
        self.tiers = [t for b in range(window.bit_length(), -1, -1) if shortest <= (t := 1 << b) <= window]
        self.next = task << 40
        self.opened: dict[int, int] = {}
        self.task = task
        self.held = 0
        self.docs: list[tuple] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple], size: int) -> None:
        """One sequence; a piece is (doc_id, ids, start, stop)."""
        at, nth = 0, self.opened.get(size, 0)
        self.opened[size] = nth + 1
        for doc, ids, start, stop in pieces:
            self.out.append((doc, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids), self.next, at, size, self.task, nth))
            at += stop - start
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, ids, at, at + self.window)], self.window)
        if whole < len(ids):
            self.docs.append((doc, ids, whole, len(ids)))
            self.held += len(ids) - whole
        if self.held >= self.buffer:
            self.pack()

    def pack(self) -> None:
        """Pack what is held, longest tier first, and leave nothing behind."""
        tiers: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}
        docs = self.docs
        route = lambda n: next(t for t in reversed(self.tiers) if n <= t)
        for k, d in enumerate(docs):
            tiers[route(d[3] - d[2])].append((d[3] - d[2], k))
        for entries in tiers.values():
            entries.sort()
        for level, size in enumerate(self.tiers):
            own = tiers[size]
            while own:
                pieces, gap = [], size
                while gap:
                    found = self.fit(tiers, self.tiers[level:], gap)
                    if found is not None:
                        n, k = found
                        doc, ids, start, stop = docs[k]
                        pieces.append((doc, ids, start, stop))
                        gap -= n
                        continue
                    source = next((t for t in reversed(self.tiers[level:]) if tiers[t]), None)
                    if source is None:
                        break
                    n, k = tiers[source].pop()
                    doc, ids, start, stop = docs[k]
                    pieces.append((doc, ids, start, start + gap))
                    docs[k] = (doc, ids, start + gap, stop)
                    insort(tiers[route(n - gap)], (n - gap, k))
                    gap = 0
                self.close(pieces, size - gap, size)
        self.docs, self.held = [], 0

    @staticmethod
    def fit(tiers: dict, sizes: list[int], gap: int) -> tuple[int, int] | None:
        """Take the longest held document of these tiers that fits the gap."""
        for t in sizes:
            entries = tiers[t]
            if entries and (i := bisect_right(entries, (gap, 1 << 62))):
                return entries.pop(i - 1)
        return None

    def close(self, pieces: list[tuple], filled: int, size: int) -> None:
        """Emit a full window, or cut a partly filled one into windows of powers of two."""
        if filled == size:
            return self.emit(pieces, size)
        queue = pieces[::-1]
        while filled:
            part = 1 << filled.bit_length() - 1
            filled -= part
            taken, need = [], part
            while need:
                doc, ids, start, stop = queue.pop()
                cut = min(stop, start + need)
                taken.append((doc, ids, start, cut))
                need -= cut - start
                if cut < stop:
                    queue.append((doc, ids, cut, stop))
            self.emit(taken, part)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def step_groups(pieces: DataFrame, step: int) -> DataFrame:
    """pieces with step_group in place of task and nth; the windows of a size follow each other task by task."""
    counts = pieces.where("offset = 0").groupBy("tier", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = counts.select("tier", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    each = F.greatest(F.lit(1), F.floor(F.lit(step) / F.col("tier")))
    group = (F.floor((F.col("before") + F.col("nth")) / each) * 4096 + F.col("tier")).cast("long")
    return pieces.join(before, ["tier", "task"]).select(*SHOWN, group.alias("step_group"))


SHOWN = [c.split()[0] for c in SCHEMA.split(", ")][:-2]


def pack(docs: DataFrame, path: str, window: int = WINDOW, shortest: int = SHORTEST, step: int = STEP_TOKENS, special_as_text: bool = False) -> DataFrame:
    """A row for each piece: where it comes from, its ids' crc32, its sequence, its tier and step group."""
    types = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), window, shortest)
        encoder = tokenizer(path, special_as_text)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), encoder.encode(text.as_py() or ""))
            yield batch_of(packer.take())
        packer.pack()
        yield batch_of(packer.take())

    pieces = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
    return step_groups(stored(pieces, "packed-pieces"), step)
