"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut into chunks where a match of the split pattern must end anyway, so that one
call never sees more than a chunk; a single match of great length is merged with a heap,
since its cost would otherwise grow with the square of the length.

Null texts count as empty: no ids, no bytes. Repeated rows give repeated rows, null doc_ids
stay null, other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

CHUNK_CHARS = 1 << 16
LONG_PIECE = 4096
#: A chunk may end between these: no match spans a change from visible ASCII to a space or line end.
SAFE_CUT = re.compile(r"[!-~](?=[ \n])")
SCHEMA = "doc_id long, ids binary, decoded_sha256 string"


class ByteBpe:
    """Encoder and decoder over the ranks of one tiktoken file, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        inside = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(inside.replace(r"\S", r"\P{White_Space}"))
        self.unbroken = re.compile(rf"\S{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}")

    def chunks(self, text: str):
        start = 0
        while len(text) - start > CHUNK_CHARS:
            cut = SAFE_CUT.search(text, start + CHUNK_CHARS)
            if cut is None:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for chunk in self.chunks(text):
            if self.unbroken.search(chunk):
                ids: list[int] = []
                for m in self.pieces.finditer(chunk):
                    piece = m[0]
                    ids.extend(self.merge(piece.encode()) if len(piece) > LONG_PIECE else self.encoding.encode_ordinary(piece))
                parts.append(np.array(ids, dtype="<u4"))
            elif chunk:
                parts.append(np.array(self.encoding.encode_ordinary(chunk), dtype="<u4"))
        return np.concatenate(parts) if parts else np.empty(0, dtype="<u4")

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, in n log n."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1)) + [n]
        before = list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded_sha256 of the raw bytes that the ids decode to."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "ids", "decoded_sha256"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
