"""A compressed FM-index over word ids: a wavelet matrix of the Burrows-Wheeler transform.

Backward search runs for many patterns at once; each step is a rank on every level for all of them.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A packed bit vector with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits.astype(np.uint8), bitorder="little")
        full = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        full[: len(raw)] = raw
        self.words = full.view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FmIndex:
    """Index of a collection of strings of symbols >= 1, each with a separator of its own.

    value holds a number for each string; least() is the smallest over an interval of suffixes.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, value: np.ndarray, depth: int):
        """symbols: all strings, each followed by 0; starts: where each begins; depth: the longest string."""
        n = len(symbols)
        self.n = n
        last = symbols == 0
        rank = np.where(last, np.cumsum(last) - 1, symbols + int(last.sum()) - 1).astype(np.int64)
        step, order = 1, None
        while True:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key)  # ties are equal so far, and no two suffixes stay equal
            sorted_ = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank, step = new, step * 2
            if step > depth or rank.max() == n - 1:
                break
        bwt = symbols[order - 1]
        string = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.table = [value[string[order]].astype(np.int32)]
        while 2 << (len(self.table) - 1) <= n:
            half = 1 << (len(self.table) - 1)
            prev = self.table[-1]
            self.table.append(np.minimum(prev[: len(prev) - half], prev[half:]))
        counts = np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.levels: list[tuple[BitRank, int]] = []
        self.bits = max(int(symbols.max(initial=0)).bit_length(), 1)
        seq = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.levels.append((BitRank(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        alphabet = np.arange(len(counts))
        self.first = self.descend(alphabet, np.zeros(len(counts), dtype=np.int64))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the transform lands below the last level, following symbol c."""
        for level, (rank, zeros) in enumerate(self.levels):
            one = (c >> (self.bits - 1 - level)) & 1
            ones = rank.ones(i)
            i = np.where(one == 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting symbol c before each pattern."""
        both = self.descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        shift = self.before[c] - self.first[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value in each non-empty interval."""
        level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
        out = np.empty(len(lo), dtype=np.int64)
        for v in np.unique(level):
            at = level == v
            t = self.table[v]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(v))])
        return out


def earlier_windows(index: FmIndex, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, value: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur in a string of smaller value.

    Matching statistics from the right end first: the match is extended to the left while some occurrence
    has a smaller value, and every window inside it counts. The windows before it are then
    tested from the left, each backward from its end; where a test fails at j, all windows up to j are skipped.
    """
    m = len(starts)
    hits = [np.zeros(max(0, n - window + 1), dtype=bool) for n in lengths]
    flat_at = np.concatenate([[0], np.cumsum(np.maximum(lengths - window + 1, 0))])
    flat = np.zeros(int(flat_at[-1]), dtype=bool)
    s = np.arange(m)[lengths >= window]  # the string of each running search
    first = np.ones(len(s), dtype=bool)  # still the search from the right end
    end = lengths[s] - 1
    j, lo, hi = end.copy(), np.zeros(len(s), dtype=np.int64), np.full(len(s), index.n)
    limit = lengths - window  # the last window start still to test
    while len(s):
        c = symbols[starts[s] + j]
        lo, hi = index.extend(c, lo, hi)
        ok = hi > lo
        ok[ok] = index.least(lo[ok], hi[ok]) < value[s[ok]]
        full = ok & (end - j + 1 >= window)
        flat[flat_at[s[full]] + j[full]] = True
        alive = np.ones(len(s), dtype=bool)
        restart = np.full(len(s), -1)
        # right-end searches go on to the left as far as they can
        done = first & (~ok | (j == 0))
        stop = np.where(ok, j - 1, j)[done]
        limit[s[done]] = np.minimum(np.minimum(stop, end[done] - window), limit[s[done]])
        restart[done] = 0
        tested = ~first & (~ok | full)
        restart[tested] = np.where(ok[tested], end[tested] - window + 2, j[tested] + 1)
        again = restart >= 0
        alive[again] = restart[again] <= limit[s[again]]
        j = np.where(again, restart + window - 1, j - 1)
        end = np.where(again, restart + window - 1, end)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        first = first & ~again
        s, j, end, lo, hi, first = (x[alive] for x in (s, j, end, lo, hi, first))
    for i in range(m):
        hits[i] = flat[flat_at[i] : flat_at[i + 1]]
    return hits
