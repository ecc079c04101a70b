"""Indel-based string ratios in Arrow batches; Spark's levenshtein weighs substitutions differently.

ratio = 2 * LCS / (len a + len b), times 100, rounded, over 100. Definitions follow the public
description of token-set and token-sort ratios, which first process both texts: characters from 128 to 255
go, what is no letter, digit or underscore becomes a space, letters become lower case. The plain ratio takes texts as they are.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN_1 = {i: None for i in range(128, 256)}
NO_WORD = re.compile(r"\W")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit-parallel step per character of b."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return round(200 * lcs(a, b) / n) / 100 if n else 0.0


def processed(text: str) -> str:
    return NO_WORD.sub(" ", text.translate(LATIN_1)).lower().strip()


def sorted_ratio(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    return ratio(" ".join(sorted(a)), " ".join(sorted(b)))


def set_ratio(a: list[str], b: list[str]) -> float:
    """The best ratio among the shared words and each side's shared plus own words."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left = f"{both} {' '.join(sorted(x - y))}".strip()
    right = f"{both} {' '.join(sorted(y - x))}".strip()
    found = [ratio(left, right)]
    if both:
        found += [ratio(both, left), ratio(both, right)]
    return max(found)


def token_sort(a: str, b: str) -> float:
    return sorted_ratio(processed(a).split(), processed(b).split())


def token_set(a: str, b: str) -> float:
    return set_ratio(processed(a).split(), processed(b).split())


def ratios(name_1: Column, name_2: Column, addr_1: Column, addr_2: Column) -> Column:
    """A struct of name_ratio, name_set, name_sort, addr_set; 0 where a side is empty. Each text is processed once a pair."""

    def run(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, r, s in zip(n1, n2, a1, a2, strict=True):
            x, y = processed(p).split(), processed(q).split()
            names = (ratio(p, q), set_ratio(x, y), sorted_ratio(x, y)) if p and q else (0.0, 0.0, 0.0)
            out.append((*names, token_set(r, s) if r and s else 0.0))
        return pd.DataFrame(out, columns=["name_ratio", "name_set", "name_sort", "addr_set"], dtype="float64")

    return F.pandas_udf(run, "name_ratio double, name_set double, name_sort double, addr_set double")(name_1, name_2, addr_1, addr_2)
