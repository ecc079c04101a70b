import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASH = ["row", "size", "shard", "slot", "hi", "lo", "part", "d", "th", "starts", "n_lines", "n_removed", "fp", "component", "score", "ids", "_d", "_th", "_t", "_n"]


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    prose = " ".join(word() for _ in range(300))
    lines = "\n".join(" ".join(word() for _ in range(6)) for _ in range(12))
    return [
        (1, prose), (2, prose), (3, prose + " one more"), (4, ""), (5, None), (None, prose), (None, "short"), (6, " \t\n\r "),
        (7, "x" * 30_000), (8, "a b " * 20_000), (9, lines), (10, "head\n" + lines + "\ntail"), (11, "same\n" * 40), (12, "All rights reserved. CC-BY cc by"),
        (13, "Ünïcödé ñandú 中文 テスト 😀 \x00\x1c\x85  end"), (14, "twice the same"), (14, "twice the same"), (14, "same id, other text"), (15, " nbsp words "),
        (16, "K elvin İstanbul GENERAL PUBLIC LICENSE general public license"), (17, " ".join(["w"] * 40)), (18, "###" * 400 + " $$$" * 60),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}!" for c in CLASH]) for i, t in odd_texts()]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", `{c}` string" for c in CLASH))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
