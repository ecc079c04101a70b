"""Normalizers, extractors and tokenizers as Column expressions.

Character classes are spelled out (`\\p{L}`, `\\p{N}`, `\\p{Nd}`, `\\p{Z}`): `\\w`, `\\d`, `\\s` and `\\b` mean
different things in different regex engines. Only NFKD needs Python.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}"
#: Words too common to search for.
STOP_WORDS = (
    "the a an and or of in on at to for is are was be by as it its this that with from have has had "
    "not but they we you our your their "
    "street road avenue boulevard drive lane way place court st rd ave blvd dr ln pl ct suite floor unit apt "
    "services service group company management international national general center centre enterprises solutions technology "
    "north south east west new old"
).split()
#: A common English stop list, for library-style BM25.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
#: Legal forms at a name's end, street words, legal words anywhere.
LEGAL_SUFFIX = r"(inc\.?|llc|ltd\.?|pvt ltd\.?|private limited|gmbh)"
STREET_WORDS = [("str|st", "street"), ("rd", "road"), ("ave", "avenue"), ("blvd", "boulevard")]
LEGAL_WORDS = "inc|llc|ltd|pvt|limited|gmbh|corp|co|plc|sa|ag|bv|nv"
PHONE = r"(?:\+?\p{Nd}{1,3}[-." + SPACE + r"]?)?\(?\p{Nd}{3}\)?[-." + SPACE + r"]?\p{Nd}{3}[-." + SPACE + r"]?\p{Nd}{4}"
EMAIL = rf"[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]+"
POSTAL = (
    rf"(?<![{WORD}])(\p{{Nd}}{{5}}(?:[-{SPACE}]\p{{Nd}}{{4}})?|\p{{Nd}}{{6}}|\p{{Nd}}{{3}}[{SPACE}]\p{{Nd}}{{3}})(?![{WORD}])"
)


def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def nfkd(x: Column) -> Column:
    return F.pandas_udf(_nfkd, StringType())(x)


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, f"[{SPACE}]+", " "))


def whole_word(words: str) -> str:
    return f"(?<![{WORD}])(?:{words})(?![{WORD}])"


def clean_text(x: Column) -> Column:
    """ASCII letters, digits and underscores, lower case, single spaces."""
    ascii_ = F.regexp_replace(nfkd(or_empty(x)), r"[^\x00-\x7F]", "")
    return collapse(F.regexp_replace(F.lower(ascii_), r"[^a-z0-9_\s]", " "))


def strip_legal_suffix(x: Column) -> Column:
    """One legal form at the end goes."""
    return F.regexp_replace(x, rf"(?<![{WORD}]){LEGAL_SUFFIX}(?![{WORD}])$", "")


def normalize_name(x: Column) -> Column:
    """Unicode kept: NFKD, lower case, words and hyphens, one legal suffix stripped."""
    kept = F.regexp_replace(F.lower(nfkd(or_empty(x))), rf"[^{WORD}{SPACE}\-]", " ")
    return strip(strip_legal_suffix(collapse(kept)))


def normalize_address(x: Column) -> Column:
    """Unicode kept: NFKD, lower case, words, hyphens and commas, street words written out."""
    out = F.regexp_replace(F.lower(nfkd(or_empty(x))), rf"[^{WORD}{SPACE}\-,]", " ")
    for short, long in STREET_WORDS:
        out = F.regexp_replace(out, whole_word(short), long)
    return collapse(out)


def normalize_country(x: Column) -> Column:
    return strip(F.lower(or_empty(x)))


def extract_postal_code(x: Column) -> Column:
    """Digits of the first thing that looks like a postal code."""
    return F.regexp_replace(F.regexp_extract(or_empty(x), POSTAL, 1), r"\P{Nd}", "")


def is_missing(x: Column) -> Column:
    return (strip(or_empty(x)) == "").cast("int")


def number_list(x: Column) -> Column:
    return F.regexp_extract_all(or_empty(x), F.lit(r"(\p{Nd}+)"), 1)


def extract_numbers(x: Column) -> Column:
    return F.array_join(number_list(x), " ")


def extract_email(x: Column) -> Column:
    return F.regexp_extract(or_empty(x), EMAIL, 0)


def extract_phone(x: Column) -> Column:
    return F.regexp_extract(or_empty(x), PHONE, 0)


def phone_digits(x: Column) -> Column:
    return F.regexp_replace(extract_phone(x), r"\P{Nd}", "")


def tokens(x: Column, least: int = 1) -> Column:
    """Runs of word characters of at least this length, lower-cased."""
    return F.regexp_extract_all(F.lower(or_empty(x)), F.lit(f"([{WORD}]{{{least},}})"), 1)


def content_tokens(x: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens without stop words and single characters."""
    return F.filter(tokens(x, 2), lambda t: ~t.isin(stop))


def space_tokens(x: Column) -> Column:
    return F.filter(F.split(or_empty(x), f"[{SPACE}]+"), lambda t: t != "")


def char_ngrams(x: Column, low: int, high: int) -> Column:
    """Character n-grams inside space-padded words; a padded word shorter than n counts once, for the first such n."""
    padded = F.transform(space_tokens(F.lower(or_empty(x))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w: Column, n: int) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        some = F.transform(steps, lambda i: F.substring(w, i, n))
        none = F.array().cast("array<string>")
        return some if n == low else F.when(F.length(w) >= n, some).otherwise(none)

    def grams(w: Column) -> Column:
        return F.concat(*(sized(w, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(padded, grams))


TOKENIZERS = {
    "w1": lambda x: tokens(x, 1),
    "w2": lambda x: tokens(x, 2),
    "w1_stop": content_tokens,
    "w2_english": lambda x: F.filter(tokens(x, 2), lambda t: ~t.isin(ENGLISH_STOP_WORDS)),
    "space": space_tokens,
    "char_3_5": lambda x: char_ngrams(x, 3, 5),
    "char_3_6": lambda x: char_ngrams(x, 3, 6),
}
