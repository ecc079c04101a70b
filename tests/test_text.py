"""Normalizers, extractors and tokenizers on published samples and awkward fields."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import features

GOLDEN = [
    ("Orelee's Barbershop", "orelee s barbershop", "1795 Westchester Drive, High Point, NC", "1795 westchester drive, high point, nc", "", 0),
    ("Prime Money", "prime money", "17560 Ellis Road, Tahlequah, OK", "17560 ellis road, tahlequah, ok", "17560", 0),
    ("B+ Retail Inc", "b retail", "1712 Montebello Avenue, Phoenix, AZ", "1712 montebello avenue, phoenix, az", "", 0),
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "र म म र क ट ग प र इव ट ल म ट ड", "KH NO. -570/13, NEW DELHI, WEST DELHI, Delhi", "kh no -570 13, new delhi, west delhi, delhi", "", 0),
    ("-- Holloway Peak Inc Seafood", "-- holloway peak inc seafood", "105 ELM ST, MORGANTON, NC", "105 elm street, morganton, nc", "", 0),
    ("आदित्य प्रॉपर्टीज एलएलपी", "आद त य प र पर ट ज एलएलप", "G-3/571, GULMOHAR COLONY, BHOPAL, Madhya Pradesh", "g-3 571, gulmohar colony, bhopal, madhya pradesh", "", 0),
    ("wilfordhancock.com", "wilfordhancock com", "Mack Rd, Haltom City, Texas", "mack road, haltom city, texas", "", 0),
    ("International South Consultants Private Ltd", "international south consultants private", None, "", "", 1),
    ("LLC Moncada Léarning Center", "llc moncada le arning center", "5780 Fawn Ct, Fort Worth, Texas", "5780 fawn ct, fort worth, texas", "", 0),
]


@pytest.fixture(scope="module")
def one(spark):
    def value(f, *args):
        df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
        return df.select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first()["x"]

    return value


def test_published_records(spark):
    df = spark.createDataFrame([(g[0], g[2], "US ") for g in GOLDEN], "n string, a string, c string").coalesce(1)
    got = features.normalize_unicode(df, "n", "a", "c").collect()
    assert [(r.name_norm, r.address_norm, r.postal_code, r.address_missing) for r in got] == [(g[1], g[3], g[4], g[5]) for g in GOLDEN]
    assert {r.country_norm for r in got} == {"us"}


@pytest.mark.parametrize("raw, clean", [(None, ""), ("", ""), (" \t", ""), ("Café & Co.", "cafe co"), ("राम", ""), ("A_b-C", "a_b c"), ("x y", "x y")])
def test_clean_text(one, raw, clean):
    assert one(T.clean_text, raw) == clean


@pytest.mark.parametrize("raw, code", [("at 12345-6789 x", "123456789"), ("code 123 456", "123456"), ("a123456b", ""), ("560001", "560001"), ("1234567", ""), (None, ""), ("x 12345.", "12345")])
def test_postal_code(one, raw, code):
    assert one(T.extract_postal_code, raw) == code


def test_extractors(one):
    assert one(T.extract_numbers, "a1 22 x٣") == "1 22 ٣" and one(T.extract_numbers, None) == ""
    assert one(T.extract_email, "mail a.b-c@d.org now") == "a.b-c@d.org" and one(T.extract_email, "none") == ""
    assert one(T.extract_phone, "call +1 (555) 123-4567!") == "+1 (555) 123-4567" and one(T.phone_digits, "call +1 (555) 123-4567!") == "15551234567"


def test_tokenizers(one):
    assert one(T.TOKENIZERS["w1"], "A b-CD é_1") == ["a", "b", "cd", "é_1"]
    assert one(T.TOKENIZERS["w2"], "A b-CD é_1") == ["cd", "é_1"]
    assert one(T.TOKENIZERS["w1_stop"], "The North cat of x") == ["cat"]
    assert one(T.TOKENIZERS["space"], " a  b\tc d ") == ["a", "b", "c", "d"] and one(T.TOKENIZERS["space"], "") == []
    assert one(lambda x: T.char_ngrams(x, 3, 5), "ab") == [" ab", "ab ", " ab "]
    assert one(lambda x: T.char_ngrams(x, 3, 4), "a") == [" a "] and one(lambda x: T.char_ngrams(x, 3, 5), None) == []


def test_record_quality(spark):
    rows = [("a long name", "a long address", 1.0), ("a long name", "short", 0.8), ("abc", "", 0.3), ("a long name", None, 0.6), (None, None, 0.3)]
    df = spark.createDataFrame(rows, "n string, a string, q double").coalesce(1)
    assert [r.x for r in df.select(features.record_quality(F.col("n"), F.col("a")).alias("x")).collect()] == [r[2] for r in rows]


def test_stop_words():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 74
