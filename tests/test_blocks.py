"""Block search: the results of the search by joins, in any number of blocks, without sending postings or partial sums."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.text import TOKENIZERS
from matchloom.operators import blocks, retrieve
from matchloom.plans import registry


@pytest.mark.parametrize("least, block_postings", [(2000, 4_000_000), (1, 500)])
def test_blocks_give_what_joins_give(spark, monkeypatch, least, block_postings):
    monkeypatch.setattr(blocks, "LEAST_RECORDS", least)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(60)]
    names = lambda n: [" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(n)]
    corpus = [(f"c{i:03d}", x) for i, x in enumerate([*names(150), "same name", "same name", "", None, *["twin"] * 30])] + [("c000", "a second row of one id")]
    asked = [(i, x) for i, x in enumerate([*names(40), "", None, "zzzz unknown", "twin", "same name"])]
    corpus, asked = spark.createDataFrame(corpus, "id string, name string"), spark.createDataFrame(asked, "id long, name string")
    gram = TOKENIZERS["char_3_5"]
    for limit in (25, 10_000):
        got = retrieve.top_k(blocks.cosines(corpus, "id", "name", asked, "id", "name", gram, 5, limit, block_postings), 5)
        want = retrieve.TfidfRetriever.fit(corpus, "id", "name", gram, max_features=limit).search(asked, "id", "name", 5)
        plain = lambda df: sorted((r.s1_id, r.rank, r.s2_id, round(r.score, 8)) for r in df.collect())
        assert plain(got) == plain(want) and got.count() > 100


def test_nothing_known(spark):
    one = lambda x: spark.createDataFrame([(1, x)], "id long, name string")
    search = lambda a, b: blocks.cosines(a, "id", "name", b, "id", "name", TOKENIZERS["char_3_5"], 3, 100)
    assert search(one("alpha"), one("zzz")).count() == 0
    assert search(one("alpha").limit(0), one("alpha")).count() == 0
    assert search(one(None), one("alpha")).count() == 0


def sent(spark) -> int:
    """Rows that shuffles have written so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_names_that_share_grams_send_no_postings(spark, tmp_path):
    """Numbered names share most grams; their postings and the pairs that these bring together stay where they are made."""
    name = lambda word: F.concat(F.lit(word), F.lpad(F.col("id").cast("string"), 9, "0"))
    spark.range(2000).select(F.col("id").alias("c_custkey"), name("Customer#").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(300).select(F.col("id").alias("s_suppkey"), name("Supplier#").alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    before = sent(spark)
    got = registry.queries()["char_ngram_topk"](spark, str(tmp_path)).collect()
    assert len(got) == 300 * registry.K and all(r.s1_id == r.s2_id for r in got if r.rank == 1)
    assert sent(spark) - before < 2000 * 15
