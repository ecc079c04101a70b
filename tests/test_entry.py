"""The driver's entry points; every oracle on the smallest tables; sources, sinks and streams."""

import datetime
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from matchloom.functions.text import TOKENIZERS
from matchloom.operators.retrieve import Bm25Retriever, TfidfRetriever
from matchloom.plans import registry
from matchloom.plans.matching import Matching
from matchloom.sources import tables as S
from matchloom.streaming import records

ROOT = Path(E.__file__).parent


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_import_without_the_training_subpackage(tmp_path):
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts and p.name != "corpus_pipeline.py" and ".git" not in p.parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df, columns):
    df = df[columns].astype(object)
    return sorted((tuple(None if x != x else x for x in r) for r in df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    got, expected = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert plain(got, columns) == plain(expected, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"gbt_matcher"}))
def test_queries_without_oracle_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_matcher_query(spark, sf):
    got = registry.queries()["gbt_matcher"](spark, sf, rounds=3, depth=2).collect()
    assert got and all(0 <= r.pred <= 1 and r.fold in range(5) for r in got)


@pytest.mark.parametrize("name, settings, sql", [
    ("tfidf_masked_topk", {"max_df": 60}, registry._masked_sql(60)), ("blocked_topk", {"max_posting": 20, "max_terms": 4, "max_pool": 15}, registry._blocked_sql(20, 4, 15)),
    ("word_tfidf_padded_topk", {"max_features": 500}, registry._word_tfidf_sql(500)), ("char_ngram_topk", {"max_features": 40}, registry._char_sql(40)),
])
def test_limits_that_bind(spark, sf, duck, name, settings, sql):
    """The registered limits are the production ones, idle on small tables; here smaller ones act."""
    got, expected = registry.queries()[name](spark, sf, **settings).toPandas(), duck.sql(sql).df()
    idle = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(expected, columns) != plain(idle, columns)


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S1-1", "NA", 'a "quoted" name', "US"), ("S1-2", None, "x", None)]
    df = spark.createDataFrame(rows, S.RECORD)
    S.write_tsv(df, str(tmp_path / "t"))
    back = S.read_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.where("business_name = 'NA'").count() == 1
    assert S.read_tsv(spark, str(tmp_path / "t"), null_tokens=S.NULL_TOKENS).where("business_name is null").count() == 2
    assert S.pick(back, ["entity_id", "absent"]).columns == ["entity_id"]
    assert S.first_rows(back, "entity_id", 1).first().entity_id == "S1-1"
    assert sum(S.part_of(back, "entity_id", i, 3).count() for i in range(3)) == 2


def test_stages_are_resumed(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert S.stage(spark, str(tmp_path / "s"), make).count() == 3
    assert len(made) == 1


def test_submission(spark, tmp_path):
    every = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    matches = spark.createDataFrame([("a", "x"), ("b", "")], S.TRUTH)
    good = spark.createDataFrame([("a", "x,y"), ("b", "")], "source1_entity_id string, candidate_entity_ids string")
    S.write_submission(matches, good, every, str(tmp_path / "out"))
    assert S.read_tsv(spark, str(tmp_path / "out/matches"), S.TRUTH).count() == 2
    bad = spark.createDataFrame([("a", "y"), ("b", "")], "source1_entity_id string, candidate_entity_ids string")
    with pytest.raises(ValueError):
        S.write_submission(matches, bad, every, str(tmp_path / "out2"))
    with pytest.raises(ValueError):
        S.write_submission(matches.limit(1), good, every, str(tmp_path / "out3"))
    swapped = spark.createDataFrame([("a", "x"), ("c", "")], S.TRUTH)
    with pytest.raises(ValueError, match="ids that the clean source has not"):
        S.write_submission(swapped, good, every, str(tmp_path / "out4"))
    with pytest.raises(ValueError, match="candidates"):
        S.write_submission(matches, good.union(spark.createDataFrame([("c", "x")], good.schema)), every, str(tmp_path / "out5"))


def test_matching_from_sources_to_submission(spark, tmp_path):
    """Noisy copies of businesses are found again; a second run takes up what the first one left."""
    kinds, places = ["bakery", "garage", "books", "clinic", "studio"], ["oak", "elm", "mill", "lake", "hill", "north"]
    names = [(f"{a} {p} {k}{i}", f"{i + 10} {p} st", "US") for i, (a, p, k) in enumerate((a, p, k) for a in ("red", "blue", "old") for p in places for k in kinds)]
    clean = [(f"A-{i}", n.title(), a, c) for i, (n, a, c) in enumerate(names)]
    other = [(f"B-{i}", f"{n} Inc", a.replace(" st", " Street"), "us") for i, (n, a, c) in enumerate(names)] + [(f"C-{i}", n.upper(), None, c) for i, (n, a, c) in enumerate(names) if i % 3 == 0]
    truth = [(f"A-{i}", ",".join([f"B-{i}", *([f"C-{i}"] if i % 3 == 0 else [])])) for i in range(len(names))]
    make = lambda rows: spark.createDataFrame(rows, S.RECORD)
    job = Matching(make(clean), [make([x for x in other if x[0][0] == y]) for y in "BC"], str(tmp_path), spark.createDataFrame(truth, S.TRUTH), k=5, matcher={"rounds": 5, "depth": 3})
    matches = job.run()
    got = {r.source1_entity_id: set(filter(None, r.matched_entity_ids.split(","))) for r in matches.collect()}
    want = {a: set(b.split(",")) for a, b in truth}
    hit, given, real = sum(len(got[a] & want[a]) for a in want), sum(map(len, got.values())), sum(map(len, want.values()))
    assert set(got) == set(want) and hit >= 0.9 * given and hit >= 0.8 * real
    assert S.read_tsv(spark, str(tmp_path / "submission/matches"), S.TRUTH).count() == len(clean)
    assert (tmp_path / "features/_SUCCESS").exists() and spark.read.parquet(str(tmp_path / "audit")).count() == 3
    again = Matching(make(clean), [make(other)], str(tmp_path), None, k=5).run("predict")
    assert {r.source1_entity_id: r.matched_entity_ids for r in again.collect()} == {r.source1_entity_id: r.matched_entity_ids for r in matches.collect()}
    with pytest.raises(ValueError, match="needs a truth"):
        Matching(make(clean), [make(other)], str(tmp_path / "none")).train()


def test_index_is_saved_and_loaded_without_fitting(spark, tables, tmp_path):
    parts = tables("part").select("p_partkey", "p_name").limit(50).cache()
    words = TOKENIZERS["w2"]
    for i, fitted in enumerate([
        TfidfRetriever.fit(parts, "p_partkey", "p_name", words),
        Bm25Retriever.fit(parts, "p_partkey", "p_name", words, query_stop=["green"], max_posting=9), Bm25Retriever.fit(parts, "p_partkey", "p_name", words),
    ]):
        S.save_index(fitted, str(tmp_path / str(i)))
        loaded = S.load_index(spark, type(fitted), str(tmp_path / str(i)), words)
        for search in ("search", "search_padded"):
            before, after = (sorted(map(tuple, getattr(x, search)(parts, "p_partkey", "p_name", 3).collect())) for x in (fitted, loaded))
            assert before == after


def test_conversion_counts(spark, tmp_path):
    df = spark.createDataFrame([("1", "n", None, "us"), ("2", "n", "a", "us")], S.RECORD)
    got = S.convert(df, records.normalized, str(tmp_path / "c"))
    assert got == {"rows": 2, "address_missing": 1} and spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "events"
    events.repartition(4).write.parquet(str(src))
    late = events.limit(1).selectExpr("event_id", "ts + interval 900 days AS ts", "user_id", "event_type", "value", "props")
    stream = records.activity(records.read_stream(spark, str(src), events.schema, 16))
    records.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    late.write.mode("append").parquet(str(src))
    records.run_once(records.activity(records.read_stream(spark, str(src), events.schema, 16)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = events.groupBy("event_type").count().collect()
    for r in want:
        assert sum(n for (start, kind), n in got.items() if kind == r.event_type and isinstance(start, datetime.datetime)) == r["count"]
