"""Every registered query of the subpackage, over whole tables: against its SQL where it has one, else against plain versions."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from matchloom.llm import bytebpe, licenses, queries, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity_mil": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_simhash_pigeonring": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_license_diagonals": {
        "doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
        "base_labels": "string", "labels": "string", "score": "double",
    },
    "op4_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_bit_sliced_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_hierarchical_packing": dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint"),
    "op7_line_winnowing": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_fm_index": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_histogram_sort": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_isolation_rules": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean",
    },
}


@pytest.fixture(scope="module", params=["tables", "odd", "none"])
def folder(request, spark, tmp_path_factory):
    """A folder of tables: the small ones, awkward rows, empty ones."""
    if request.param == "tables":
        return SF
    at = str(tmp_path_factory.mktemp(request.param))
    request.getfixturevalue(request.param).write.parquet(f"{at}/documents.parquet")
    few = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (10, 0, 1), (14, None, None)] if request.param == "odd" else []
    spark.createDataFrame(few, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(100 * i, [float(i), 7e4, -1.0]) for i in range(5)] + [(7, None), (100, [0.0, float("nan"), 1.0])] if request.param == "odd" else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture
def run(spark, folder):
    def rows(name, known=False):
        df = E.queries()[name](spark, folder)
        kinds = dict(df.dtypes)
        assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
        return df.select(*COLUMNS[name]).collect()

    return rows


@pytest.fixture
def docs(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def same(found, expected):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_all_are_registered():
    names = [*COLUMNS, "pipeline"]
    assert [n for n in E.queries() if n in names or n.startswith("op")] == names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    expected = con.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, SF).select(*expected.columns).collect()
    same(got, expected.fetchall())


def held_out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0


def test_op1(spark, folder, run, docs):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), labels.where(queries.remainder(F.col("doc_id")) != 0))
    got = run("op1_toxicity_mil")
    same([(r.doc_id, r.held_out, round(r.score, 9)) for r in got], [(d, held_out(d), round(brute.noisy_or(t, model.weights, model.bias), 9)) for d, t in docs])
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_op1_learns_nothing_from_held_out_rows(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("toxic", F.when(queries.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    same(E.queries()["op1_toxicity_mil"](spark, str(tmp_path)).collect(), [tuple(r) for r in E.queries()["op1_toxicity_mil"](spark, SF).collect()])


def test_op2(run, docs):
    fps = [brute.simhash(t) for _, t in docs]
    ids = brute.components([(d, f) for (d, _), f in zip(docs, fps, strict=True)], lambda a, b: (a ^ b).bit_count() <= 2)
    same(run("op2_simhash_pigeonring"), [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, ids, strict=True)])


def test_op3(run, docs):
    got = run("op3_license_diagonals")
    expected = []
    for d, t in docs:
        n, found = brute.phrases(t, licenses.BASE)
        at = [i for i, _ in found]
        expected.append((d, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    same([r[:6] for r in got], expected)
    for r in got:
        labels, base = ([x for x in s.split(",") if x] for s in (r.labels, r.base_labels))
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_op4(run, docs):
    ranks = bytebpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d, t in docs:
        ids = np.array(plain.encode_ordinary(t or ""), dtype="<u4")
        expected.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(run("op4_byte_bpe"), expected)


def test_op5(run, folder, spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    known = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for i, x in known:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in known if j != i)[:10]
            expected += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    same(run("op5_bit_sliced_topk"), expected)


def test_op6(run, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = run("op6_hierarchical_packing")
    left = {}
    for p in pieces:
        left.setdefault((p.doc_id, p.start), []).append(p)
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        while at < len(ids):
            p = next(p for p in left[d, at] if p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()))
            left[d, at].remove(p)
            at += p.length
        assert at == len(ids)
    assert not any(left.values())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_op7(run, docs):
    expected = [(d, n, k, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute.repeated_lines(docs)]
    same(run("op7_line_winnowing"), expected)


def test_op8(run, docs):
    same(run("op8_fm_index"), [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute.repeated_words(docs)])


def test_op9(run, docs):
    got = run("op9_histogram_sort")
    same([r[:4] for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes") for d, t in docs])
    shards, texts = {}, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        texts.setdefault(r.text_crc32, set()).add(r.shard)
        assert r.grown_shard is None and 0 <= r.shard < 16
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    whole, largest = sum(r.size for r in got), max((r.size for r in got), default=0)
    for i in range(16):  # a shard's two ends lie within half a text, or a group of equal ones, of their places
        assert abs(sum(r.size for r in shards.get(i, [])) - whole / 16) <= 2 * largest + 0.01 * whole


def test_op10(run, docs):
    got = run("op10_isolation_rules")
    same([r[:6] for r in got], [(d, *brute.quality(t)) for d, t in docs])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
