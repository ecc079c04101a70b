"""Each operator against a plain version, on the small tables and on awkward rows."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import bytebpe, common, components, license_texts, licenses, linededup, neardup, packing, quality, queries, sharding, simhash, substring, topk, toxicity

from . import brute


@pytest.fixture(scope="module", params=["documents", "odd", "none"])
def docs(request, tables):
    return tables("documents") if request.param == "documents" else request.getfixturevalue(request.param)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_simhash_against_all_pairs(docs):
    rows = rows_of(docs)
    fps = [brute.simhash(t) for _, t in rows]
    ids = brute.components([(d, f) for (d, _), f in zip(rows, fps, strict=True)], lambda a, b: (a ^ b).bit_count() <= 2)
    got = simhash.group(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()
    same([tuple(r) for r in got], [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, ids, strict=True)])


def test_segments_grow_with_the_fingerprints():
    assert [simhash.segments_for(n, 2, 128) for n in (0, 10**6, 10**9, 5 * 10**9, 10**12)] == [5, 5, 5, 9, 15]


@pytest.mark.parametrize("bucket, segments", [(1, None), (3, 5), (128, 5), (128, 9), (128, 15), (2, 9)])
def test_pigeonring_loses_no_pair(spark, bucket, segments):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.integers(0, 64, k)) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    linked = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), segments=segments, bucket=bucket)
    got = {r.node: r.component for r in components.components(linked).collect()}
    same_group = brute.components(list(zip(range(len(fps)), fps, strict=True)), lambda a, b: (a ^ b).bit_count() <= 2)
    for i, j in itertools.combinations(range(len(fps)), 2):
        together = got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])
        assert together == (same_group[i] == same_group[j])


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("(id * 37) % 301 AS u", "((id + 1) * 37) % 301 AS v").repartition(5)
    got = components.components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_license_base_counts(docs):
    expected = []
    for d, t in rows_of(docs):
        n, found = brute.phrases(t, licenses.BASE)
        at = [i for i, _ in found]
        expected.append((d, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = licenses.label(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    same([tuple(r) for r in got], expected)


def test_license_templates_with_lost_and_added_words(spark):
    texts = [
        (1, "Released under the MIT License."), (2, "foo licensed under the apache, license -- version 2.0 bar"), (3, "nothing here"),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a full copy of this software and associated documentation the software to deal in the software without restriction"),
        (5, "licensed under CC BY-NC 4.0. licensed under cc by nc 4.0"),
    ]
    got = {r.doc_id: r for r in licenses.label(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(r.n_words == len(brute.LICENSE_WORD.findall(brute.lower(t))) for (d, t) in texts for r in [got[d]])
    assert "mit" in got[1].labels.split(",") and "apache-2.0" in got[2].labels.split(",") and got[3].labels == "" and got[3].score == 0
    assert got[4].labels == "mit" and 0.8 <= got[4].score < 1
    assert got[5].n_base == 2 and set(got[5].labels.split(",")) == {"cc-by", "cc-by-nc-4.0"} and got[5].base_labels == "cc-by"


def test_every_license_template_is_found_in_prose(spark):
    """Each with a word changed and prose around it; labels agree with a plain cover of the template's words."""
    around = "some words stand here before the notice and {} others follow after it in the same text"
    changed = lambda t: t.replace("modify", "alter").replace("liable", "held")
    texts = [(i, around.format(changed(t))) for i, (t, _) in enumerate(license_texts.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.label(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        covers = [(brute.license_cover(t, x), y) for x, y in license_texts.TEMPLATES]
        best = max(covers)[0]
        assert license_texts.TEMPLATES[i][1] in got[i].labels.split(",") and abs(got[i].score - max(best, float(got[i].n_base > 0))) < 1e-9
        assert {y for _, y in [c for c in covers if c[0] >= 0.8]} >= set(got[i].labels.split(",")) - set(licenses.BASE.values())


def test_license_words_are_compared_not_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(licenses, "gram_hash", lambda ws: 0)  # all templates claim one hash, that of no gram
    got = licenses.label(spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string")).first()
    assert got.labels == "" and got.n_words == 5


def test_licenses_use_no_python(tables):
    plan = licenses.label(tables("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = bytebpe.codec(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    expected = []
    for d, t in rows_of(docs):
        ids = np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes()
        expected.append((d, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bytebpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", F.sha2("ids", 256), "decoded_sha256").collect()
    same([tuple(r) for r in got], expected)


def test_byte_bpe_of_long_pieces_and_cuts():
    bpe = bytebpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    letters = "".join(rng.choice(list("abcdeéth"), 9000))
    for text in (letters, "\n" * 6000 + "x", "a" + " " * 5000 + letters, ("word's 12  \n\n end. " * 9000), "é" * 5000 + " " * 4200):
        assert bpe.encode(text).tolist() == bpe.encoding.encode_ordinary(text)


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = rows_of(docs)
    pieces = packing.pack(docs, path).collect()
    encoded = [(d, [*e.ids, 1]) for (d, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)]
    # every document falls apart into pieces whose crc32 agree
    left = {}
    for p in pieces:
        left.setdefault((p.doc_id, p.start), []).append(p)
    for d, ids in encoded:
        at = 0
        while at < len(ids):
            crc = lambda p: zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())  # noqa: B023, E731
            p = next(p for p in left[d, at] if p.doc_tokens == len(ids) and p.ids_crc32 == crc(p))
            left[d, at].remove(p)
            at += p.length
        assert at == len(ids)
    assert not any(left.values())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # nothing to pad


def test_special_tokens_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = packing.tokenizer(path), Tokenizer.from_file(path)
    for text in ("ab <|endoftext|> cd", "<|startoftext|><|ENDOFTEXT|>x", "<|endoftext|", "plain"):
        assert own.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    library.encode_special_tokens = True
    text = "ab <|endoftext|> cd"
    assert packing.tokenizer(path, True).encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_step_groups_are_full_but_for_the_last(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(400)], "doc_id long, text string").repartition(7)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), step=8192)
    sizes = {}
    for r in pieces.groupBy("tier", "step_group").agg(F.sum("length").alias("n")).collect():
        sizes.setdefault(r.tier, []).append((r.step_group, r.n))
    assert len(sizes[1024]) > 5
    for tier, groups in sizes.items():
        assert all(n == 8192 for _, n in sorted(groups)[:-1]), tier


def test_toxicity_against_plain_scores(docs):
    weights = {"short": 5.0, "sam*": 3.0, "xxx*": 4.0, "lines": 2.0, "aaaa*": 6.0, "the": 1.5}
    model = toxicity.SentenceModel(weights, -4.0)
    got = sorted((repr((r.doc_id, round(r.score, 9)))) for r in toxicity.score(docs, model).collect())
    assert got == sorted(repr((d, round(brute.noisy_or(t, weights, -4.0), 9))) for d, t in rows_of(docs))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(queries.remainder(F.col("doc_id")) != 0))
    held = toxicity.score(docs, model).join(labels, "doc_id").where(queries.remainder(F.col("doc_id")) == 0)
    got = held.select("toxic", "score", "spans").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in got)
    assert right >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and any(r.spans for r in got if r.toxic)


def test_toxicity_of_odd_rows(odd, none, spark):
    model = toxicity.SentenceModel({"short": 9.0}, -8.0)
    got = {(r.doc_id, r.score >= 0.5, len(r.spans)) for r in toxicity.score(odd, model).collect() if r.doc_id in (None, 4, 5, 6)}
    assert got == {(None, False, 0), (None, True, 1), (4, False, 0), (5, False, 0), (6, False, 0)}
    assert toxicity.score(none, model).count() == 0 and toxicity.clean(odd, model).columns == odd.columns
    empty = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == 0 for r in toxicity.score(odd, empty).collect())


def test_topk_against_brute_force(spark, tables):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.2, (400, 16))
    vectors[50:90] = vectors[50]  # ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(7, rows[7][1]), (500, None), (600, [1.0, None]), (700, [float("nan")] * 16), (800, [float("inf")] * 16), (900, []), (1000, [0.5] * 8), (1100, [0.25] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.vectors_of(df)
    known = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for row_block, query_block in ((65_536, 1024), (60, 2)):
        got = topk.search(q, q.where("vec_id % 100 = 0"), 10, row_block, query_block).collect()
        same([tuple(r) for r in got], best_of(known, 100, 10))
    assert topk.search(q.where("false"), q.where("false"), 10).count() == 0


def best_of(known, every, k):
    """query, rank, vec_id, score of the k best, scores held within a long; known: (vec_id, integers)."""
    asked = {}
    for i, v in known:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for a, x in asked.items():
        scored = sorted((-sum(p * r for p, r in zip(x, y, strict=True)), b) for b, y in known if b != a and len(x) == len(y))
        out += [(a, n + 1, b, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, b) in enumerate(scored[:k])]
    return out


def test_topk_keeps_every_finite_vector(spark):
    """Components up to the largest double, negative and tied ones, and queries that repeat."""
    rng = np.random.default_rng(4)
    huge = [7e4, -7e4, 2.0**40, -(2.0**40), 1e15, -1e15, 1e200, -1e200, 1.7e308, -1.7e308, 0.0, 5e-324]
    rows = [(i, [float(x) for x in rng.choice(huge, 3)]) for i in range(60)] + [(100 + i, rng.normal(0, 1, 3).tolist()) for i in range(60)]
    rows += [(10, [3.0, 2.0, 1.0]), (10, [1.0, 2.0, 3.0]), (110, [3.0, 2.0, 1.0]), (111, [3.0, 2.0, 1.0])]
    exact = lambda x: int(x) * 1024 if abs(x) >= 2**52 else int(np.floor(1024 * x))
    known = [(i, [exact(x) for x in v]) for i, v in rows]
    q = topk.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for row_block in (65_536, 25):
        got = topk.search(q, q.where("vec_id % 10 = 0"), 8, row_block).collect()
        same([tuple(r) for r in got], best_of(known, 10, 8))


@pytest.mark.parametrize("settings", [{}, {"HOT_SHARE": 1}, {"HOT_SHARE": 10**9}])
def test_line_dedup(docs, settings, monkeypatch):
    for k, v in settings.items():
        monkeypatch.setattr(common, k, v)
    expected = brute.repeated_lines(rows_of(docs))
    got = linededup.cut(docs).select("row.doc_id", "n_lines", "n_removed", "text").collect()
    same([tuple(r) for r in got], expected)


@pytest.mark.parametrize("power", [15, 28])
def test_line_dedup_of_few_long_lines_and_common_ones(spark, power, monkeypatch):
    """Runs of one or two lines count by their words; a full and a sparse bitmap give the same result."""
    monkeypatch.setattr(common, "FILTER_POWERS", (power, power))
    rng = np.random.default_rng(6)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 3)) for _ in range(n))
    known = [line(n) for n in (1, 2, 5, 6, 7, 8, 12, 13, 14, 60)]
    rows = [(i, "\n".join([*rng.choice(known, 9), line(4), "common", "", *rng.choice(known, 3)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (13, None):
        got = linededup.cut(df, words=words).select("row.doc_id", "n_lines", "n_removed", "text").collect()
        same([tuple(r) for r in got], brute.repeated_lines(rows, least=words or 10**9))


def test_line_dedup_keeps_columns_and_uses_no_python(odd):
    kept = linededup.dedup(odd)
    assert kept.columns == odd.columns and kept.where("n_lines = 'n_lines!' and n_removed = 'n_removed!'").count() == odd.count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("settings", [{}, {"CROWD": 2}, {"CROWD": 2, "SHARD_WORDS": 2000, "COMBINE_BYTES": 1000}, {"HOT_SHARE": 10**9}])
def test_substring_dedup(docs, settings, monkeypatch):
    for k, v in settings.items():
        monkeypatch.setattr(common if k == "HOT_SHARE" else substring, k, v)
    rows = brute.repeated_words(rows_of(docs))
    expected = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in rows]
    same([tuple(r) for r in substring.digest(docs).collect()], expected)


def test_substring_dedup_of_texts(odd):
    kept = substring.dedup(odd)
    assert kept.columns == odd.columns and kept.where("n_removed = 'n_removed!'").count() == odd.count()
    expected = [(d, k, t if k else text) for (d, text), (_, _, k, t) in zip(rows_of(odd), brute.repeated_words(rows_of(odd)), strict=True)]
    same([tuple(r) for r in substring.cut(odd).select("row.doc_id", "n_removed", "text").collect()], expected)
    same([tuple(r) for r in kept.select("doc_id", "text").collect()], [(d, t) for d, _, t in expected])


def test_substring_dedup_over_many_shards(tables):
    docs = tables("documents")
    flat = lambda m: sorted((r.doc_id, x.start + i) for r in m.collect() for x in r.marks for i in range(64) if x["mask"] >> i & 1)
    assert flat(substring.removals(docs, shard_words=2000)) == flat(substring.removals(docs))


def test_sharding(docs):
    got = sharding.shard(docs, 16).select("doc_id", "text", "size", "shard", "slot").collect()
    same([(r.doc_id, r.text, r.size) for r in got], [(d, t, len((t or "").encode()) + 1) for d, t in rows_of(docs)])
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(0 <= s < 16 for s in by)


@pytest.mark.parametrize("part_rows", [200, 10_000])
def test_shards_are_near_equal(spark, part_rows):
    rows = [(i, "x" * (i % 97)) for i in range(30_000)] + [(100_000 + i, "hot " * 12) for i in range(15_000)]
    dealt = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16, part_rows=part_rows)
    sizes = [r[1] for r in dealt.groupBy("shard").agg(F.sum("size")).collect()]
    # a shard has two ends, each within the tolerance and a text
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 4 * (sharding.TOLERANCE * sum(sizes) / 16 + 100)
    parts = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(parts) <= 2.5 * max(part_rows, 45_000 / 16)


def test_quality_counts(docs, tables):
    expected = [(d, *brute.quality(t)) for d, t in rows_of(docs)]
    got = {}
    for r in quality.judge(docs, tables("labels")).collect():
        got.setdefault((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines), []).append(r)
    assert sum(map(len, got.values())) == len(expected)
    for d, n, chars, symbols, dup, repeat in expected:
        r = got[d, n, chars, symbols, dup].pop()
        assert r.n_repeat_words == repeat
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n) and not (r.base_failed and r.kept)


def test_quality_verdict_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = queries.remainder(F.col("doc_id")) == 0
    judged = quality.judge(docs, labels.where(~held)).where("not base_failed").join(labels.where(held), "doc_id")
    got = judged.select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert len(good) > 500 and len(bad) > 40 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_isolation_forest_against_plain_walks():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 1, (6400, 4))) * (rng.random((6400, 4)) < 0.1)
    forest = quality.IsolationForest().fit(x)
    assert np.allclose(forest.score(x[:200]), [brute.isolation_score(forest, r) for r in x[:200]])


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(2)
    lists = [np.abs(rng.normal(0, 3, 1001)), np.repeat([0.0, 0.25, 1.0], 7), rng.random(1) * 1e-300]
    rows = [(i, int(np.float64(x).view(np.int64))) for i, xs in enumerate(lists) for x in xs]
    df = spark.createDataFrame(rows, "name int, bits long")
    wanted = [quality.Rank(i, q, up) for i in range(3) for q in (0.0, 0.005, 0.5, 0.999, 1.0) for up in (False, True)]
    expected = [float(np.quantile(lists[r.name], r.share, method="higher" if r.upper else "lower")) for r in wanted]
    assert quality.order_statistics(df, wanted) == expected
    assert quality.order_statistics(df, [quality.Rank(9, 0.5, True)]) is None


def test_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(docs)
    kept = {r.doc_id for r in neardup.keep_one(docs).select("doc_id").collect()}
    texts = dict(rows)
    near = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if abs(len(texts[a]) - len(texts[b])) <= 0.3 * len(texts[a]) and brute.jaccard(texts[a], texts[b]) >= 0.8]
    lost = sum(a in kept and b in kept for a, b in near)
    assert near and lost <= 0.02 * len(near)
    linked = {x for p in near for x in p}
    assert all(d in kept for d in texts if d not in linked)


def test_near_copies_of_odd_rows(odd, none):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert sum(d == 14 and t == "twice the same" for d, t in got) == 1
    assert {1, 7, 9, 17, 18} <= {d for d, _ in got} and not {2, 3} & {d for d, _ in got}
    assert sum(not brute.words(t) for _, t in got) == 1 and neardup.keep_one(none).count() == 0


def test_near_copies_within_a_large_template_group(spark):
    """2,000 texts of one template, 0.67 similar to each other, and near copies of the last 200 of them."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 8))
    template = [word() for _ in range(84)]
    own = [[word() for _ in range(20)] for _ in range(2000)]
    texts = {i: " ".join(template + x) for i, x in enumerate(own)}
    pairs = [(i, 10_000 + i) for i in range(1800, 2000)]
    texts |= {b: " ".join(template + own[a][:10] + [word() for _ in range(10)]) for a, b in pairs}
    assert brute.jaccard(texts[0], texts[1]) < 0.7 and all(brute.jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs)
    signs = {d: set(neardup.sketches(np.unique(simhash.shingle_hashes(t, 5)))) for d, t in texts.items()}
    kept = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id").collect()}
    gone = set(texts) - kept
    assert gone <= {b for _, b in pairs}
    assert not [(a, b) for a, b in pairs if b in kept and signs[a] & signs[b]]
