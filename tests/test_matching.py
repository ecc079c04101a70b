"""Retrieval, fusion, evidence, competition and decision against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import fuzzy
from matchloom.functions import text as T
from matchloom.operators import audit, compete, decide, evaluate, evidence, fuse, index, retrieve

DOCS = {1: "red fox jumps", 2: "red red dog", 3: "blue fox", 4: "", 5: None, 6: "fox fox fox red blue", 7: "green tea", 8: "the dog tea"}
ASKED = {101: "red fox", 102: "tea", 103: "unknown words", 104: "blue dog fox tea"}


def toks(x):
    return re.findall(r"\w\w+", (x or "").lower())


def plain_tfidf(docs, asked):
    n, df = len(docs), Counter(t for d in docs.values() for t in set(toks(d)))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}

    def weights(x):
        w = {t: c * idf[t] for t, c in Counter(toks(x)).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1
        return {t: v / norm for t, v in w.items()}

    dw = {d: weights(x) for d, x in docs.items()}
    return {(q, d): sum(v * dw[d].get(t, 0) for t, v in weights(x).items()) for q, x in asked.items() for d in docs}


def ranked(scores, k, zero=False):
    out = []
    for q in {q for q, _ in scores}:
        best = sorted((-round(s, 9), d) for (a, d), s in scores.items() if a == q and (zero or s > 0))[:k]
        out += [(q, d, i + 1, round(-s, 6)) for i, (s, d) in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((r.s1_id, r.s2_id, r["rank"], round(r.score, 6) + 0.0) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark):
    make = lambda x: spark.createDataFrame(list(x.items()), "id long, text string")
    return make(DOCS), make(ASKED)


def test_tfidf_variants(frames):
    docs, asked = frames
    r = retrieve.TfidfRetriever.fit(docs, "id", "text", T.TOKENIZERS["w2"])
    scores = plain_tfidf(DOCS, ASKED)
    assert rows(r.search(asked, "id", "text", 3)) == ranked(scores, 3)
    assert rows(r.search(asked, "id", "text", 3, max_df=99)) == ranked(scores, 3)
    assert rows(r.search_padded(asked, "id", "text", 5)) == ranked(scores, 5, zero=True)
    assert rows(r.search_blocked(asked, "id", "text", 3)) == ranked(scores, 3)
    masked = r.search(asked, "id", "text", 8, max_df=2).collect()
    assert all(x.s2_id in (2, 3, 6, 7, 8) for x in masked)


def test_blocking_limits(frames):
    docs, asked = frames
    r = retrieve.TfidfRetriever.fit(docs, "id", "text", T.TOKENIZERS["w2"])
    posts = {}
    for d, x in DOCS.items():
        for t in set(toks(x)):
            posts.setdefault(t, []).append(d)
    scores = plain_tfidf(DOCS, ASKED)
    for posting, terms, most in ((2, 10, 100), (1, 10, 100), (9, 1, 100), (9, 10, 2), (9, 10, 1)):
        kept = {}
        for q, x in ASKED.items():
            pool, used = {}, 0
            for t in sorted({t for t in toks(x) if t in posts}, key=lambda t: (len(posts[t]), t)):
                if len(pool) > most or used >= terms:
                    break
                if len(posts[t]) > posting and used > 0:
                    continue
                used += 1
                for d in sorted(posts[t]):
                    pool.setdefault(d, used)
            for d, _ in sorted(pool.items(), key=lambda p: (p[1], p[0]))[:most]:
                kept[q, d] = scores[q, d]
        assert rows(r.search_blocked(asked, "id", "text", 5, posting, terms, most)) == ranked(kept, 5)


def test_bm25(frames):
    docs, asked = frames
    n = len(DOCS)
    df = Counter(t for d in DOCS.values() for t in set(toks(d)))
    mean = sum(len(toks(d)) for d in DOCS.values()) / n
    scores = {}
    for q, x in ASKED.items():
        for d, y in DOCS.items():
            tf, dl = Counter(toks(y)), len(toks(y))
            hit = [t for t in set(toks(x)) if tf[t] and 2 <= df[t] <= 3]
            if hit:
                scores[q, d] = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in hit)
    found = retrieve.Bm25Retriever.fit(docs, "id", "text", T.TOKENIZERS["w2"], min_df=2, max_df=3).search(asked, "id", "text", 4)
    assert rows(found) == ranked(scores, 4)


def test_library_bm25_is_padded_and_unscaled(frames):
    docs, asked = frames
    found = retrieve.Bm25Retriever.fit(docs, "id", "text", T.TOKENIZERS["w2"], scaled=False)
    full = {(r.s1_id, r.s2_id): r.score for r in retrieve.Bm25Retriever.fit(docs, "id", "text", T.TOKENIZERS["w2"]).search(asked, "id", "text", 9).collect()}
    for k in (3, 7, 8, 20):
        got = found.search_padded(asked, "id", "text", k).collect()
        for q in ASKED:
            own = sorted((r["rank"], r.s2_id, r.score) for r in got if r.s1_id == q)
            scores = {d: full.get((q, d), 0.0) / 2.5 for d in DOCS}
            order = sorted(DOCS, key=lambda d: (-round(scores[d], 9), d))[:k]
            assert [d for _, d, _ in own] == order and [x for *_, x in own] == pytest.approx([scores[d] for d in order])


def test_features_are_those_used_most_often(spark):
    """`often` stands in one record only, but more times than any other term."""
    docs = spark.createDataFrame([(1, "often often often often often rare"), (2, "common two"), (3, "common two"), (4, "common")], "id long, text string")
    kept = retrieve.TfidfRetriever.fit(docs, "id", "text", T.TOKENIZERS["w2"], max_features=2).vocab
    assert {r.term for r in kept.collect()} == {"often", "common"}
    by_df = retrieve.Bm25Retriever.fit(docs, "id", "text", T.TOKENIZERS["w2"], max_features=2).vocab
    assert {r.term for r in by_df.collect()} == {"common", "two"}


@pytest.mark.parametrize("k, seed", [(1, 1), (5, 1), (5, 20), (40, 3)])
def test_pruned_search_equals_all_pairs(spark, monkeypatch, k, seed):
    """Skewed terms, so that most queries leave frequent terms aside; ties included."""
    monkeypatch.setattr(retrieve, "SEED_POSTINGS", seed)
    rng = random.Random(3)
    term = lambda: f"t{min(int(rng.paretovariate(0.6)), 300)}"
    docs = {i: " ".join(term() for _ in range(rng.randint(1, 30))) for i in range(300)} | {1000 + i: "t1 t2 t250" for i in range(50)}
    asked = {i: " ".join(term() for _ in range(rng.randint(1, 12))) for i in range(40)}
    make = lambda x: spark.createDataFrame(list(x.items()), "id long, text string")
    for found, unit in ((retrieve.TfidfRetriever, True), (retrieve.Bm25Retriever, False)):
        r = found.fit(make(docs), "id", "text", T.TOKENIZERS["w2"])
        q = r.transform(make(asked), "id", "text") if unit else index.postings(make(asked), "id", T.tokens(F.col("text"), 2)).select("id", "term", F.lit(1.0).alias("weight"))
        whole = retrieve.top_k(retrieve.sum_products(q, r.weights).where("score > 0"), k)
        assert rows(retrieve.search_pruned(q, r.weights, k, unit)) == rows(whole)


def test_encoder_makes_unit_vectors(spark):
    df = spark.createDataFrame([(1, "aab"), (2, " "), (3, None), (4, "b")], "id long, text string")
    count = lambda: lambda texts: [[float(x.count(c)) for c in "ab"] for x in texts]
    got = {r.id: r.v for r in retrieve.encode(df, "id", "text", count).collect()}
    assert got == {1: pytest.approx([2 / 5**0.5, 1 / 5**0.5]), 4: [0.0, 1.0]}
    assert rows(retrieve.dense(retrieve.encode(df, "id", "text", count), retrieve.encode(df, "id", "text", count), 1))[0][:3] == (1, 1, 1)

    def absent():
        raise ImportError("no such model")

    assert retrieve.encode(df, "id", "text", absent).count() == 0


def test_top_k_merge_sample(spark):
    indptr, ids = [0, 2, 5, 5, 7, 10], [10, 20, 10, 30, 40, 50, 60, 10, 50, 99]
    data = [0.5, 0.8, 0.2, 0.9, 0.1, 0.6, 0.7, 0.3, 0.4, 0.99]
    flat = [(r, ids[i], data[i]) for r in range(5) for i in range(indptr[r], indptr[r + 1])]
    got = retrieve.top_k(spark.createDataFrame(flat, "s1_id long, s2_id long, score double"), 3).orderBy("s1_id", "rank").collect()
    assert [(r.s1_id, r.s2_id, r.score) for r in got] == [
        (0, 20, 0.8), (0, 10, 0.5), (1, 30, 0.9), (1, 10, 0.2), (1, 40, 0.1), (3, 60, 0.7), (3, 50, 0.6), (4, 99, 0.99), (4, 50, 0.4), (4, 10, 0.3),
    ]


def test_dense(spark):
    vectors = {1: [1.0, 0, 0, 0], 2: [0, 1.0, 0, 0], 3: [1.0, 0, 0, 0], 4: [-1.0, 0, 0, 0], 5: [0.6, 0.8, 0, 0], 6: None}
    df = spark.createDataFrame([(i, [float(x) for x in v] if v else None) for i, v in vectors.items()], "id long, v array<double>")
    got = rows(retrieve.dense(df.where("id = 1"), df, 5, block=2))
    assert got == [(1, 1, 1, 1.0), (1, 2, 4, 0.0), (1, 3, 2, 1.0), (1, 4, 5, -1.0), (1, 5, 3, 0.6)]


def test_plan_has_group_limit_and_no_cross_join(frames):
    docs, asked = frames
    weights = retrieve.TfidfRetriever.fit(docs, "id", "text", T.TOKENIZERS["w2"])
    found = weights.search(asked, "id", "text", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5), (2, 10, 1, 0.3)], "s1_id long, s2_id long, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 7.0), (1, 12, 2, 6.0)], "s1_id long, s2_id long, rank int, score double")
    both = fuse.label_views({"x": a, "y": b})
    got = {(r.s1_id, r.s2_id): r for r in fuse.reciprocal_rank(both).collect()}
    assert got[1, 11].rrf_score == round(1 / 62 + 1 / 61, 12) and got[1, 11].view == ["x", "y"] and got[1, 11].score == 7.0
    assert (got[1, 11].fused_rank, got[1, 10].fused_rank, got[1, 12].fused_rank) == (1, 2, 3)
    assert sorted(tuple(r) for r in fuse.union_top(both, 2).collect()) == [(1, 10, 1), (1, 11, 2), (2, 10, 1)]
    assert fuse.reciprocal_rank(both.where("false")).count() == 0
    pair = ["s1_id", "s2_id"]
    assert [tuple(r) for r in fuse.intersection(a, b, pair).collect()] == [(1, 11)]
    assert sorted(tuple(r) for r in fuse.difference(a, b, pair).collect()) == [(1, 10), (2, 10)]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.lcs(a, b) == table[-1][-1]


def test_ratios():
    assert fuzzy.ratio("this is a test", "this is a test!") == 0.97
    assert fuzzy.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1.0
    assert fuzzy.token_set("fuzzy fuzzy was a bear", "fuzzy was a bear") == 1.0 and fuzzy.token_set("", "x") == 0.0
    # processing: case and punctuation do not count, nor characters of the upper half of Latin-1
    assert fuzzy.token_sort("Supplier#0001, Inc.", "inc supplier 0001") == 1.0 and fuzzy.token_set("A-B", "b a c") == 1.0
    assert fuzzy.token_sort("café", "caf") == 1.0 and fuzzy.ratio("A", "a") == 0.0
    assert fuzzy.token_sort("--", "??") == 1.0 and fuzzy.token_set("--", "??") == 0.0


def test_ratios_in_one_pass_equal_single_ones(spark):
    texts = ["Acme, Ltd", "acme ltd", "", "x#1 y", "Y x 1", "éa", None]
    df = spark.createDataFrame([(a, b, b, a) for a in texts for b in texts], "a string, b string, c string, d string").na.fill("")
    got = df.select("a", "b", fuzzy.ratios(*(F.col(c) for c in "abcd")).alias("r")).collect()
    for a, b, r in got:
        names = (fuzzy.ratio(a, b), fuzzy.token_set(a, b), fuzzy.token_sort(a, b)) if a and b else (0.0, 0.0, 0.0)
        assert tuple(r) == (*names, fuzzy.token_set(b, a) if a and b else 0.0)


def test_evidence(spark):
    records = [
        (1, "acme ltd", "12 main street", "us"), (2, "acme ltd", "12 main street", "us"), (3, "other", "14 side road", "in"), (4, "", "", ""), (5, "acme", "no number", "us"),
    ]
    df = spark.createDataFrame(records, "entity_id long, name string, addr string, country string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 4), (1, 5), (1, 99)], "s1_id long, s2_id long")
    idf = index.evidence_idf(df, "entity_id", T.space_tokens(F.col("name")))
    got = {(r.s1_id, r.s2_id): r for r in evidence.dataset(pairs, df, df, idf).collect()}
    same = got[1, 2]
    assert (same.name_exact_match, same.addr_exact_match, same.num_exact_agreement, same.country_match, same.name_fuzz_ratio) == (1, 1, 1, 1, 1.0)
    unlike = got[1, 3]
    assert (unlike.num_conflict, unlike.country_conflict, unlike.country_match, unlike.name_exact_match) == (1, 1, 0, 0)
    for pair in ((1, 4), (4, 4), (1, 99)):
        r = got[pair]
        assert (r.addr_exact_match, r.num_exact_agreement, r.name_missing, r.addr_missing, r.country_missing, r.name_contradiction) == (0, 0, 1, 1, 1, 0)
    assert got[1, 5].name_token_jaccard == 0.5 and got[1, 5].num_overlap == 0
    weights = {r.term: r.idf for r in idf.collect()}
    assert weights["acme"] == pytest.approx(math.log(5 / 4)) and weights["ltd"] == pytest.approx(math.log(5 / 3))
    assert got[1, 5].name_idf_jaccard == pytest.approx(weights["acme"] / (weights["acme"] + weights["ltd"]))


def test_competition_and_popularity(spark):
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (1, 12, 0.3), (2, 10, 0.5)], "s1_id long, s2_id long, s double")
    got = {(r.s1_id, r.s2_id): r for r in compete.competition(scored, "s").collect()}
    assert [got[1, i].candidate_rank for i in (10, 11, 12)] == [1, 1, 2]
    assert (got[1, 12].top2_score, got[1, 12].top1_top3_margin) == (0.9, pytest.approx(0.6)) and got[2, 10].mean_top3 == pytest.approx(0.5 / 3)
    pop = {(r.s1_id, r.s2_id): r for r in compete.popularity(scored, 2).collect()}
    assert pop[2, 10].candidate_frequency == 2 and pop[1, 12].inverse_candidate_frequency == pytest.approx(math.log(3 / 2))


def test_decision(spark):
    truth = spark.createDataFrame([("a", "x,y"), ("b", None), ("c", "z"), ("d", " ")], "source1_entity_id string, matched_entity_ids string")
    pairs = decide.true_pairs(truth)
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "x"), ("a", "y"), ("c", "z")]
    assert tuple(audit.label_counts(truth).first()) == (2, 2, 1, 0)
    assert [tuple(r) for r in audit.match_count_distribution(truth).collect()] == [(0, 2), (1, 1), (2, 1)]
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "q", 0.6), ("c", "w", 0.5)], "s1_id string, s2_id string, pred double")
    every = truth.select(F.col("source1_entity_id").alias("s1_id"))
    got = {r.source1_entity_id: r.matched_entity_ids for r in decide.gate(scored, every).collect()}
    assert got == {"a": "q,x", "b": "", "c": "w", "d": ""}
    labelled = decide.labelled(scored, pairs)
    assert sorted((r.s2_id, r.label) for r in labelled.collect()) == [("q", 0), ("w", 0), ("x", 1)]
    assert [r.s2_id for r in decide.hard_negatives(labelled).collect()] == ["q"]
    sweep = {r.threshold: r.f05 for r in decide.f05_sweep(scored, pairs, every).collect()}
    p, r = 0.5, 0.5
    assert sweep[0.3] == pytest.approx((1.25 * p * r / (0.25 * p + r) + 1 + 0 + 1) / 4)
    assert sweep[0.9] == pytest.approx((1.25 * 1 * 0.5 / (0.25 + 0.5) + 1 + 0 + 1) / 4) and len(sweep) == 13
    assert decide.best_threshold(decide.f05_sweep(scored, pairs, every)) == pytest.approx(0.65)


def test_recalls(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (3, 30, 1)], "s1_id long, s2_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (4, 40)], "s1_id long, s2_id long")
    corpus = spark.createDataFrame([(10,), (11,), (20,), (30,)], "s2_id long")
    assert tuple(evaluate.recall_macro(found, truth, [1, 2]).first()) == (0.5, 0.75)
    assert tuple(evaluate.recall_micro(found, truth, [1, 2]).first()) == (25.0, 50.0)
    assert tuple(evaluate.recall_conditional(found, truth, corpus, [2]).first()) == (100.0,)
    cov = evaluate.coverage(truth, corpus).first()
    assert (cov.total_gt_pairs, cov.in_corpus, cov.absent, cov.queries_with_all_absent) == (4, 2, 2, 1)
    assert sorted(tuple(r) for r in evaluate.missed_pairs(truth, found, corpus, 1).collect()) == [(1, 11)]
    other = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "s1_id long, s2_id long, rank int")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "s1_id long")
    assert [r.overlap for r in evaluate.overlap_by_k(found, other, [1, 2]).collect()] == [0.0, 1.0]
    assert [r.overlap for r in evaluate.overlap_by_size(found, other, asked, [2]).collect()] == [50.0]


@pytest.mark.parametrize("pair, category", [
    (("", "x", "", ""), "name_missing"), (("the", "the", "", ""), "exact_name"), (("the of", "cat", "", ""), "name_missing"),
    (("acme inc", "acme llc", "", ""), "legal_suffix_variation"), (("shop 24", "store", "", ""), "numeric_identifier"),
    (("blue cat shop", "shop blue cat", "", ""), "token_order_variation"), (("blue cat shop", "blue cat store", "", ""), "partial_name_overlap"),
    (("listen", "silent", "", ""), "spelling_variation"), (("alpha", "zzz", "oak hill town", "oak hill city"), "address_dependent"),
    (("alpha", "zzz", "", "oak"), "name_and_address_weak"), (("alpha", "zzz", "oak", "elm"), "other"),
])
def test_failure_categories(spark, pair, category):
    df = spark.createDataFrame([pair], "a string, b string, c string, d string")
    assert df.select(evaluate.failure_category(*(F.col(c) for c in "abcd"))).first()[0] == category


def test_calibration_and_matcher_keep_folds_apart(spark, tmp_path):
    rng = random.Random(1)
    rows_ = [(q, c, rng.random()) for q in range(60) for c in range(6)]
    df = spark.createDataFrame([(q, c, x, int(x + rng.gauss(0, 0.2) > 0.6)) for q, c, x in rows_], "s1_id long, s2_id long, pred double, label int")
    got = decide.calibrate(df).collect()
    assert len(got) == len(rows_) and {r.fold for r in got} == set(range(5)) and all(0 <= r.calibrated <= 1 for r in got)
    # labels of a fold's own rows play no part in its calibration
    own = F.col("s1_id").isin([r.s1_id for r in got if r.fold == 2])
    other = decide.calibrate(df.withColumn("label", F.when(own, 1 - F.col("label")).otherwise(F.col("label")))).where("fold = 2").collect()
    assert {(r.s1_id, r.s2_id, r.calibrated) for r in other} == {(r.s1_id, r.s2_id, r.calibrated) for r in got if r.fold == 2}
    model = decide.fit_matcher(df.withColumnRenamed("pred", "x"), ["x"], rounds=3, depth=2)
    decide.save_matcher(model, str(tmp_path / "m"))
    again = decide.predict(decide.load_matcher(str(tmp_path / "m")), df.withColumnRenamed("pred", "x"))
    plain = decide.predict(model, df.withColumnRenamed("pred", "x"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, plain.collect()))


def test_measured_runs(spark):
    run = evaluate.measured(lambda: spark.range(100), 50)
    assert run.rows == 100 and run.seconds > 0 and run.qps == pytest.approx(50 / run.seconds) and run.heap_mb > 1 and run.python_mb > 1
