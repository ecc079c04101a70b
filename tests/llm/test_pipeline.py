"""The pipeline's stages, each on its own input, against plain versions."""

import zlib

import corpus_pipeline as C
import pytest
from matchloom.llm import packing

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["documents", "odd", "none"])
def stages(request, spark, tables):
    """Input and output rows of every stage."""
    docs = tables("documents") if request.param == "documents" else request.getfixturevalue(request.param)
    out, columns = {}, docs.columns
    for name, stage in C.STAGES:
        before = docs
        docs = C.stored(stage(spark, docs, SF), f"test-{name}")
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
            # columns that bear the operators' own names pass through
            assert docs.dtypes == before.dtypes and all(r[c] == f"{c}!" for r in docs.collect() for c in columns[5:])
        out[name] = before, docs
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]


def test_toxic_documents_go(stages, tables):
    before, after = map(rows, stages["toxicity"])
    assert not set(map(repr, after)) - set(map(repr, before))
    known = {r.doc_id: r.toxic for r in tables("labels").collect()}
    if len(before) == tables("documents").count():
        kept = {d for d, _ in after}
        clean, toxic = ([d for d, _ in before if known.get(d) == y] for y in (0, 1))
        assert sum(d in kept for d in clean) >= 0.95 * len(clean) and sum(d in kept for d in toxic) <= 0.5 * len(toxic)


def test_repeated_lines_go(stages):
    before, after = map(rows, stages["line_dedup"])
    expected = [(d, t) for d, _, n, t in brute.repeated_lines(before, least=10**9) if not n or brute.words(t)]
    same(after, expected)


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages["simhash_near_dedup"])
    left = [repr(x) for x in before]
    for x in after:
        left.remove(repr(x))
    texts = {repr(x): x[1] for x in before}
    for x in left:  # whatever went has a near copy that stayed, or one in its chain did
        assert max((brute.jaccard(texts[x], t) for _, t in before if repr((0, t)) != x), default=0) >= 0.8
    for i, (_, a) in enumerate(after):
        for _, b in after[:i]:
            assert brute.jaccard(a, b) < 0.8


def test_passages_go(stages):
    before, after = map(rows, stages["substring_dedup"])
    expected = [(d, kept if n else t) for (d, t), (_, _, n, kept) in zip(before, brute.repeated_words(before), strict=True) if not n or kept]
    same(after, expected)
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in stages["substring_dedup"][1].collect())


def test_packing_takes_everything(stages):
    import public_tokenizers

    before, pieces = stages["packing"]
    encoder = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(encoder.encode(t or "")) for _, t in rows(before))
    assert sum(r.length for r in pieces.collect()) == total


def test_run_equals_the_stages(spark, stages):
    if stages["toxicity"][0].count() == 200:
        import public_tokenizers

        encoder = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
        texts = {d: encoder.encode(t or "") for d, t in rows(stages["packing"][0])}
        got = C.run(spark, SF).collect()
        # cuts may differ with the order of rows, but the pieces make up the same ids
        assert {r.doc_id for r in got} == set(texts) and sum(r.length for r in got) == sum(map(len, texts.values()))
        for r in got:
            assert r.doc_tokens == len(texts[r.doc_id]) and r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes())
