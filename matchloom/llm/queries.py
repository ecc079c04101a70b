"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bytebpe, licenses, linededup, packing, quality, sharding, simhash, substring, topk, toxicity
from .common import table


def remainder(doc_id: F.Column) -> F.Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder(F.col("doc_id")) != 0))
    held_out = remainder(F.col("doc_id")) == 0
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return ids.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.vectors_of(table(spark, sf_dir, "embeddings"))
    found = topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", in_order=True), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.cut(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    dealt = sharding.shard(table(spark, sf_dir, "documents"), 16, carry=[F.col("doc_id"), crc])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_mil, op2_simhash_pigeonring, op3_license_diagonals, op4_byte_bpe, op5_bit_sliced_topk,
        op6_hierarchical_packing, op7_line_winnowing, op8_fm_index, op9_histogram_sort, op10_isolation_rules, pipeline,
    )
}

ORACLES = {
    "op5_bit_sliced_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
            FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_line_winnowing": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
            FROM documents),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(line, '[^ \t\r\x0B\x0C]+')) AS words
            FROM l WHERE regexp_matches(line, '[^ \t\r\x0B\x0C]')),
        w AS (
            SELECT doc_id, p, 1 AS size, line AS run FROM n WHERE words >= 13
            UNION ALL SELECT a.doc_id, a.p, 2, a.line || chr(10) || b.line
            FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.words + b.words >= 13
            UNION ALL SELECT a.doc_id, a.p, 3, a.line || chr(10) || b.line || chr(10) || c.line
            FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN n c ON a.doc_id = c.doc_id AND c.p = a.p + 2),
        r AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY run, size ORDER BY doc_id, p) AS seen FROM w),
        g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE seen > 1 AND o < size),
        k AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept
            FROM l LEFT JOIN n USING (doc_id, i) LEFT JOIN g ON g.doc_id = n.doc_id AND g.p = n.p
            WHERE g.p IS NULL GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(a.c, 0) AS n_lines, coalesce(b.c, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS c FROM n GROUP BY 1) a USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS c FROM g GROUP BY 1) b USING (doc_id)""",
    "op8_fm_index": r"""
        WITH t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        w AS (
            SELECT doc_id, unnest(range(1, len(ws) - 11)) AS s, ws FROM t WHERE len(ws) >= 13),
        h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 12], ' ')) AS h FROM w),
        f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 13)))) AS gone FROM h JOIN f USING (h) WHERE first < doc_id GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN ws
                   ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM t LEFT JOIN g USING (doc_id)""",
}


def shipped(query):
    """The query, after the executors have got the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | more
