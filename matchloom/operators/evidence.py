"""Pairwise evidence between a query record and a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..session import stored

WEAK = 0.3


def both(a: Column, b: Column) -> Column:
    return (a != "") & (b != "")


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def native(pairs: DataFrame) -> DataFrame:
    """Evidence that needs no Python. pairs: s1_id, s2_id and name_1, name_2, addr_1, addr_2, country_1, country_2 (normalized)."""
    c = {x: T.or_empty(F.col(x)) for x in ("name_1", "name_2", "addr_1", "addr_2", "country_1", "country_2")}
    n1, n2, a1, a2, k1, k2 = c.values()
    tn1, tn2, ta1, ta2 = (T.space_tokens(x) for x in (n1, n2, a1, a2))
    num1, num2 = (F.array_distinct(T.number_list(x)) for x in (a1, a2))
    numbered = (F.size(num1) > 0) & (F.size(num2) > 0)
    shared = F.size(F.array_intersect(num1, num2))
    same_numbers = (shared == F.size(num1)) & (shared == F.size(num2))
    return pairs.withColumns({
        "name_exact_match": flag(both(n1, n2) & (n1 == n2)), "name_token_jaccard": jaccard(tn1, tn2),
        "addr_exact_match": flag(both(a1, a2) & (a1 == a2)), "addr_token_jaccard": jaccard(ta1, ta2),
        "num_exact_agreement": flag(numbered & same_numbers), "num_overlap": flag(numbered & (shared > 0)), "num_conflict": flag(numbered & (shared == 0)),
        "country_match": flag(both(k1, k2) & (k1 == k2)), "country_conflict": flag(both(k1, k2) & (k1 != k2)),
        "name_missing": flag((n1 == "") | (n2 == "")), "addr_missing": flag((a1 == "") | (a2 == "")), "country_missing": flag((k1 == "") | (k2 == "")),
    })


def fuzzy_ratios(pairs: DataFrame) -> DataFrame:
    """Adds the Indel family and the contradictions that rest on it."""
    c = {x: T.or_empty(F.col(x)) for x in ("name_1", "name_2", "addr_1", "addr_2")}
    n1, n2, a1, a2 = c.values()
    names = {"name_fuzz_ratio": "name_ratio", "name_fuzz_token_set": "name_set", "name_fuzz_token_sort": "name_sort", "addr_fuzz_token_set": "addr_set"}
    out = pairs.withColumn("_ratios", fuzzy.ratios(n1, n2, a1, a2))
    out = out.select(*pairs.columns, *(F.col("_ratios").getField(part).alias(name) for name, part in names.items()))
    return out.withColumns({
        "name_contradiction": flag(both(n1, n2) & (F.col("name_fuzz_token_set") < WEAK)),
        "addr_contradiction": flag(both(a1, a2) & (F.col("addr_fuzz_token_set") < WEAK)),
    })


def idf_jaccard(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """Adds name_idf_jaccard: summed idf of shared over all name tokens; unknown terms weigh 0, 0 if the sum is not positive.

    All tokens weigh as much as both sides less what they share. Each record's tokens are split and weighed once, and its sum with them; pairs meet
    them by (record, term). s1_id and s2_id name one text each.
    """

    def terms(n: int) -> DataFrame:
        names = pairs.groupBy(f"s{n}_id").agg(F.first(f"name_{n}").alias("name"))
        return names.select(f"s{n}_id", F.explode(F.array_distinct(T.space_tokens(F.col("name")))).alias("term")).join(idf, "term")

    left, right = stored(terms(1), "weighed-names"), stored(terms(2), "weighed-names")
    total = lambda df, n: df.groupBy(f"s{n}_id").agg(F.sum("idf").alias(f"sum_{n}"))
    met = pairs.select("s1_id", "s2_id").distinct().join(left, "s1_id").join(right.drop("idf"), ["s2_id", "term"])
    both = met.groupBy("s1_id", "s2_id").agg(F.sum("idf").alias("common"))
    out = pairs.join(both, ["s1_id", "s2_id"], "left").join(total(left, 1), "s1_id", "left").join(total(right, 2), "s2_id", "left")
    out = out.na.fill(0.0, ["common", "sum_1", "sum_2"])
    every = F.col("sum_1") + F.col("sum_2") - F.col("common")
    value = F.when(every > 1e-12, F.col("common") / every).otherwise(0.0)
    return out.withColumn("name_idf_jaccard", value).drop("common", "sum_1", "sum_2")


def paired(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """candidates (s1_id, s2_id, ...) with both records' entity_id, name, addr, country; a missing record is all empty."""
    side = lambda df, n: df.select(F.col("entity_id").alias(f"s{n}_id"), *(F.col(x).alias(f"{x}_{n}") for x in ("name", "addr", "country")))
    joined = candidates.join(side(left, 1), "s1_id", "left").join(side(right, 2), "s2_id", "left")
    fields = [f"{x}_{n}" for x in ("name", "addr", "country") for n in (1, 2)]
    return joined.na.fill("", fields)


def dataset(candidates: DataFrame, left: DataFrame, right: DataFrame, idf: DataFrame) -> DataFrame:
    """The full evidence vector; score becomes retrieval_score and fused_rank becomes rank where they are present."""
    out = idf_jaccard(fuzzy_ratios(native(paired(candidates, left, right))), idf)
    return out.withColumnsRenamed({"score": "retrieval_score", "fused_rank": "rank"})
