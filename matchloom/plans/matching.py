"""Record matching from raw sources to a submission: normalize, retrieve, weigh evidence, train, predict.

Every phase writes Parquet tables under one folder and reads those of the phases before it; a finished table is not made
again, so an interrupted run goes on where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, compete, decide, evidence, features, fuse, index
from ..operators.retrieve import TfidfRetriever
from ..session import ship
from ..sources import tables

PHASES = ["audit", "normalize", "features", "retrieve", "evidence", "train", "predict"]
#: What the matcher learns from, beside the evidence.
RANKS = ["rrf_score", "retrieval_score", "rank", "num_views", "candidate_rank", "top1_top2_margin", "top1_top3_margin", "mean_top3", "candidate_frequency", "inverse_candidate_frequency"]
EVIDENCE = [
    "name_exact_match", "name_fuzz_ratio", "name_fuzz_token_set", "name_fuzz_token_sort", "name_token_jaccard", "name_idf_jaccard",
    "addr_exact_match", "addr_fuzz_token_set", "addr_token_jaccard", "num_exact_agreement", "num_overlap", "num_conflict",
    "country_match", "country_conflict", "name_contradiction", "addr_contradiction", "name_missing", "addr_missing", "country_missing",
]


@dataclass
class Matching:
    """One matching job: the clean source's records meet those of the other sources (all of tables.RECORD's columns).

    truth (tables.TRUTH's columns) is needed to train only. part and parts restrict the clean source to one of disjoint slices.
    """

    clean: DataFrame
    others: list[DataFrame]
    path: str
    truth: DataFrame | None = None
    k: int = 50
    part: int = 0
    parts: int = 1
    matcher: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.clean.sparkSession

    def table(self, name: str, make) -> DataFrame:
        return tables.stage(self.spark, f"{self.path}/{name}", make)

    def audit(self) -> DataFrame:
        """Missing values and repeated keys of each source."""
        every = [("clean", self.clean), *((f"other_{i}", df) for i, df in enumerate(self.others, 1))]
        parts = (audit.missing_and_duplicates(df.select(*tables.RECORD.names), "entity_id").withColumn("source", F.lit(name)) for name, df in every)
        return self.table("audit", lambda: reduce(DataFrame.unionByName, parts))

    def records(self, side: str) -> DataFrame:
        """Normalized records: entity_id, name, addr, country and the columns they come from."""

        def make() -> DataFrame:
            raw = reduce(DataFrame.unionByName, (df.select(*tables.RECORD.names) for df in self.others)) if side == "others" else self.clean.select(*tables.RECORD.names)
            raw = tables.part_of(raw, "entity_id", self.part, self.parts) if side == "clean" and self.parts > 1 else raw
            rows = features.normalize_unicode(raw, "business_name", "business_address", "country")
            return rows.withColumnsRenamed({"name_norm": "name", "address_norm": "addr", "country": "raw_country"}).withColumnRenamed("country_norm", "country")

        return self.table(f"normalized_{side}", make)

    def normalize(self) -> DataFrame:
        self.records("others")
        return self.records("clean")

    def features(self) -> DataFrame:
        """Narrow features of every record of either side."""
        side = lambda s: features.narrow_features(self.records(s), "entity_id", "name", "addr", "business_name", "business_address")
        return self.table("features", lambda: side("clean").unionByName(side("others")))

    def retrieve(self) -> DataFrame:
        """Candidates of the name, address and full view, fused by reciprocal ranks."""

        def make() -> DataFrame:
            views = {"name": F.col("name"), "address": features.view(F.col("addr"), F.col("country")), "full": features.view(F.col("name"), F.col("addr"), F.col("country"))}
            found = {}
            for view, text in views.items():
                index_ = TfidfRetriever.fit(self.records("others").withColumn("view_text", text), "entity_id", "view_text", T.TOKENIZERS["w2"])
                found[view] = index_.search(self.records("clean").withColumn("view_text", text), "entity_id", "view_text", self.k)
            return fuse.reciprocal_rank(fuse.label_views(found))

        return self.table("candidates", make)

    def evidence(self) -> DataFrame:
        """All features of every candidate pair."""

        def make() -> DataFrame:
            left, right = self.records("clean"), self.records("others")
            idf = index.evidence_idf(right, "entity_id", T.space_tokens(F.col("name")))
            pairs = evidence.dataset(self.retrieve().drop("view"), left, right, idf)
            pairs = compete.popularity(compete.competition(pairs, "rrf_score"), left.count())
            return pairs.select("s1_id", "s2_id", *RANKS, *EVIDENCE)

        return self.table("evidence", make)

    def train(self) -> DataFrame:
        """The matcher, saved, and its F0.5 by threshold on the fold that only validated it."""

        def make() -> DataFrame:
            if self.truth is None:
                raise ValueError("training needs a truth")
            pairs = decide.true_pairs(self.truth)
            rows = decide.labelled(self.evidence(), pairs).na.fill(0.0)
            model = decide.fit_matcher(rows, [*RANKS, *EVIDENCE], **self.matcher)
            decide.save_matcher(model, f"{self.path}/matcher")
            held = lambda df: decide.with_fold(df).where("fold = 0").drop("fold")
            every = held(self.records("clean").select(F.col("entity_id").alias("s1_id")))
            return decide.f05_sweep(held(decide.predict(model, rows)), held(pairs.join(every, "s1_id", "left_semi")), every)

        return self.table("sweep", make)

    def predict(self) -> DataFrame:
        """Matches of every record of the clean source, and the submission."""
        model = decide.load_matcher(f"{self.path}/matcher")
        threshold = decide.best_threshold(self.train())
        scored = self.table("scored", lambda: decide.predict(model, self.evidence().na.fill(0.0)).select("s1_id", "s2_id", "pred"))
        every = self.records("clean").select(F.col("entity_id").alias("s1_id"))
        matches = self.table("matched", lambda: decide.gate(scored, every, threshold))
        listed = scored.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("s2_id")), ",").alias("candidate_entity_ids"))
        tables.write_submission(matches, listed.withColumnRenamed("s1_id", "source1_entity_id"), every, f"{self.path}/submission")
        return matches

    def run(self, phase: str = "all") -> DataFrame:
        """One phase, or all in order; the result of the last."""
        if phase not in [*PHASES, "all"]:
            raise ValueError(f"no such phase: {phase}; there are {', '.join(PHASES)}, all")
        ship(self.spark)
        out = None
        for name in PHASES if phase == "all" else [phase]:
            out = getattr(self, name)()
        return out
