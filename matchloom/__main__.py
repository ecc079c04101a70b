"""python -m matchloom: match records of tab-separated sources."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.matching import PHASES, Matching
from .sources import tables


def main() -> None:
    ask = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    ask.add_argument("--phase", default="all", choices=[*PHASES, "all"])
    ask.add_argument("--clean", required=True, help="path of the clean source")
    ask.add_argument("--other", required=True, action="append", help="path of another source; may be repeated")
    ask.add_argument("--truth", help="path of the known matches, for training")
    ask.add_argument("--output", required=True, help="folder of all results")
    ask.add_argument("--k", type=int, default=50, help="candidates of each view")
    ask.add_argument("--part", type=int, default=0, help="slice of the clean source, from 0")
    ask.add_argument("--parts", type=int, default=1, help="number of slices")
    at = ask.parse_args()
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    truth = tables.read_tsv(spark, at.truth, tables.TRUTH) if at.truth else None
    job = Matching(tables.read_tsv(spark, at.clean), [tables.read_tsv(spark, x) for x in at.other], at.output, truth, at.k, at.part, at.parts)
    job.run(at.phase).show(20, truncate=False)


if __name__ == "__main__":
    main()
