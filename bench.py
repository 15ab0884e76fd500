"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores. Every
query is run on the whole tables; the result is written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from tableprobe.operators import structure
from tableprobe.plans.profile import profile
from tableprobe.plans.quality import quality_flags
from tableprobe.plans.rules import default_rules
from tableprobe.queries import QUERIES
from tableprobe.session import local_session

HEADLINE = [
    "numeric_moments",
    "quartiles",
    "correlations",
    "histograms",
    "missing_by_column",
    "category_entropy",
    "information_with_class",
    "nearest_cosine",
    "stratified_folds",
    "task_recommendations",
    "rule_duplicates",
    "owner_child_counts",
    "binary_metrics",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_profile(spark, folder: str) -> None:
    """Every statistic of lineitem over all rows, and the twelve rules on it."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    found = profile(lines, "lineitem", "l_returnflag")
    for part in (found.table, found.columns, found.correlations, found.histograms, found.categories, found.classes):
        drain(part)
    drain(quality_flags(found.table, found.columns, default_rules(spark)))
    found.release()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    drain(structure.structure(spark.read.parquet(f"{folder}/nation.parquet")))  # start the JVM's worker threads
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        timed(name, lambda: drain(QUERIES[name](spark, folder)))
    timed("full_profile_lineitem", lambda: full_profile(spark, folder))
    timed("full_profile_lineitem_again", lambda: full_profile(spark, folder))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
