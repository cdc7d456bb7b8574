"""Headline queries, timed: one JSON line on standard output.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` (comma-separated) limits the run to some queries.
"""

from __future__ import annotations

import json
import os
import re
import time

from duelens.plans.catalogue import QUERIES
from duelens.session import build_session

HEADLINE = [
    "overall_status_counts",
    "live_records",
    "cleaned_records",
    "study_rollup",
    "study_table",
    "paper_extract",
    "sponsor_matches",
    "sponsor_trials",
    "sponsor_table",
    "headline",
    "sponsor_worklist",
    "record_upsert",
    "current_record_versions",
    "document_slugs",
    "page_links",
    "price_bins",
    "cohort_crosstabs",
    "single_factor_models",
    "full_model",
    "sponsor_page",
    "document_search_count",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_orderkey").count().write.format(
        "noop"
    ).mode("overwrite").save()
    took = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
