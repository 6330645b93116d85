"""Time the headline queries on one data folder and print one JSON line.

One untimed query starts the JVM's code generation and the Python workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinweave.plans.catalog import QUERIES  # noqa: E402
from kinweave.session import local_session  # noqa: E402

HEADLINE = (
    "greedy_clusters",
    "best_match",
    "top_links",
    "rank_candidates",
    "resolve_batch",
    "requery_candidates",
    "block_name_similarity",
    "jaro_winkler",
    "match_weight",
    "multirule_links",
    "normalise_name",
    "block_prefix_address",
    "in_batch_guard",
    "evaluate_variant",
    "rdf_property_path",
    "process_requests",
    "latency_summary",
    "batch_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "kinweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["block_name_similarity"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
