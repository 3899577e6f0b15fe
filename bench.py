"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "section_tree", "section_paths", "leaked_names", "coverage_report", "name_visibility", "similar_documents",
    "revision_nodes", "word_diff", "line_status", "overlay_elements", "fragments", "whole_papers", "redacted_spans",
    "planned_edits", "rendered_latex", "event_cohorts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from palimpsest import plans
    from palimpsest.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    registered = plans.load().QUERIES
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
