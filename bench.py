"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

from sparkrag.catalog import load
from sparkrag.session import local_session
from sparkrag.sources.stage import scratch

HEADLINE = [
    "bm25_topk", "bm25_term_stats", "dense_topk", "metrics_by_label", "rrf_fusion", "rerank_topk",
    "evidence_check", "search_with_retry", "clean_text", "quality_grade", "split_chunks",
    "salvage_chunks", "build_corpus", "dedup_first_wins", "dedup_pages", "section_chunks",
    "detect_entities", "chunk_records", "route_decision", "concept_ids", "scope_filter",
    "rule_summary", "fit_level", "gold_report", "trace_records", "idempotent_create",
    "patch_upsert", "rate_limit", "ttl_first_value", "window_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load()
    spark = local_session(cpus, shuffle_partitions=cpus, progress=False)

    def run(name: str, where: str) -> None:
        with scratch(spark):
            queries[name](spark, where).write.format("noop").mode("overwrite").save()

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # start the JVM and the Python workers before timing
        run("bm25_topk", small)
        run("split_chunks", small)
    seconds = {}
    for name in names:
        t = time.perf_counter()
        try:
            run(name, sf_dir)
            seconds[name] = round(time.perf_counter() - t, 3)
        except Exception as exc:
            print(f"{name}: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr)
            seconds[name] = None
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(v for v in seconds.values() if v is not None), 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": total, "unit": "sec",
                      "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
