"""Time the headline queries: BENCH_SF_DIR (tables), BENCH_CPUS (cores). Prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from answerloom.plans import QUERIES  # noqa: E402
from answerloom.session import local_session  # noqa: E402

HEADLINE = (
    "text_blocks markdown_blocks chunk_generic chunk_corpus dedupe_versions number_versions active_children validate_children activate_versions "
    "ingestion_status tokenize_bigram match_terms bm25_search bm25_filtered vector_search hash_embed rrf small_to_big coverage decide_quality "
    "build_evidence rewrite_queries context_window topic_state merge_labels hard_rules answer_verdict retrieval_metrics intent_metrics "
    "usage_totals recovery_advice grounded_retrieval"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
