"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "recall_similarity", "recall_rrf", "recall_composed", "recall_hybrid", "rerank_weighted", "find_similar", "activate_graph",
    "decay_pass", "apply_feedback", "feedback_log", "calibration", "learning_stats", "beliefs_as_of", "seal_chain", "verify_chain",
    "entity_link_edges", "derived_closure", "admit_decisions", "uncertainty", "belief_cube",
]


def main() -> None:
    from beliefmill.plans import registry
    from beliefmill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # start the JVM and the Python workers before the clock runs
    registry.QUERIES["recall_similarity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
