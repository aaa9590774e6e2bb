"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is fully materialised with the ``noop``
sink (no collect to the driver).

Every query runs twice in the same session. The first run pays one-time costs
(JIT, code generation for the query's plan, Python workers starting); the
second is the steady state a long-running cluster job sees. ``queries`` /
``value`` report the second run, ``cold_queries`` / ``cold_total`` the first;
both are printed so neither is hidden."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.queries import QUERIES  # noqa: E402
from revlens.session import get_spark  # noqa: E402

HEADLINE = [
    "aspect_gate_substring", "aspect_tags", "keyword_counts", "spam_gate", "clean_reviews",
    "sentiment_map", "aspect_rollup", "masked_rows", "batch_jaccard_estimate", "payload_explode",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="revlens-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    cold, warm = {}, {}
    for name in names:
        cold[name] = run_once(spark, name, sf_dir)
        warm[name] = run_once(spark, name, sf_dir)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold_total": round(sum(cold.values()), 3), "cold_queries": cold,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
