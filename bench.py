"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and forces full evaluation with the ``noop`` sink
(every row computed, nothing collected).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from margin_engine.queries import REGISTRY  # noqa: E402
from margin_engine.session import get_session  # noqa: E402

HEADLINE = (
    "clean_keyword", "match_key_search", "match_first", "business_dedup", "summary",
    "shop_rollup", "run_counters", "margin_fixed", "shop_summary", "product_summary",
    "dup_report", "column_profile", "numeric_summary", "status_counts",
)
# Measured after the headline set and not part of its total, which so stays comparable over the rounds.
MORE = ("exact_dedup", "dedup_stats", "load_pair_csv", "encoded_orders", "preview_page", "run_report", "stream_ingest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        app_name="margin-engine-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the JVM (class loading, JIT, codegen caches) once; not timed.
    for name in ("header_row_drop", "clean_keyword"):
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE + MORE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times[n] for n in HEADLINE), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
