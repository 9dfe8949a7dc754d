"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query once to warm the JVM, then times two full executions
(every column computed, nothing collected: the ``noop`` sink; plan building
included) and keeps the faster, the machine being noisy. Prints one JSON
line with the per-query seconds and their sum.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from souk.registry import spark_query  # noqa: E402
from souk.session import build_session  # noqa: E402

HEADLINE = (
    "seller_mart",
    "product_mart",
    "order_features",
    "order_features_distance",
    "link_table",
    "removal_gain_curve",
    "city_rollup",
    "box_wait_time",
)


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    spark_query(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    extra = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="souk-bench-")}
    extra |= json.loads(os.environ.get("BENCH_CONF", "{}"))
    spark = build_session(
        f"local[{cpus}]", shuffle_partitions=cpus, driver_memory="16g", extra=extra
    )
    for name in names:  # warm-up: JIT, file listing, codegen caches
        run(spark, name, sf_dir)
    times = {name: round(min(run(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
