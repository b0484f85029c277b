"""Time the catalog at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and then ``$BENCH_RUNS`` times; its time is the median.
Results go to Spark's ``noop`` sink, so all rows and columns are computed but none are
collected. ``$BENCH_QUERIES`` (comma-separated) selects queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import streamed  # noqa: F401
from tidemark.plans.catalog import QUERIES
from tidemark.session import local_session


def timed(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "tidemark-bench")
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
