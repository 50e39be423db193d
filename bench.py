"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries run twice to warm up the JVM, then each runs $BENCH_RUNS times (default 5) into
the ``noop`` sink, which executes the full plan without writing. The per-query value is the
median run; each run includes building the DataFrame (footer reads, analysis, planning).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from starweave.plans.registry import QUERIES  # noqa: E402
from starweave.session import local_session  # noqa: E402

HEADLINE = ["star_join", "case_first", "case_attributes_on_events", "pk_duplicates", "profile_columns",
            "finance_per_resource", "event_order", "durations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(2 * cpus, 8))))
    spark = local_session(cpus, shuffle_partitions=parts, app="starweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sw-bench-ckpt-"))
    timings: dict[str, float | None] = {}
    errors: dict[str, str] = {}

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for _ in range(2):  # warm-up of every query first: JIT, codegen and file-listing caches
        for name in names:
            try:
                run(name)
            except Exception as exc:  # reported below; the other queries still run
                errors[name] = repr(exc)[:300]
    for name in names:
        if name in errors:
            timings[name] = None
            continue
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(name)
            samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 4)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_sec",
        "value": round(sum(v for v in timings.values() if v is not None), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
