"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all
cores), BENCH_REPEAT (default 3; the best run counts, after one untimed warm-up
pass). A timed run builds the query's plan and executes it to completion
through the no-op sink, so nothing is pulled to the driver.
Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fluxsite.plans import catalog  # noqa: E402
from fluxsite.session import local_session  # noqa: E402

HEADLINE = [
    "by_unit",
    "by_building_unit",
    "by_building",
    "allocate_cost",
    "global_cost",
    "redistribute_unit_contains",
    "redistribute_building_unit",
    "series_by_year",
    "year_over_year",
    "occupancy_staff",
    "standardise_headers",
    "export_enriched",
    "unpivot_years",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="fluxsite-bench",
                          extra={"spark.driver.memory": "4g"})
    qs = catalog.SPARK
    # warm-up pass (JIT, generated code, file listings); not timed
    for name in HEADLINE:
        run(qs[name](spark, sf_dir))
    # timed passes: plan building + full execution, best of `repeat`
    times = {}
    for _ in range(repeat):
        for name in HEADLINE:
            t0 = time.perf_counter()
            run(qs[name](spark, sf_dir))
            dt = time.perf_counter() - t0
            times[name] = round(dt if name not in times else min(times[name], dt), 3)
    for name, t in times.items():
        print(f"{name}: {t:.3f}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
