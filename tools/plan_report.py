"""Write PLANS.md: the shape of every registered query's final physical plan.

Usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)
Each query is executed once so the adaptive plan is final; the table counts
shuffles, broadcasts, join strategies and the columns each scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fluxsite.plans import catalog  # noqa: E402
from fluxsite.session import local_session  # noqa: E402


def shape(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange SinglePartition|\bExchange rangepartitioning", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "window": plan.count("Window ["),
        "generate": plan.count("Generate "),
        "scan_cols": max((len(s.split(",")) for s in scans), default=0),
        "reused": plan.count("ReusedExchange"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rows = []
    for name, fn in catalog.queries().items():
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        rows.append((name, shape(plan)))
        print(name, rows[-1][1], file=sys.stderr)
    out = [
        "# Physical plan shapes",
        "",
        f"Final adaptive plans of the registered queries at `{sf_dir}` on `local[8]`",
        "(generated by `tools/plan_report.py`). Shuffles include those of the test-data",
        "bindings (the meter readings are themselves an aggregate of `lineitem`).",
        "No plan has a cartesian product, a nested-loop join or Python evaluation",
        "(`tests/test_plans.py`).",
        "",
        "| query | shuffles | broadcasts | broadcast joins | sort-merge joins | windows | explodes | max scan columns | reused exchanges |",
        "|---|---|---|---|---|---|---|---|---|",
    ]
    for name, s in rows:
        out.append(
            f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['bhj']} | {s['smj']} | {s['window']} | "
            f"{s['generate']} | {s['scan_cols']} | {s['reused']} |"
        )
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
