"""Summarise the physical plan of every registered query into PLANS.md.

Counts shuffles (Exchange), join strategies, aggregations, windows and Python nodes, and
lists each parquet scan's read schema and pushed filters. Plans are the initial AQE
plans (AQE may still coalesce partitions or switch joins at run time).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODES = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
         "ObjectHashAggregate", "Window", "ArrowEvalPython", "MapInPandas", "BatchEvalPython")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from labelset.plans import all_queries
    from labelset.session import get_spark

    spark = get_spark("plans", cpus=8, shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_summary.py` on `{sf_dir}` (initial adaptive plans). "
          "`Exchange` counts shuffles (hash/range/single) and excludes broadcasts.\n")
    print("| Query | Shuffles | Broadcasts | SMJ | BHJ | Aggregates | Windows | Python nodes | NL/Cartesian |")
    print("|---|---|---|---|---|---|---|---|---|")
    scans = {}
    for name, q in all_queries().items():
        df = q.build(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = {n: len(re.findall(rf"(?<![A-Za-z]){n}\b", plan)) for n in NODES}
        aggs = c["HashAggregate"] + c["SortAggregate"] + c["ObjectHashAggregate"]
        py = c["ArrowEvalPython"] + c["MapInPandas"] + c["BatchEvalPython"]
        nl = c["BroadcastNestedLoopJoin"] + c["CartesianProduct"]
        print(f"| `{name}` | {c['Exchange']} | {c['BroadcastExchange']} | {c['SortMergeJoin']} | "
              f"{c['BroadcastHashJoin']} | {aggs} | {c['Window']} | {py} | {nl} |")
        found = set()
        for m in re.finditer(r"FileScan parquet [^\n]*", plan):
            line = m.group(0)
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            tbl = re.search(r"/([a-z_]+)\.parquet", line)
            if rs:
                found.add((tbl.group(1) if tbl else "?", rs.group(1), pf.group(1) if pf else "[]"))
        scans[name] = sorted(found)
    print("\n## Parquet scans (column pruning and pushed filters)\n")
    for name, fs in scans.items():
        if fs:
            print(f"* `{name}`: " + "; ".join(f"{t} {s} pushed {p}" for t, s, p in fs))


if __name__ == "__main__":
    main(sys.argv)
