"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Every query is forced end to end with the ``noop`` sink (all rows computed, nothing
collected to the driver). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

# every registered query is timed unless BENCH_QUERIES lists a subset (comma-separated)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    from labelset.plans import all_queries
    from labelset.session import get_spark

    n_cpu = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = get_spark("labelset-bench", cpus=cpus, shuffle_partitions=max(8, 2 * n_cpu),
                      extra={"spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="labelset-bench-ckpt-"))
    reg = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = [q for q in wanted.split(",") if q in reg] if wanted and wanted != "all" else list(reg)
    times, errors = {}, {}
    # start-up (first job, first Python worker, first table) is no query's time
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.time()
        try:
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - reported, the bench goes on
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
