"""Benchmark: the twenty analyses over the fixture views at one scale.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is planned and fully executed (``collect`` of its result, which
is small for every analysis); a warm-up run primes the JVM first. ``value``
and ``queries`` are first runs; ``value_warm`` / ``queries_warm`` repeat each
query (best of ``BENCH_REPS``). The load job's throughput is reported too.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def bench_ingest(spark, sf_dir: str) -> dict:
    """Quarterly load throughput: the fixture tables are written once as
    tab-separated quarter files (setup, untimed), then ``ingest_quarters``
    parses, cleans, deduplicates and writes them as a lake snapshot."""
    import tempfile

    from factlake.plans.ingest import ingest_quarters
    from factlake.sources.export import write_quarter_files
    from factlake.sources.fixtures import fixture_tables
    from factlake.sources.tsv import SPARK_LAYOUT

    work = tempfile.mkdtemp(prefix="factlake-bench-")
    quarters = write_quarter_files(fixture_tables(spark, sf_dir), f"{work}/raw")
    t0 = time.perf_counter()
    res = ingest_quarters(spark, f"{work}/raw", f"{work}/lake", quarters, layout=SPARK_LAYOUT)
    sec = time.perf_counter() - t0
    rows = res.audit.agg({"rows_read": "sum"}).first()[0] or 0
    # incremental: re-publish the last quarter on top of the full lake; only
    # the partitions it can affect are rewritten, the rest is referenced
    t1 = time.perf_counter()
    ingest_quarters(spark, f"{work}/raw", f"{work}/lake", quarters[-1:], layout=SPARK_LAYOUT)
    inc = time.perf_counter() - t1
    return {"ingest_sec": round(sec, 3), "ingest_rows": int(rows),
            "ingest_rows_per_sec": round(rows / sec, 1), "ingest_quarters": len(quarters),
            "ingest_reload_one_quarter_sec": round(inc, 3)}


def main() -> None:
    from factlake.plans.registry import analysis_queries
    from factlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          app="factlake-bench")

    qs = analysis_queries()
    if only:
        qs = {k: v for k, v in qs.items() if k in only}
    # warm-up: JVM, parquet footers, codegen caches
    next(iter(qs.values()))(spark, sf_dir).collect()

    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name, fn in qs.items():
        runs = []
        for _ in range(max(reps, 1) + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).collect()
            runs.append(time.perf_counter() - t0)
        times[name] = round(runs[0], 3)          # first run: planning + codegen + execution
        warm[name] = round(min(runs[1:]), 3)     # repeated run of the same query
    ingest = {} if os.environ.get("BENCH_SKIP_INGEST") else bench_ingest(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "analyses_total_time", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus, "value_warm": round(sum(warm.values()), 3), "queries_warm": warm,
           **ingest}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
