"""Write PLANS.md: physical plans of the analyses over an ingested lake.

    python tools/plan_report.py [sf_dir] [out.md]

The fixture tables are exported as quarterly TSV files, loaded with the
ingest job into a scratch lake, and each analysis is executed on the lake
tables; the report lists, per analysis, the exchanges (shuffles), join
strategies, window-group limits and the filters pushed to the Parquet scans,
followed by full formatted plans of a few representative analyses.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def summarize(plan: str) -> dict:
    pushed = sorted({ln.split("PushedFilters: ", 1)[1].split(", ReadSchema")[0]
                     for ln in plan.splitlines() if "PushedFilters: " in ln})
    return {
        "shuffles": len(re.findall(r"Exchange (?:hash|range|single|round)", plan, re.I)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "window_group_limits": plan.count("WindowGroupLimit"),
        "scans": plan.count("FileScan parquet"),
        "pushed": [p for p in pushed if p],
    }


def main() -> None:
    from factlake.plans.ingest import ingest_quarters
    from factlake.plans.registry import ANALYSES, FIXTURE_PARAMS
    from factlake.session import local_session
    from factlake.sources.export import write_quarter_files
    from factlake.sources.fixtures import fixture_tables
    from factlake.sources.lake import LakeTables
    from factlake.sources.tsv import SPARK_LAYOUT

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = local_session(8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")   # untruncated filters
    work = tempfile.mkdtemp(prefix="factlake-plans-")
    quarters = write_quarter_files(fixture_tables(spark, sf_dir), f"{work}/raw")
    ingest_quarters(spark, f"{work}/raw", f"{work}/lake", quarters, layout=SPARK_LAYOUT)
    t = LakeTables(spark, f"{work}/lake")

    lines = ["# Physical plans over an ingested lake", "",
             f"Input: fixture tables of `{sf_dir}` exported as {len(quarters)} quarterly TSV "
             "folders and loaded with `ingest_quarters`; analyses run on `LakeTables` "
             "(local[8], AQE on). Generated by `tools/plan_report.py`.", "",
             "| analysis | shuffles | BHJ | SMJ | WindowGroupLimit | scans | filters pushed to Parquet |",
             "| --- | --- | --- | --- | --- | --- | --- |"]
    full = {}
    for name, fn in ANALYSES.items():
        df = fn(t, **FIXTURE_PARAMS.get(name, {}))
        df.collect()
        plan = final_plan(df)
        s = summarize(plan)
        pushed = "<br>".join(f"`{p}`" for p in s["pushed"]) or "–"
        lines.append(f"| {name} | {s['shuffles']} | {s['broadcast_joins']} | {s['sort_merge_joins']} "
                     f"| {s['window_group_limits']} | {s['scans']} | {pushed} |")
        if name in ("revenue_yoy", "top_standard_tags", "restatement_pairs"):
            full[name] = plan
    lines += ["", "Counts are of the final adaptive plan (after AQE re-planning).", ""]
    for name, plan in full.items():
        lines += [f"## {name}", "", "```", plan.strip(), "```", ""]
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out}")


if __name__ == "__main__":
    main()
