"""Post-load data-quality report: one row per check.

(check, table_name, value, expected, ok) where ``ok`` is NULL when a check
has no expectation. Each table's row count, key duplicates and required NULLs come
from one partially aggregated pass over it; the report is a union of a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.facts import consolidated_annual
from factlake.operators.joins import missing_concept
from factlake.operators.quality import (custom_tag_share, orphan_count, reporting_multiplicity,
                                        table_audit)
from factlake.schema import CONCEPTS, KEYS, REQUIRED

TABLES = ("sub", "tag", "num", "pre")


def _row(df: DataFrame, check: str, table: str, value, expected=None) -> DataFrame:
    exp = F.lit(expected).cast("double") if expected is not None else F.lit(None).cast("double")
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table_name"),
                     F.col(value).cast("double").alias("value") if isinstance(value, str)
                     else value.cast("double").alias("value"), exp.alias("expected"))


def dq_report(tables, expected_counts: Mapping[str, int] | None = None,
              tolerance: float = 0.005) -> DataFrame:
    """Orphans, key uniqueness, required NULLs, row counts (against expected
    counts within ``tolerance``), custom-tag share, tags in several versions,
    reporting multiplicity, 10-K filings without a net-income fact."""
    t = {name: getattr(tables, name) for name in TABLES}
    expected_counts = expected_counts or {}
    parts = [_row(orphan_count(t["num"], t["sub"]), "orphan_facts", "num", "orphans", 0)]
    for name in TABLES:
        parts.append(table_audit(t[name], KEYS[name], REQUIRED[name], name, expected_counts.get(name)))
    parts.append(custom_tag_share(t["tag"]).selectExpr(
        "stack(2, 'custom_tag_share', custom_share, 'multi_version_tags', cast(multi_version_tags as double))"
        " as (check, value)").select("check", F.lit("tag").alias("table_name"), "value",
                                     F.lit(None).cast("double").alias("expected")))
    facts = t["num"].select("adsh", "tag", F.year("ddate").alias("fy")).join(
        t["sub"].select("adsh", "cik"), "adsh")
    parts.append(_row(reporting_multiplicity(facts), "avg_reports_per_value", "num",
                      F.round("avg_reports", 6)))
    tenk = t["sub"].where(F.col("form") == "10-K").select("adsh")
    ni = consolidated_annual(t["num"], tags=CONCEPTS["net_income_any"]).select("adsh")
    parts.append(_row(missing_concept(tenk, ni).agg(F.count(F.lit(1)).alias("n")),
                      "filings_missing_net_income", "sub", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ok = (F.when(F.col("expected").isNull(), F.lit(None).cast("boolean"))
          .when(F.col("expected") == 0, F.col("value") == 0)
          .otherwise(F.abs(F.col("value") - F.col("expected"))
                     <= F.lit(tolerance) * F.col("expected")))
    return out.withColumn("ok", ok)
