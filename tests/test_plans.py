"""Plan-shape regression tests: the scale properties the design relies on."""

import re

from factlake.plans import analytics as A
from factlake.plans.operator_queries import operator_queries
from factlake.sources.fixtures import fixture_tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_dedup_limits_rows_before_the_shuffle(spark):
    plan = _plan(A.revenue_yoy(fixture_tables(spark, SF)))
    # partial WindowGroupLimit sits below the exchange on (cik, fy)
    assert re.search(r"Exchange hashpartitioning\(cik#\d+L, fy#\d+.*\n.*WindowGroupLimit.*Partial",
                     plan), plan


def _fact_scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet .*lineitem", plan))


def test_facts_are_read_once_before_the_percentiles(spark):
    """The counts per group and value are cut; nothing after reads the facts."""
    t = fixture_tables(spark, SF)
    for query in (A.revenue_distribution(t), A.etr_dispersion(t, fy=1999), A.top5_share_shift(t, y0=1998, y1=1999)):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert _fact_scans(plan) == 0 and "Scan ExistingRDD" in plan


def test_fact_counts_are_aggregated_before_the_tag_join(spark):
    plan = _plan(A.top_standard_tags(fixture_tables(spark, SF)))
    join_at = plan.index("Join")
    # a partial count over the facts appears below the join
    assert "partial_count" in plan[join_at:]


def test_small_domain_percentiles_need_no_join(spark):
    plan = _plan(A.filing_lag(fixture_tables(spark, SF)))
    # counts per day value, a window over at most 365 values, one join of
    # two small per-group aggregates
    assert plan.count("Join") <= 2


def test_hhi_has_no_join(spark):
    plan = _plan(A.hhi_concentration(fixture_tables(spark, SF), fy=1999))
    body = plan.split("BroadcastHashJoin")
    # the only join is filings x facts (before the dedup), none after it
    assert len(body) == 2


def test_restatement_pairs_never_joins_filings_to_filings_unbounded(spark):
    plan = _plan(A.restatement_pairs(fixture_tables(spark, SF)))
    # every join below the final top-k has a broadcast (bounded) side or is
    # the per-date join of aggregated counts
    assert plan.count("SortMergeJoin") <= 1


def test_lake_scans_get_pushed_filters_and_pruned_columns(spark, scratch):
    from factlake.plans.ingest import ingest_quarters
    from factlake.sources.lake import LakeTables
    from tsvdata import num_row, pre_row, sub_row, tag_row, write_quarter

    write_quarter(f"{scratch}/raw", "2024q1", [sub_row("A1")], [tag_row("Revenues")],
                  [num_row("A1")], [pre_row("A1")])
    ingest_quarters(spark, f"{scratch}/raw", f"{scratch}/lake", ["2024q1"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")   # untruncated plan text
    try:
        plan = _plan(A.revenue_yoy(LakeTables(spark, f"{scratch}/lake")))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = " ".join(ln.split("PushedFilters:", 1)[1] for ln in plan.splitlines()
                      if "PushedFilters:" in ln)
    for f in ("In(tag,", "EqualTo(qtrs,4)", "EqualTo(uom,USD)", "EqualTo(segments,)",
              "GreaterThan(value,0", "In(form,"):
        assert f in pushed, (f, pushed)
    # the fact scan reads only the columns the analysis needs
    num_scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "ddate" in ln][0]
    assert "footnote" not in num_scan and "pre" not in num_scan.split("Location")[0]


def test_replace_by_filing_hashes_keys_and_sorts_no_rows(spark):
    """Its shuffle grows in proportion: the same plan at every size, whose wide rows are not sorted."""
    plan = operator_queries()["replace_by_filing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Sort [" not in plan and "Broadcast" not in plan
