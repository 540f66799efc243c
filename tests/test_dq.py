"""Data-quality report: expectations and zero checks."""

from factlake.plans.dq import dq_report
from factlake.sources.fixtures import fixture_tables


def test_dq_report_counts_within_tolerance(spark):
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    n_sub = t.sub.count()
    rep = {(r["check"], r["table_name"]): r
           for r in dq_report(t, {"sub": n_sub + 5, "tag": 1000}).collect()}
    assert rep[("row_count", "sub")]["ok"] is True          # 5 rows off is within 0.5 %
    assert rep[("row_count", "tag")]["ok"] is False
    assert rep[("row_count", "num")]["ok"] is None           # no expectation given
    assert rep[("orphan_facts", "num")]["ok"] is True
    assert rep[("duplicate_keys", "sub")]["value"] == 0
    assert rep[("duplicate_keys", "num")]["ok"] is False      # the fixture repeats fact keys
    assert all(r["ok"] for k, r in rep.items() if k[0].startswith("null:"))
