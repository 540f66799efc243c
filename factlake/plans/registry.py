"""Named queries over the fixture views built from the driver's tables.

Each entry is ``(spark, sf_dir) -> DataFrame``. Parameters differ from the
published defaults only where the fixture data has other years and
magnitudes (FIXTURES.md §3); the defaults stay in the analysis functions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlake.plans import analytics as A
from factlake.session import apply_plan_confs
from factlake.sources.fixtures import fixture_tables

# Fixture parameters (the fixtures span fact years 1994-2000, filings 1995-2001).
FIXTURE_PARAMS: dict[str, dict] = {
    "top_by_sector": {"years": (1996, 1999)},
    "margin_compression": {"year": 1999, "min_revenue": 1e9},
    "top_expenses": {"ciks": [1, 2, 3, 4, 5]},
    "hhi_concentration": {"fy": 1999, "min_firms": 5},
    "etr_dispersion": {"fy": 1999, "min_firms": 3},
    "income_statement_wide": {"ciks": [1, 2, 3, 4, 5, 6], "fy": 1999},
    "fcf_margin": {"fy": 1999, "min_revenue": 1e10},
    "short_lived_filers": {"max_days": 2390, "stopped_before": dt.date(2001, 7, 25)},
    "top5_share_shift": {"y0": 1996, "y1": 1999, "min_total": 1e10, "min_firms": 10},
}

ANALYSES: dict[str, Callable] = {
    "filings_by_year": A.filings_by_year,
    "sectors": A.sectors,
    "top_filers": A.top_filers,
    "top_standard_tags": A.top_standard_tags,
    "revenue_distribution": A.revenue_distribution,
    "missing_net_income": A.missing_net_income,
    "revenue_yoy": A.revenue_yoy,
    "revenue_rolling": A.revenue_rolling,
    "top_by_sector": A.top_by_sector,
    "margin_compression": A.margin_compression,
    "restatement_pairs": A.restatement_pairs,
    "top_expenses": A.top_expenses,
    "hhi_concentration": A.hhi_concentration,
    "etr_dispersion": A.etr_dispersion,
    "cash_conversion": A.cash_conversion,
    "income_statement_wide": A.income_statement_wide,
    "fcf_margin": A.fcf_margin,
    "filing_lag": A.filing_lag,
    "short_lived_filers": A.short_lived_filers,
    "top5_share_shift": A.top5_share_shift,
}


def _analysis_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = ANALYSES[name]
    params = FIXTURE_PARAMS.get(name, {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_plan_confs(spark)
        return fn(fixture_tables(spark, sf_dir), **params)

    run.__name__ = name
    run.__doc__ = fn.__doc__
    return run


def analysis_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _analysis_query(name) for name in ANALYSES}
