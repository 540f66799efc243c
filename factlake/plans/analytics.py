"""The twenty filing analyses, composed from the reusable operators.

Every function takes the filing tables (``sub``, ``num``, ``tag`` as lazy
DataFrames: lake tables or fixture views) plus parameters whose defaults are
the published constants, and returns a lazy DataFrame. Orders are total
(a deterministic tie-break is appended to every sort that feeds a LIMIT).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import days_between, fiscal_year, safe_ratio, to_decimal
from factlake.operators.dedup import latest_value
from factlake.operators.facts import consolidated_annual, filing_facts
from factlake.operators.joins import amendment_pairs, missing_concept
from factlake.operators.pivot import pivot_concepts
from factlake.operators.ranking import rank_topn, top_k, topk_per_row
from factlake.operators.series import growth, prior_value, rolling
from factlake.operators.stats import hhi, percentiles, percentiles_small_domain, topn_share
from factlake.schema import (ANNUAL_FORMS, BLANK_CHECK_SIC, CONCEPTS, EXPENSE_TAGS,
                             FORM_10K, FORM_10KA, MEGACAP_CIKS, MEGACAP_CIKS_WITH_BRK,
                             SECTOR_SICS)
from factlake.session import ensure_checkpoint_dir

REVENUE_TAGS = CONCEPTS["revenue"]


# --------------------------------------------------------------------------
# Filing-header analyses (sub only)
# --------------------------------------------------------------------------

def filings_by_year(t) -> DataFrame:
    """Filings per filing year and form."""
    return (t.sub.select(fiscal_year("filed").alias("filing_year"), "form")
            .groupBy("filing_year", "form").agg(F.count(F.lit(1)).alias("filings"))
            .orderBy("filing_year", F.desc("filings"), "form"))


def sectors(t, limit: int = 25) -> DataFrame:
    """Distinct companies and filings per SIC code, top ``limit`` by companies."""
    g = (t.sub.where(F.col("sic").isNotNull()).groupBy("sic")
         .agg(F.countDistinct("cik").alias("companies"), F.count(F.lit(1)).alias("filings")))
    return top_k(g, [F.desc("companies"), F.asc("sic")], limit)


def top_filers(t, limit: int = 20, latest_name: str = "max") -> DataFrame:
    """Companies with the most filings.

    ``latest_name="max"`` is the published ``MAX(name)`` (the greatest name
    text); ``"filed"`` takes the name on the most recently filed submission.
    """
    name = (F.max("name") if latest_name == "max"
            else F.max_by("name", F.struct("filed", "adsh")))
    g = t.sub.groupBy("cik").agg(
        name.alias("latest_name"), F.count(F.lit(1)).alias("filings"),
        F.countDistinct("form").alias("form_types"),
        F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"))
    return top_k(g, [F.desc("filings"), F.asc("cik")], limit)


def filing_lag(t, form: str = FORM_10K, min_days: int = 1, max_days: int = 365,
               late_after: int = 90) -> DataFrame:
    """Days from period end to filing per filer status and period year:
    quartiles, p95 and the count of filings later than ``late_after``."""
    base = (t.sub.where((F.col("form") == form) & F.col("period").isNotNull()
                        & F.col("afs").isNotNull())
            .select("afs", fiscal_year("period").alias("period_year"),
                    days_between("filed", "period").alias("lag_days"))
            .where(F.col("lag_days").between(min_days, max_days)))
    # lag_days is restricted to [min_days, max_days]: a small bounded domain
    pct = percentiles_small_domain(base, ["afs", "period_year"], "lag_days",
                                   [0.25, 0.5, 0.75, 0.95],
                                   ["p25_days", "median_days", "p75_days", "p95_days"], count_name="filings",
                                   count_if={"late_filings": F.col("_v") > late_after})
    return (pct
            .select("afs", "period_year", "filings", "p25_days", "median_days", "p75_days",
                    "p95_days", "late_filings")
            .orderBy("afs", "period_year"))


def short_lived_filers(t, sic: int = BLANK_CHECK_SIC, min_days: int = 30, max_days: int = 730,
                       stopped_before: dt.date = dt.date(2025, 1, 1), limit: int = 25) -> DataFrame:
    """Companies of one SIC code active between ``min_days`` and ``max_days``
    that stopped filing before ``stopped_before``."""
    g = (t.sub.where(F.col("sic") == sic).groupBy("cik")
         .agg(F.max("name").alias("name"), F.min("filed").alias("first_filing"),
              F.max("filed").alias("last_filing"), F.count(F.lit(1)).alias("filing_count"),
              F.countDistinct("form").alias("form_types"))
         .withColumn("days_active", days_between("last_filing", "first_filing"))
         .where(F.col("days_active").between(min_days, max_days)
                & (F.col("last_filing") < F.lit(stopped_before))))
    g = g.select("cik", "name", "first_filing", "last_filing", "days_active",
                 "filing_count", "form_types")
    return top_k(g, [F.desc("filing_count"), F.desc("days_active"), F.asc("cik")], limit)


def restatement_pairs(t, min_days: int = 1, max_days: int = 1095, limit: int = 25) -> DataFrame:
    """Original 10-K / later 10-K/A pairs for the same company and period,
    the ``limit`` widest gaps."""
    s = t.sub.where(F.col("period").isNotNull())
    originals = s.where(F.col("form") == FORM_10K).select(
        "cik", "period", F.col("adsh").alias("adsh_original"),
        F.col("filed").alias("filed_original"), "name")
    amendments = s.where(F.col("form") == FORM_10KA).select(
        "cik", "period", F.col("adsh").alias("adsh_amended"),
        F.col("filed").alias("filed_amended"))
    pairs = amendment_pairs(originals, amendments, ["cik", "period"], min_days, max_days, limit)
    return pairs.select("cik", "name", "period", "filed_original", "filed_amended",
                        "days_between", "adsh_original", "adsh_amended")


# --------------------------------------------------------------------------
# Fact analyses without deduplication
# --------------------------------------------------------------------------

def top_standard_tags(t, limit: int = 25) -> DataFrame:
    """Most used standard, concrete tags (summed over all versions).

    Facts are counted per (tag, version) *before* the join: the dimension
    join then sees one row per tag version instead of one per fact, and a
    hot tag is pre-aggregated map-side.
    """
    per_version = t.num.groupBy("tag", "version").agg(F.count(F.lit(1)).alias("_n"))
    std = t.tag.where((F.col("custom") == 0) & (F.col("abstract") == 0)).select(
        "tag", "version", "tlabel")
    g = (per_version.join(std, ["tag", "version"]).groupBy("tag")
         .agg(F.sum("_n").alias("occurrences"), F.max("tlabel").alias("sample_label")))
    return top_k(g, [F.desc("occurrences"), F.asc("tag")], limit)


def revenue_distribution(t, form: str = FORM_10K, tags: Sequence[str] = REVENUE_TAGS,
                         by_version: bool = True, dedup: bool = False) -> DataFrame:
    """Reported annual revenue facts of 10-K filings per fact year and
    taxonomy version: count, exact median, mean, total.

    As published this is *not* deduplicated and groups by taxonomy version.
    ``dedup=True`` first keeps the latest-filed value per (cik, year) (the
    annual series the header describes); ``by_version=False`` groups by year
    only (then ``taxonomy_version`` is NULL).
    """
    if dedup:
        facts = filing_facts(t.sub, t.num, [form], tags, positive=True)
        facts = latest_value(facts, ["cik", "fy"])
    else:
        facts = (consolidated_annual(t.num, tags=tags, positive=True)
                 .select("adsh", "ddate", "version", "value"))
        facts = facts.join(t.sub.where(F.col("form") == form).select("adsh"), "adsh")
    facts = facts.select(fiscal_year("ddate").alias("fiscal_year"),
                         F.col("version").alias("taxonomy_version"), "value")
    keys = ["fiscal_year", "taxonomy_version"] if by_version else ["fiscal_year"]
    out = percentiles(facts, keys, "value", [0.5], ["median_revenue"], count_name="filings_reporting", sum_name="_total")
    out = out.withColumns({"mean_revenue": to_decimal(F.col("_total") / F.col("filings_reporting"), 28, 2),
                           "total_revenue": to_decimal("_total", 28, 0)})
    if not by_version:
        out = out.withColumn("taxonomy_version", F.lit(None).cast("string"))
        keys = ["fiscal_year", "taxonomy_version"]
    return (out
            .select(*keys, "filings_reporting",
                    to_decimal("median_revenue", 28, 2).alias("median_revenue"),
                    "mean_revenue", "total_revenue")
            .orderBy(*keys))


def missing_net_income(t, form: str = FORM_10K,
                       tags: Sequence[str] = CONCEPTS["net_income_any"]) -> DataFrame:
    """10-K filings (with a period) that report none of the net-income tags as
    a consolidated annual USD fact, per period year."""
    filings = t.sub.where((F.col("form") == form) & F.col("period").isNotNull()).select(
        "adsh", "period")
    ni = consolidated_annual(t.num, tags=tags).select("adsh")
    return (missing_concept(filings, ni, "adsh")
            .groupBy(fiscal_year("period").alias("fiscal_year"))
            .agg(F.count(F.lit(1)).alias("filings_missing_ni"))
            .orderBy("fiscal_year"))


def top_expenses(t, ciks: Sequence[int] = MEGACAP_CIKS, tags: Sequence[str] = EXPENSE_TAGS,
                 k: int = 3, form: str = FORM_10K) -> DataFrame:
    """Per 10-K filing of the given companies, its ``k`` largest current-year
    expense facts (``ddate = period``)."""
    filings = (t.sub.where((F.col("form") == form) & F.col("period").isNotNull()
                           & F.col("cik").isin(list(ciks)))
               .select("adsh", "name", F.col("period").alias("ddate"),
                       fiscal_year("period").alias("fy")))
    facts = consolidated_annual(t.num, tags=tags, positive=True).select(
        "adsh", "ddate", "tag", "version", "value")
    top = topk_per_row(filings, facts, ["adsh", "ddate"], ["adsh"],
                       [F.desc("value"), F.asc("tag"), F.asc("version")], k)
    return (top.select("name", "fy", "tag", "value")
            .orderBy("name", F.desc("fy"), F.desc("value"), "tag"))


# --------------------------------------------------------------------------
# Deduplicated revenue series
# --------------------------------------------------------------------------

def annual_revenue(t, sub_cols: Sequence[str] = (), require_sic: bool = False) -> DataFrame:
    """Latest-filed consolidated annual revenue per (cik, fy): the shared
    first stage of the revenue family (value > 0 before the ranking)."""
    cols = ["cik", *sub_cols]
    where = F.col("sic").isNotNull() if require_sic else None
    facts = filing_facts(t.sub, t.num, ANNUAL_FORMS, REVENUE_TAGS, sub_cols=cols,
                         sub_where=where, positive=True)
    latest = latest_value(facts, ["cik", "fy"])
    return latest.select(*cols, "fy", F.col("value").alias("revenue"))


def revenue_yoy(t, limit: int = 30) -> DataFrame:
    """Year-over-year revenue growth per company (previous available year)."""
    rev = annual_revenue(t)
    g = growth(rev, "cik", "fy", "revenue", prior="prior_revenue", out="yoy_growth")
    g = g.select("cik", F.col("fy").alias("fiscal_year"), "revenue", "prior_revenue", "yoy_growth")
    return top_k(g, [F.asc("cik"), F.asc("fiscal_year")], limit)


def revenue_rolling(t, rows: int = 3, limit: int = 30) -> DataFrame:
    """Trailing three-row revenue sum and the number of rows in the frame."""
    rev = annual_revenue(t)
    r = rolling(rev, "cik", "fy", "revenue", rows, "revenue_3yr_sum", "years_in_window")
    r = r.select("cik", F.col("fy").alias("fiscal_year"), "revenue", "revenue_3yr_sum",
                 "years_in_window")
    return top_k(r, [F.asc("cik"), F.asc("fiscal_year")], limit)


def top_by_sector(t, k: int = 5, years: tuple[int, int] = (2021, 2024),
                  sics: Sequence[int] = SECTOR_SICS) -> DataFrame:
    """Top ``k`` companies by revenue per (sic, year) with RANK ties.

    ``sic`` and ``fiscal_year`` are both rank-partition keys, so filtering
    them before the rank gives the same rows; the year filter is applied on
    the ``fy`` column after the dedup (dedup keys include fy, so Catalyst
    pushes it to the fact scan), the sic filter after the dedup (sic is not
    a dedup key: a company can change sic between filings).
    """
    rev = annual_revenue(t, sub_cols=("sic", "name"), require_sic=True)
    rev = rev.where(F.col("fy").between(*years)).where(F.col("sic").isin(list(sics)))
    ranked = rank_topn(rev, ["sic", "fy"], [F.desc("revenue")], k, out="sector_rank")
    return (ranked.select("sic", F.col("fy").alias("fiscal_year"), "sector_rank", "cik",
                          "name", "revenue")
            .orderBy("sic", "fiscal_year", "sector_rank", "cik"))


def hhi_concentration(t, fy: int = 2024, min_firms: int = 5, limit: int = 25,
                      high: float = 2500.0, moderate: float = 1500.0) -> DataFrame:
    """Herfindahl-Hirschman index of revenue per (sic, year)."""
    rev = annual_revenue(t, sub_cols=("sic",), require_sic=True).where(F.col("fy") == fy)
    h = hhi(rev, ["sic", "fy"], "revenue", min_firms, high, moderate)
    out = h.select("sic", "fy", F.col("members").alias("firm_count"),
                   F.col("total").alias("sector_revenue"),
                   to_decimal("hhi", 8, 1).alias("hhi"),
                   F.col("label").alias("concentration_label"))
    return top_k(out, [F.desc("hhi"), F.asc("sic")], limit)


def top5_share_shift(t, k: int = 5, y0: int = 2021, y1: int = 2024,
                     min_total: float = 1e10, min_firms: int = 10, limit: int = 25) -> DataFrame:
    """Change of the top-``k`` revenue share per sector between two years.

    The facts are read once: the revenues of both years, a row per company
    and year, are cut by a checkpoint, from which totals and top values are
    taken; years are set side by side by conditional aggregation.
    """
    ensure_checkpoint_dir(t.sub.sparkSession)
    rev = (annual_revenue(t, sub_cols=("sic",), require_sic=True)
           .where(F.col("fy").isin(y0, y1)).select("sic", "fy", "revenue").checkpoint())
    s = (topn_share(rev, ["sic", "fy"], "revenue", k)
         .where((F.col("total") > F.lit(min_total)) & (F.col("members") >= min_firms)))

    def pick(col, year):
        return F.max(F.when(F.col("fy") == year, F.col(col)))

    w = (s.groupBy("sic").agg(
        pick("members", y0).alias("firms_0"), pick("members", y1).alias("firms_1"),
        pick("total", y0).alias("total_0"), pick("total", y1).alias("total_1"),
        pick("top_share", y0).alias("share_0"), pick("top_share", y1).alias("share_1"))
        .where(F.col("firms_0").isNotNull() & F.col("firms_1").isNotNull()))
    out = w.select(
        "sic", F.col("firms_0").alias(f"firms_{y0}"), F.col("firms_1").alias(f"firms_{y1}"),
        to_decimal("total_0", 28, 0).alias(f"total_{y0}"),
        to_decimal("total_1", 28, 0).alias(f"total_{y1}"),
        to_decimal("share_0", 6, 4).alias(f"top5_share_{y0}"),
        to_decimal("share_1", 6, 4).alias(f"top5_share_{y1}"),
        to_decimal(F.col("share_1") - F.col("share_0"), 6, 4).alias("share_change"),
        F.abs(F.col("share_1") - F.col("share_0")).alias("_abs"))
    return top_k(out, [F.desc("_abs"), F.asc("sic")], limit).drop("_abs")


# --------------------------------------------------------------------------
# Deduplicated per-tag facts, pivoted to concepts
# --------------------------------------------------------------------------

def latest_concepts(t, concepts: dict[str, list[str]], sub_cols: Sequence[str] = (),
                    positive: bool = False, not_null: bool = False,
                    sub_where=None, group_sub_cols: Sequence[str] = (),
                    carry_sub_cols: Sequence[str] = ()) -> DataFrame:
    """Latest-filed value per (cik, fy, tag) of the concept tags, pivoted to
    one row per (cik, fy[, group_sub_cols]) with one column per concept."""
    tags = [tg for tags in concepts.values() for tg in tags]
    cols = ["cik", *sub_cols]
    facts = filing_facts(t.sub, t.num, ANNUAL_FORMS, list(dict.fromkeys(tags)), sub_cols=cols,
                         sub_where=sub_where, positive=positive, not_null=not_null)
    latest = latest_value(facts, ["cik", "fy", "tag"])
    carry = {c: F.max(c) for c in carry_sub_cols}
    return pivot_concepts(latest, ["cik", "fy", *group_sub_cols], concepts, carry=carry)


def margin_compression(t, year: int = 2024, min_revenue: float = 1e9, limit: int = 20) -> DataFrame:
    """Largest gross-margin declines versus the previous available year."""
    concepts = {"revenue": CONCEPTS["revenue"], "cogs": CONCEPTS["cogs"]}
    p = latest_concepts(t, concepts, sub_cols=("name",), positive=True, carry_sub_cols=("name",))
    m = (p.where(F.col("revenue").isNotNull() & F.col("cogs").isNotNull())
         .withColumn("gross_margin", safe_ratio(F.col("revenue") - F.col("cogs"), F.col("revenue"))))
    m = prior_value(m, "cik", "fy", "gross_margin", "prior_margin")
    m = (m.where((F.col("fy") == year) & F.col("prior_margin").isNotNull()
                 & (F.col("revenue") > F.lit(min_revenue)))
         .select("cik", "name", F.col("fy").alias("fiscal_year"), "revenue", "gross_margin",
                 "prior_margin", (F.col("gross_margin") - F.col("prior_margin")).alias("margin_change_pp")))
    return top_k(m, [F.asc("margin_change_pp"), F.asc("cik")], limit)


def etr_dispersion(t, fy: int = 2024, min_pretax: float = 1e6, min_firms: int = 10,
                   rate_range: tuple[float, float] = (-1.0, 1.0), limit: int = 20) -> DataFrame:
    """Effective tax rate quartiles and IQR per (sic, year)."""
    concepts = {"pretax_income": CONCEPTS["pretax_income"], "tax_expense": CONCEPTS["income_tax"]}
    p = latest_concepts(t, concepts, sub_cols=("sic",), sub_where=F.col("sic").isNotNull(),
                        group_sub_cols=("sic",))
    etr = (p.where((F.col("pretax_income") > F.lit(min_pretax)) & F.col("tax_expense").isNotNull())
           .select("cik", "sic", "fy",
                   safe_ratio("tax_expense", "pretax_income").alias("effective_rate"))
           .where((F.col("fy") == fy) & F.col("effective_rate").between(*rate_range)))
    q = percentiles(etr, ["sic", "fy"], "effective_rate", [0.25, 0.5, 0.75],
                    ["p25_etr", "median_etr", "p75_etr"], count_name="firms")
    q = (q.where(F.col("firms") >= min_firms)
         .select("sic", "fy", "firms", F.round("p25_etr", 6).alias("p25_etr"),
                 F.round("median_etr", 6).alias("median_etr"),
                 F.round("p75_etr", 6).alias("p75_etr"),
                 F.round(F.col("p75_etr") - F.col("p25_etr"), 6).alias("iqr"),
                 (F.col("p75_etr") - F.col("p25_etr")).alias("_iqr")))
    return top_k(q, [F.desc("_iqr"), F.asc("sic")], limit).drop("_iqr")


def cash_conversion(t, min_net_income: float = 5e7, ratio_range: tuple[float, float] = (0.0, 5.0),
                    min_years: int = 4, limit: int = 25) -> DataFrame:
    """Operating cash flow / net income over the years, per company."""
    concepts = {"cfo": CONCEPTS["cfo"], "net_income": CONCEPTS["net_income"]}
    p = latest_concepts(t, concepts, sub_cols=("name",), carry_sub_cols=("name",))
    r = (p.where(F.col("cfo").isNotNull() & F.col("net_income").isNotNull()
                 & (F.col("net_income") > F.lit(min_net_income)))
         .withColumn("cash_conversion", safe_ratio("cfo", "net_income"))
         .where(F.col("cash_conversion").between(*ratio_range)))
    g = (r.groupBy("cik").agg(
        F.max("name").alias("name"), F.count(F.lit(1)).alias("years_with_data"),
        F.avg("cash_conversion").alias("_avg"),
        F.min("cash_conversion").alias("_min"), F.max("cash_conversion").alias("_max"))
        .where(F.col("years_with_data") >= min_years))
    g = g.select("cik", "name", "years_with_data",
                 to_decimal(F.round("_avg", 9), 10, 3).alias("avg_conversion"),
                 to_decimal("_min", 10, 3).alias("min_conversion"),
                 to_decimal("_max", 10, 3).alias("max_conversion"))
    # ordered by the rounded output value, as published
    return top_k(g, [F.desc("avg_conversion"), F.asc("cik")], limit)


def income_statement_wide(t, ciks: Sequence[int] = MEGACAP_CIKS_WITH_BRK, fy: int = 2024) -> DataFrame:
    """Seven income-statement concepts side by side for selected companies."""
    names = ["revenue", "cogs", "gross_profit", "rd", "sga", "op_income", "net_income"]
    concepts = {n: CONCEPTS[n] for n in names}
    p = latest_concepts(t, concepts, sub_cols=("name",), not_null=True,
                        sub_where=F.col("cik").isin(list(ciks)), carry_sub_cols=("name",))
    p = p.where(F.col("fy") == fy)
    return (p.select("name", "fy", *[to_decimal(n, 28, 0).alias(n) for n in names])
            .orderBy(F.desc_nulls_first("revenue"), "name"))


def fcf_margin(t, fy: int = 2024, min_revenue: float = 1e10, limit: int = 25) -> DataFrame:
    """Free cash flow (CFO - capex) and its margin on revenue."""
    concepts = {"revenue": CONCEPTS["revenue"], "cfo": CONCEPTS["cfo"], "capex": CONCEPTS["capex"]}
    p = latest_concepts(t, concepts, sub_cols=("name", "sic"), carry_sub_cols=("name", "sic"))
    p = p.where((F.col("fy") == fy) & (F.col("revenue") > F.lit(min_revenue))
                & F.col("cfo").isNotNull() & F.col("capex").isNotNull())
    fcf = F.col("cfo") - F.col("capex")
    out = p.select("cik", "name", "sic", "fy",
                   to_decimal("revenue", 28, 0).alias("revenue"),
                   to_decimal("cfo", 28, 0).alias("cfo"),
                   to_decimal("capex", 28, 0).alias("capex"),
                   to_decimal(fcf, 28, 0).alias("fcf"),
                   to_decimal(safe_ratio(fcf, F.col("revenue")), 10, 4).alias("fcf_margin"))
    # ordered by the rounded output value, as published
    return top_k(out, [F.desc_nulls_last("fcf_margin"), F.asc("cik")], limit)
