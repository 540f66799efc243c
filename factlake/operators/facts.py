"""Fact selection: the consolidated-annual filter and the filing ⋈ fact join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions import fiscal_year


def consolidated_annual(num: DataFrame, qtrs: int = 4, uom: str = "USD",
                        segments: str = "", coreg: str = "",
                        tags: Sequence[str] | None = None,
                        positive: bool = False, not_null: bool = False) -> DataFrame:
    """Facts that are annual flows (``qtrs``) in ``uom`` for the consolidated
    main entity (empty ``segments`` / ``coreg`` sentinels).

    ``positive`` adds ``value > 0`` (which also drops NULL values);
    ``not_null`` adds ``value IS NOT NULL``. All predicates are plain column
    comparisons so they reach the Parquet scan as pushed filters.
    """
    cond = ((F.col("qtrs") == qtrs) & (F.col("uom") == uom)
            & (F.col("segments") == segments) & (F.col("coreg") == coreg))
    if tags is not None:
        cond = F.col("tag").isin(list(tags)) & cond
    if positive:
        cond = cond & (F.col("value") > 0)
    if not_null:
        cond = cond & F.col("value").isNotNull()
    return num.where(cond)


def filing_facts(sub: DataFrame, num: DataFrame, forms: Sequence[str],
                 tags: Sequence[str], sub_cols: Sequence[str] = ("cik",),
                 fact_cols: Sequence[str] = ("tag", "value"),
                 sub_where: Column | None = None, **consolidated) -> DataFrame:
    """Consolidated annual facts of the given tags joined to their filing.

    Adds ``fy = year(ddate)`` as a real column *before* any window so that
    later predicates on ``fy`` can be pushed below windows keyed by it.

    The filing side is projected to the few columns needed; whether it is
    broadcast is left to the planner's size check (static estimate, then
    AQE's measured size), with a sort-merge join beyond the threshold.
    """
    facts = consolidated_annual(num, tags=tags, **consolidated)
    need = ["adsh", "ddate", "version", *fact_cols]
    facts = facts.select(*dict.fromkeys(need)).withColumn("fy", fiscal_year("ddate"))
    filings = sub.where(F.col("form").isin(list(forms)))
    if sub_where is not None:
        filings = filings.where(sub_where)
    filings = filings.select(*dict.fromkeys(["adsh", "filed", *sub_cols]))
    return facts.join(filings, "adsh")
