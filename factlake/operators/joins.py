"""Anti-joins, orphan checks and the original/amendment pair search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import days_between


def missing_concept(filings: DataFrame, facts: DataFrame, key: str = "adsh") -> DataFrame:
    """Filings with no matching fact (``NOT EXISTS``).

    The fact side is reduced to its distinct keys first: partial aggregation
    removes a hot key's duplicates map-side, so the anti-join's build side is
    at most one row per filing.
    """
    keys = facts.select(key).distinct()
    return filings.join(keys, key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str | Sequence[str] = "adsh") -> DataFrame:
    """Child rows without a parent row (``LEFT JOIN ... WHERE p.key IS NULL``)."""
    keys = [key] if isinstance(key, str) else list(key)
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def amendment_pairs(originals: DataFrame, amendments: DataFrame,
                    on: Sequence[str] = ("cik", "period"),
                    min_days: int = 1, max_days: int = 1095, k: int = 25) -> DataFrame:
    """Top-``k`` (original, amendment) filing pairs by days between them.

    Inputs: ``originals(on..., adsh_original, filed_original, <extra>)`` and
    ``amendments(on..., adsh_amended, filed_amended)``. A pair matches on
    ``on`` with ``filed_amended > filed_original`` and the gap in
    [``min_days``, ``max_days``]. Output order: days desc, ``on``, both accession numbers.

    All pairs inside one (cik, period) group are never materialised. Pairs
    are first counted per *filing date* pair (dates per group are bounded by
    the calendar, not by the number of filings); the best ``k`` (days, group)
    cells are chosen from those counts; only the ``k`` smallest filings per
    side of each chosen cell are expanded. That is exact for the requested
    order because every original in a cell has at least one partner there.
    """
    on = list(on)
    od = originals.groupBy(*on, "filed_original").agg(F.count(F.lit(1)).alias("_co"))
    ad = amendments.groupBy(*on, "filed_amended").agg(F.count(F.lit(1)).alias("_ca"))
    gap = days_between("filed_amended", "filed_original")
    date_pairs = (od.join(ad, on)
                  .withColumn("days_between", gap)
                  .where((F.col("filed_amended") > F.col("filed_original"))
                         & F.col("days_between").between(min_days, max_days)))
    cells = (date_pairs.groupBy("days_between", *on)
             .agg(F.sum(F.col("_co") * F.col("_ca")).alias("_pairs")))
    # At most k cells can contribute; keep those whose earlier cells hold < k pairs.
    first = cells.orderBy(F.col("days_between").desc(), *[F.col(c).asc() for c in on]).limit(k)
    wcum = (Window.orderBy(F.col("days_between").desc(), *[F.col(c).asc() for c in on])
            .rowsBetween(Window.unboundedPreceding, -1))
    chosen = (first.withColumn("_before", F.coalesce(F.sum("_pairs").over(wcum), F.lit(0)))
              .where(F.col("_before") < k).select("days_between", *on))
    # Size bounds for the broadcasts below: ``chosen`` has at most k rows; a
    # chosen cell fixes the gap, so its date pairs are at most the distinct
    # filing dates of one (cik, period) - a calendar bound, not a data one.
    cell_dates = date_pairs.join(F.broadcast(chosen), ["days_between", *on]).select(
        "days_between", *on, "filed_original", "filed_amended")

    o_keys = F.broadcast(cell_dates.select("days_between", *on, "filed_original").distinct())
    o_rows = originals.join(o_keys, [*on, "filed_original"])
    wo = Window.partitionBy("days_between", *on).orderBy("adsh_original")
    o_rows = o_rows.withColumn("_ro", F.row_number().over(wo)).where(F.col("_ro") <= k).drop("_ro")
    a_keys = F.broadcast(cell_dates.select(*on, "filed_amended").distinct())
    a_rows = amendments.join(a_keys, [*on, "filed_amended"])
    wa = Window.partitionBy(*on, "filed_amended").orderBy("adsh_amended")
    a_rows = a_rows.withColumn("_ra", F.row_number().over(wa)).where(F.col("_ra") <= k).drop("_ra")

    pairs = (o_rows.join(a_rows, on)
             .where(days_between("filed_amended", "filed_original") == F.col("days_between")))
    order = [F.col("days_between").desc(), *[F.col(c).asc() for c in (*on, "adsh_original", "adsh_amended")]]
    return pairs.orderBy(*order).limit(k)

