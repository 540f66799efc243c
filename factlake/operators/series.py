"""Per-entity annual series: prior value, growth, rolling frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import safe_ratio


def prior_value(df: DataFrame, entity: str, time: str, value: str,
                out: str = "prior") -> DataFrame:
    """``LAG(value) OVER (PARTITION BY entity ORDER BY time)``: the previous
    *available* period, not necessarily ``time - 1``."""
    w = Window.partitionBy(entity).orderBy(time)
    return df.withColumn(out, F.lag(value).over(w))


def growth(df: DataFrame, entity: str, time: str, value: str,
           prior: str = "prior", out: str = "growth") -> DataFrame:
    """Prior value plus ``(value - prior) / NULLIF(prior, 0)`` in double."""
    df = prior_value(df, entity, time, value, prior)
    return df.withColumn(out, safe_ratio(F.col(value) - F.col(prior), F.col(prior)))


def rolling(df: DataFrame, entity: str, time: str, value: str, rows: int = 3,
            sum_out: str = "rolling_sum", count_out: str = "rows_in_window") -> DataFrame:
    """Trailing ``rows``-row sum and row count (``ROWS BETWEEN rows-1 PRECEDING
    AND CURRENT ROW``). Rows, not calendar years; partial windows are kept
    and recognisable by the count. Both frames share one Window node."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-(rows - 1), 0)
    return (df.withColumn(sum_out, F.sum(value).over(w))
            .withColumn(count_out, F.count(F.lit(1)).over(w)))
