"""Ranking: top-N per group, top-k per outer row, global top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANKERS = {"rank": F.rank, "row_number": F.row_number, "dense_rank": F.dense_rank}


def rank_topn(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
              out: str = "rank", method: str = "rank") -> DataFrame:
    """Rows whose ``method`` rank within ``group`` is ``<= k``.

    With ``rank`` ties share a rank, so a group may return more than ``k``
    rows (the published semantics). The filter directly on the rank lets
    Catalyst add a partial ``WindowGroupLimit`` below the exchange, so each
    map task ships at most the top rows per group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, _RANKERS[method]().over(w)).where(F.col(out) <= k)


def topk_per_row(outer: DataFrame, inner: DataFrame, on: Sequence[str] | Column,
                 outer_key: Sequence[str], order: Sequence[Column], k: int,
                 out: str = "_k") -> DataFrame:
    """``CROSS JOIN LATERAL (SELECT ... WHERE <corr> ORDER BY ... LIMIT k)``.

    Written as an equi-join followed by ``row_number() <= k`` partitioned by
    the outer row's key. (A LATERAL subquery with LIMIT is not decorrelated
    safely, so the window form is the one used.) ``order`` must be total
    for the result to be deterministic.
    """
    joined = outer.join(inner, on)
    w = Window.partitionBy(*outer_key).orderBy(*order)
    return (joined.withColumn(out, F.row_number().over(w))
            .where(F.col(out) <= k).drop(out))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ORDER BY ... LIMIT k`` (planned as ``TakeOrderedAndProject``: each
    partition keeps its own top k, only k rows per partition move)."""
    return df.orderBy(*order).limit(k)
