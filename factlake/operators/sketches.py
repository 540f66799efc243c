"""Distinct counts that can be kept and merged.

An exact count of distinct values has to see every value again when a quarter is
added. A HyperLogLog sketch of each quarter is a few kilobytes, whatever its rows, and sketches of any set of
quarters merge into one of all their values. With
``lg_k`` = 14 the standard error is 0.8 % (1.04 / sqrt(2 ** 14)); ``ERROR_BOUND`` is three of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
ERROR_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """``by`` + a sketch of each column's distinct values (NULL is none of them): one partially
    aggregated pass, in which a task sends a sketch per group and no values."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns])


def merged_counts(sketches: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by`` + the estimated distinct values over all sketches of the group."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
