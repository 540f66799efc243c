"""Long -> wide pivot of concept synonyms by conditional aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_value(tags: Sequence[str], value: str = "value", tag: str = "tag") -> Column:
    """``MAX(value) FILTER (WHERE tag IN tags)``: MAX, not SUM, so a filer that
    reports a concept under two synonym tags is not double counted."""
    return F.max(F.when(F.col(tag).isin(list(tags)), F.col(value)))


def pivot_concepts(df: DataFrame, keys: Sequence[str], concepts: Mapping[str, Sequence[str]],
                   carry: Mapping[str, Column] | None = None,
                   value: str = "value", tag: str = "tag") -> DataFrame:
    """One row per ``keys`` with one column per concept.

    ``carry`` adds extra aggregates (e.g. ``{"name": F.max("name")}``).
    ``groupBy().pivot()`` cannot express synonyms (one tag per column), so
    this is a single hash aggregate with partial (map-side) aggregation.
    """
    aggs = [F.max(c).alias(n) if isinstance(c, str) else c.alias(n)
            for n, c in (carry or {}).items()]
    aggs += [concept_value(tags, value, tag).alias(name) for name, tags in concepts.items()]
    return df.groupBy(*keys).agg(*aggs)
