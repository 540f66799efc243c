"""Group statistics: exact percentiles, shares of a total, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.session import ensure_checkpoint_dir

# --------------------------------------------------------------------------
# Exact PERCENTILE_CONT without gathering a group into one task.
# --------------------------------------------------------------------------
# Sorting a whole group (or buffering all its distinct values, as the built-in
# exact ``percentile`` does on its final merge) puts an unbounded group into
# one task. Instead the rows are counted per (group, value), with map-side
# combining, and that table is written once; order statistics are found in it by
# two bounded levels of buckets:
#   1. a fixed, monotone bucketing of the value (binary exponent + 12 mantissa
#      bits: relative width 1/4096); the cumulative count over a group's buckets
#      locates the bucket that holds each wanted rank;
#   2. inside it, buckets of relative width 2^-32; the cumulative count over
#      these locates the few values that are walked.
# Windows only ever see one group's populated buckets, one bucket's populated
# finer ones, or one finer bucket's distinct values. There is one path for all
# sizes, and no forced broadcast.

_MANT_BITS = 12
_SHIFT = 1 << 14          # room for the mantissa slot (0 .. 8192)
_EXP_OFF = 2048           # exponent offset to keep slots non-negative
_CLASS = 1 << 40          # sign class multiplier


def _magnitude_slot(u: Column) -> Column:
    """Monotone non-decreasing integer slot of a positive double."""
    e = F.floor(F.log2(u))
    m = F.when(e.between(-1000, 1000),
               F.floor(u * F.pow(F.lit(2.0), -e) * F.lit(float(1 << _MANT_BITS))))
    return (e + _EXP_OFF) * _SHIFT + F.coalesce(m, F.lit(0))


def value_bucket(v: Column) -> Column:
    """Order-preserving bucket id (long) of a double: -Infinity, negatives, zero,
    positives, Infinity, NaN."""
    inf = F.lit(float("inf"))
    slot = _magnitude_slot(F.abs(v))
    return (F.when(F.isnan(v), F.lit(5 * _CLASS)).when(v == inf, F.lit(4 * _CLASS + _CLASS - 1)).when(v == -inf, F.lit(0))
            .when(v > 0, 3 * _CLASS + slot).when(v == 0, F.lit(2 * _CLASS))
            .otherwise(_CLASS + (_CLASS - 1 - slot))).cast("long")


def fine_bucket(v: Column) -> Column:
    """Second-level key inside a ``value_bucket``: the mantissa scaled to 32
    bits (relative width 2^-32), order-preserving within one bucket."""
    u = F.abs(v)
    plain = ~F.isnan(v) & (u < F.lit(float("inf"))) & (v != 0)
    e = F.floor(F.log2(u))
    f = F.when(plain, F.coalesce(F.when(e.between(-1000, 1000), F.floor(
        u * F.pow(F.lit(2.0), -e) * F.lit(float(1 << 32)))), F.lit(0))).otherwise(F.lit(0))
    return F.when(v < 0, -f).otherwise(f).cast("long")


_TARGET = ["_i", "_side", "_r", "_below", "_pos", "_n"]


def _rows_of_targets(base: DataFrame, want: DataFrame, group, keys) -> DataFrame:
    """Rows of ``base`` in each target's bucket (NULL is a group of its own,
    as in GROUP BY, so the group is joined null-safely)."""
    b, w = base.alias("b"), want.alias("w")
    cond = ([F.col(f"b.{c}").eqNullSafe(F.col(f"w.{c}")) for c in group]
            + [F.col(f"b.{k}") == F.col(f"w.{k}") for k in keys])
    return b.join(w, cond).select(*[F.col(f"b.{c}") for c in base.columns], *[F.col(f"w.{c}") for c in _TARGET])


#: Targets (ranks of groups) that are broadcast; more of them meet their rows in a shuffle.
BROADCAST_TARGETS = 100_000


def _targeted(want: DataFrame) -> DataFrame:
    """Targets as a table of known size, broadcast if it is small: their rows are then found
    where they are."""
    want = want.checkpoint()
    return F.broadcast(want) if want.count() <= BROADCAST_TARGETS else want


def _located(counts: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The rows of ``counts`` (by, key, _c, targets with ranks below which
    ``_below`` lie) that hold their target's rank."""
    cum = F.col("_below") + F.sum("_c").over(
        Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    held = counts.withColumn("_cum", cum).where((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
    return held.withColumn("_below", F.col("_cum") - F.col("_c")).drop("_cum")


def percentiles(df: DataFrame, group: Sequence[str], value: str | Column,
                probs: Sequence[float], names: Sequence[str],
                count_name: str | None = None, sum_name: str | None = None) -> DataFrame:
    """Exact ``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY value)`` per group.

    Linear interpolation between the order statistics ``floor(p*(n-1))`` and
    ``ceil(p*(n-1))`` (0-based), computed in double; NULL values are ignored, NaN
    is larger than Infinity. Returns ``group`` + ``names`` (+ ``count_name``: n,
    ``sum_name``: the sum of the values in their own type). Groups whose values
    are all NULL are absent.

    No value is shuffled but those next to a wanted rank: the rows (group and value only) are cut by
    a reliable ``checkpoint()``, without a shuffle; a first histogram of them, combined in each task,
    brackets every rank; a second one is taken inside the brackets, and only values inside
    its buckets are counted one by one. A task gives a row per group and bucket, whatever the number of
    distinct values.
    """
    group = list(group)
    v = F.col(value) if isinstance(value, str) else value
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.select(*group, v.alias("_x")).where(F.col("_x").isNotNull()).checkpoint()
    base = cut.withColumn("_v", F.col("_x").cast("double"))
    base = base.withColumn("_b", value_bucket(F.col("_v"))).withColumn("_b2", fine_bucket(F.col("_v"))).withColumn("_c", F.lit(1).cast("long"))

    # the bucket of each wanted rank: lo/hi order statistic of every probability
    hist = base.groupBy(*group, "_b").agg(F.sum("_c").alias("_c"))
    hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    hist = hist.select(*group, "_b", "_c", "_n", F.lit(0).cast("long").alias("_below"), F.explode(F.array(*_targets(probs))).alias("_t"))
    side = [*group, "_i", "_side"]
    want = _targeted(_located(hist.select(*group, "_b", "_c", "_n", "_below", "_t.*"), side, "_b").select(*group, "_b", *_TARGET))
    rows = _rows_of_targets(base.select(*group, "_b", "_b2", "_v", "_c"), want, group, ["_b"])
    # the finer bucket inside it
    fine = rows.groupBy(*group, "_b2", *_TARGET).agg(F.sum("_c").alias("_c"))
    inner = _targeted(_located(fine, side, "_b2").select(*group, "_b2", "_i", "_side", F.col("_below").alias("_low")))
    r, i = rows.alias("r"), inner.alias("i")
    near = r.join(i, [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in group]
                  + [F.col(f"r.{k}") == F.col(f"i.{k}") for k in ("_b2", "_i", "_side")])
    near = near.select(*[F.col(f"r.{c}") for c in (*group, "_v", "_c", "_i", "_side", "_r", "_pos", "_n")], F.col("i._low").alias("_below"))
    kept = [c for c in near.columns if c != "_c"]
    near = near.groupBy(*kept).agg(F.sum("_c").alias("_c"))
    out = _assemble(_located(near, side, "_v"), group, probs, names, count_name)
    if sum_name:
        totals = cut.groupBy(*group).agg(F.sum("_x").alias(sum_name))
        o, t = out.alias("o"), totals.alias("t")
        out = o.join(t, [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]).select("o.*", f"t.{sum_name}")
    return out


def _targets(probs: Sequence[float]) -> list[Column]:
    """lo/hi order statistic (0-based rank) of every probability, given ``_n``."""
    out = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        out.append(F.struct(F.lit(i).alias("_i"), F.lit("lo").alias("_side"),
                            F.floor(pos).cast("long").alias("_r"), pos.alias("_pos")))
        out.append(F.struct(F.lit(i).alias("_i"), F.lit("hi").alias("_side"),
                            F.ceil(pos).cast("long").alias("_r"), pos.alias("_pos")))
    return out


def _assemble(picked: DataFrame, group, probs, names, count_name, extra=()) -> DataFrame:
    """From one row per (group, prob, side) holding the order statistic
    ``_v``: one grouped pass, then linear interpolation as a projection."""
    def pick(i, side):
        return F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col("_v")))

    aggs = [F.max("_n").alias("_n"), *[F.max(c).alias(c) for c in extra]]
    for i in range(len(probs)):
        aggs += [pick(i, "lo").alias(f"_lo{i}"), pick(i, "hi").alias(f"_hi{i}"),
                 F.max(F.when(F.col("_i") == i, F.col("_pos"))).alias(f"_pos{i}")]
    per_group = picked.groupBy(*group).agg(*aggs)
    cols = []
    for i, name in enumerate(names):
        lo, hi, pos = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_pos{i}")
        frac = pos - F.floor(pos)
        cols.append(F.when((frac == 0) | (lo == hi), lo).otherwise(lo + frac * (hi - lo)).alias(name))
    if count_name:
        cols.append(F.col("_n").alias(count_name))
    return per_group.select(*group, *cols, *extra)


def percentiles_small_domain(df: DataFrame, group: Sequence[str], value: str | Column,
                             probs: Sequence[float], names: Sequence[str],
                             count_name: str | None = None,
                             count_if: dict[str, Column] | None = None) -> DataFrame:
    """Exact ``PERCENTILE_CONT`` for a value with a small, bounded domain
    (e.g. day counts already restricted to 1..365): rows are counted per
    distinct value (partial aggregation), and the cumulative walk per group
    sees at most one row per domain value. Same semantics as
    ``percentiles``; no materialisation step. ``count_if``: further counts per
    group, of the rows whose value ``_v`` meets a condition."""
    group = list(group)
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*group, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")))
    wcum = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    extra = {n: F.sum(F.when(c, F.col("_c")).otherwise(0)).over(whole) for n, c in (count_if or {}).items()}
    counts = counts.withColumns({"_cum": F.sum("_c").over(wcum), "_n": F.sum("_c").over(whole), **extra})
    picked = (counts.select(*group, "_v", "_c", "_cum", "_n", *extra,
                            F.explode(F.array(*_targets(probs))).alias("_t"))
              .select(*group, "_v", "_n", "_c", "_cum", *extra, "_t.*")
              .where((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum"))))
    return _assemble(picked, group, probs, names, count_name, list(extra))


# --------------------------------------------------------------------------
# Shares, concentration
# --------------------------------------------------------------------------

def group_totals(df: DataFrame, group: Sequence[str], value: str,
                 total: str = "total", count: str = "members") -> DataFrame:
    """Total and member count per group (partial aggregation, no window)."""
    return df.groupBy(*group).agg(F.sum(value).alias(total), F.count(F.lit(1)).alias(count))


def share_of_total(df: DataFrame, group: Sequence[str], value: str,
                   min_members: int = 1, out: str = "share",
                   total: str = "total", count: str = "members") -> DataFrame:
    """Each row's share of its group total: detail joined to its own
    aggregate (the aggregate is small: one row per group). Groups with fewer
    than ``min_members`` rows or a non-positive total are dropped."""
    totals = (group_totals(df, group, value, total, count)
              .where((F.col(count) >= min_members) & (F.col(total) > 0)))
    return (df.join(totals, list(group))
            .withColumn(out, F.col(value).cast("double") / F.col(total).cast("double")))


def hhi(df: DataFrame, group: Sequence[str], value: str, min_members: int = 5,
        high: float = 2500.0, moderate: float = 1500.0) -> DataFrame:
    """Herfindahl-Hirschman index per group on the 0-10000 scale.

    ``sum((100 * v / T)^2) = 10000 * sum(v^2) / T^2``, so one partially
    aggregated pass (sum, sum of squares, count) gives it: no join of the
    detail to its total and no window over a (possibly huge) group.
    Returns group, members, total, hhi (double, unrounded), label.
    """
    vd = F.col(value).cast("double")
    g = (df.groupBy(*group)
         .agg(F.count(F.lit(1)).alias("members"), F.sum(value).alias("total"),
              F.sum(vd * vd).alias("_sq"))
         .where((F.col("members") >= min_members) & (F.col("total") > 0)))
    t = F.col("total").cast("double")
    h = F.lit(10000.0) * F.col("_sq") / (t * t)
    label = (F.when(h > high, "highly concentrated")
             .when(h > moderate, "moderately concentrated").otherwise("competitive"))
    return g.select(*group, "members", "total", h.alias("hhi"), label.alias("label"))


def topn_share(df: DataFrame, group: Sequence[str], value: str, k: int = 5) -> DataFrame:
    """Per group: member count, total, sum of the top-``k`` values by RANK
    (ties included), and top share. The total is a plain aggregate; the top
    values come from a rank filter that is limited map-side; both are one
    row per group and joined on the group."""
    totals = group_totals(df, group, value, "total", "members")
    w = Window.partitionBy(*group).orderBy(F.col(value).desc())
    top = (df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= k)
           .groupBy(*group).agg(F.sum(value).alias("top_total")))
    out = totals.join(top, list(group), "left")
    return out.withColumn(
        "top_share",
        F.coalesce(F.col("top_total"), F.lit(0)).cast("double")
        / F.when(F.col("total") != 0, F.col("total").cast("double")))
