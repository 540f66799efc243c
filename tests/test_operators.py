"""Operator semantics on small hand-made inputs (edge cases of SURVEY §5)."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.functions import safe_ratio
from factlake.operators.dedup import latest_value
from factlake.operators.joins import amendment_pairs, missing_concept, orphans
from factlake.operators.pivot import pivot_concepts
from factlake.operators.ranking import rank_topn, topk_per_row
from factlake.operators.series import growth, rolling
from factlake.operators.stats import hhi, percentiles, topn_share

D = dt.date


def _facts(spark, rows):
    cols = "cik long, adsh string, filed date, fy int, tag string, ddate date, version string, value decimal(28,4)"
    return spark.createDataFrame(rows, cols)


def test_latest_value_latest_filing_and_tie_break(spark):
    rows = [
        (1, "a1", D(2024, 2, 1), 2023, "Revenues", D(2023, 12, 31), "v1", Decimal(10)),
        (1, "a2", D(2024, 5, 1), 2023, "Revenues", D(2023, 12, 31), "v1", Decimal(20)),  # later filing
        (1, "a2", D(2024, 5, 1), 2023, "RevenueFromContract", D(2023, 12, 31), "v1", Decimal(30)),
        (2, "b1", D(2024, 2, 1), 2023, "Revenues", D(2023, 12, 31), "v1", Decimal(5)),
        (2, "b0", D(2024, 2, 1), 2023, "Revenues", D(2023, 12, 31), "v1", Decimal(6)),  # adsh desc
    ]
    out = {r["cik"]: r["value"] for r in latest_value(_facts(spark, rows), ["cik", "fy"]).collect()}
    # same filing, two tags: tag ASC decides ("RevenueFromContract" < "Revenues")
    assert out == {1: Decimal(30), 2: Decimal(5)}


def test_latest_value_is_one_row_per_key(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 5), f"a{rng.randint(1, 30)}", D(2020, 1, 1) + dt.timedelta(rng.randint(0, 5)),
             rng.randint(2019, 2021), rng.choice(["T1", "T2"]), D(2020, 12, 31), "v",
             Decimal(rng.randint(1, 9))) for _ in range(300)]
    out = latest_value(_facts(spark, rows), ["cik", "fy"])
    assert out.count() == out.select("cik", "fy").distinct().count()


def test_growth_uses_previous_available_year_and_nullif(spark):
    df = spark.createDataFrame([(1, 2020, Decimal(100)), (1, 2022, Decimal(150)),
                                (2, 2020, Decimal(0)), (2, 2021, Decimal(5))],
                               "cik long, fy int, revenue decimal(28,4)")
    g = {(r["cik"], r["fy"]): (r["prior"], r["growth"])
         for r in growth(df, "cik", "fy", "revenue").collect()}
    assert g[(1, 2022)] == (Decimal(100), 0.5)     # gap year: lag is 2020
    assert g[(1, 2020)] == (None, None)
    assert g[(2, 2021)] == (Decimal(0), None)      # divide by zero -> NULL, no error


def test_rolling_keeps_partial_windows(spark):
    df = spark.createDataFrame([(1, y, Decimal(y - 2000)) for y in (2001, 2002, 2003, 2005)],
                               "cik long, fy int, revenue decimal(28,4)")
    r = {x["fy"]: (x["rolling_sum"], x["rows_in_window"])
         for x in rolling(df, "cik", "fy", "revenue", 3).collect()}
    assert r[2001] == (Decimal(1), 1)
    assert r[2002] == (Decimal(3), 2)
    assert r[2003] == (Decimal(6), 3)
    assert r[2005] == (Decimal(10), 3)   # rows, not calendar years


def test_rank_topn_keeps_ties(spark):
    vals = [100, 90, 80, 70, 60, 60, 50]
    df = spark.createDataFrame([(1, i, Decimal(v)) for i, v in enumerate(vals)],
                               "sic int, cik long, revenue decimal(28,4)")
    out = rank_topn(df, ["sic"], [F.desc("revenue")], 5, out="rk")
    assert sorted(r["rk"] for r in out.collect()) == [1, 2, 3, 4, 5, 5]


def test_pivot_synonyms_use_max_not_sum(spark):
    df = spark.createDataFrame(
        [(1, 2023, "Revenues", Decimal(10)), (1, 2023, "RevenueFromContract", Decimal(12)),
         (1, 2023, "CostOfRevenue", Decimal(4))],
        "cik long, fy int, tag string, value decimal(28,4)")
    p = pivot_concepts(df, ["cik", "fy"], {"revenue": ["Revenues", "RevenueFromContract"],
                                           "cogs": ["CostOfRevenue"], "rd": ["RD"]}).first()
    assert (p["revenue"], p["cogs"], p["rd"]) == (Decimal(12), Decimal(4), None)


def test_safe_ratio_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(0)), (Decimal(1), Decimal(4))],
                               "a decimal(28,4), b decimal(28,4)")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [None, 0.25]


def _pct_ref(values, p):
    v = np.sort(np.array(values, dtype=float))
    pos = (len(v) - 1) * p
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    return v[lo] + (pos - lo) * (v[hi] - v[lo])


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_exact_against_reference(spark, seed):
    rng = random.Random(seed)
    rows = []
    groups = {}
    for g in range(6):
        n = [1, 2, 7, 50, 400, 1500][g]
        for _ in range(n):
            choice = rng.random()
            if choice < 0.2:
                v = 0.0
            elif choice < 0.4:
                v = float(rng.randint(-3, 3))        # heavy ties
            else:
                v = rng.lognormvariate(10, 4) * rng.choice([-1, 1])
            rows.append((g, v))
            groups.setdefault(g, []).append(v)
    rows.append((0, None))
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    names = ["p0", "p25", "p50", "p95", "p100"]
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", probs, names, count_name="n").collect()}
    for g, vals in groups.items():
        assert got[g]["n"] == len(vals)
        for p, nm in zip(probs, names):
            assert got[g][nm] == pytest.approx(_pct_ref(vals, p), rel=1e-12, abs=1e-12), (g, p)


def test_percentiles_one_dominant_value(spark):
    # a third of all rows share one value: still exact
    vals = [7.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(1, v) for v in vals], "g int, v double")
    got = percentiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).first()
    for p, nm in ((0.1, "a"), (0.5, "b"), (0.9, "c")):
        assert got[nm] == pytest.approx(_pct_ref(vals, p))


def _brute_pairs(orig, amend, lo, hi, k):
    pairs = []
    for (c, p, ao, fo, name) in orig:
        for (c2, p2, aa, fa) in amend:
            d = (fa - fo).days
            if c == c2 and p == p2 and fa > fo and lo <= d <= hi:
                pairs.append((d, c, p, ao, aa))
    pairs.sort(key=lambda x: (-x[0], x[1], x[2], x[3], x[4]))
    return pairs[:k]


@pytest.mark.parametrize("k", [1, 5, 25])
def test_amendment_pairs_topk_matches_brute_force(spark, k):
    rng = random.Random(k)
    base = D(2020, 1, 1)
    orig, amend = [], []
    for i in range(400):
        c = 1 if rng.random() < 0.35 else rng.randint(2, 6)   # one hot company
        p = D(2019, 12, 31) if rng.random() < 0.6 else D(2020, 12, 31)
        f = base + dt.timedelta(days=rng.randint(0, 60))       # many equal dates
        if rng.random() < 0.5:
            orig.append((c, p, f"o{i:04d}", f, f"N{c}"))
        else:
            amend.append((c, p, f"a{i:04d}", f))
    o = spark.createDataFrame(orig, "cik long, period date, adsh_original string, filed_original date, name string")
    a = spark.createDataFrame(amend, "cik long, period date, adsh_amended string, filed_amended date")
    got = [(r["days_between"], r["cik"], r["period"], r["adsh_original"], r["adsh_amended"])
           for r in amendment_pairs(o, a, ["cik", "period"], 1, 1095, k).collect()]
    assert got == _brute_pairs(orig, amend, 1, 1095, k)


def test_missing_concept_and_orphans(spark):
    filings = spark.createDataFrame([("a",), ("b",), ("c",)], "adsh string")
    facts = spark.createDataFrame([("a",), ("a",), ("d",)], "adsh string")
    assert sorted(r[0] for r in missing_concept(filings, facts).collect()) == ["b", "c"]
    assert [r[0] for r in orphans(facts, filings).collect()] == ["d"]


def test_topk_per_row_limits_each_outer_row(spark):
    outer = spark.createDataFrame([("f1", D(2023, 12, 31)), ("f2", D(2023, 12, 31))],
                                  "adsh string, ddate date")
    inner = spark.createDataFrame(
        [("f1", D(2023, 12, 31), f"t{i}", Decimal(i)) for i in range(5)]
        + [("f1", D(2022, 12, 31), "old", Decimal(99)), ("f2", D(2023, 12, 31), "x", Decimal(1))],
        "adsh string, ddate date, tag string, value decimal(28,4)")
    out = topk_per_row(outer, inner, ["adsh", "ddate"], ["adsh"], [F.desc("value"), F.asc("tag")], 3)
    got = sorted((r["adsh"], r["tag"]) for r in out.collect())
    assert got == [("f1", "t2"), ("f1", "t3"), ("f1", "t4"), ("f2", "x")]


def test_hhi_and_top_share(spark):
    revs = [50, 30, 10, 5, 5]
    df = spark.createDataFrame([(1, i, Decimal(v)) for i, v in enumerate(revs)],
                               "sic int, cik long, revenue decimal(28,4)")
    h = hhi(df, ["sic"], "revenue", 5).first()
    assert h["hhi"] == pytest.approx(sum((100 * v / 100) ** 2 for v in revs))
    assert h["label"] == "highly concentrated"
    s = topn_share(df, ["sic"], "revenue", 2).first()
    assert s["top_share"] == pytest.approx(0.8)
    assert hhi(df, ["sic"], "revenue", 6).count() == 0   # too few members


def test_percentiles_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in percentiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_revenue_distribution_options(spark):
    from factlake.plans.analytics import revenue_distribution
    from factlake.sources.fixtures import fixture_tables

    t = fixture_tables(spark, "/root/testdata/sf0.001")
    by_year = revenue_distribution(t, by_version=False).collect()
    assert by_year and all(r["taxonomy_version"] is None for r in by_year)
    per_version = revenue_distribution(t).collect()
    assert sum(r["filings_reporting"] for r in by_year) == sum(
        r["filings_reporting"] for r in per_version)
    deduped = revenue_distribution(t, dedup=True, by_version=False).collect()
    assert sum(r["filings_reporting"] for r in deduped) <= sum(
        r["filings_reporting"] for r in by_year)


def test_percentiles_two_level_refinement_is_exact(spark):
    rng = random.Random(7)
    vals = {g: [rng.choice([1.0, 1.0 + 1e-6, -2.5]) * rng.uniform(1000, 1000.01) for _ in range(700)]
            for g in ("x", "y")}
    vals["y"] += [0.0] * 50 + [float(i) for i in range(-20, 20)]
    rows = [(g, v) for g, vs in vals.items() for v in vs] + [(None, 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    names = ["a", "b", "c", "d", "e"]
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", probs, names).collect()}
    vals[None] = [3.0, 1.0]
    for g, vs in vals.items():
        for p, nm in zip(probs, names):
            assert got[g][nm] == pytest.approx(_pct_ref(vs, p), rel=1e-12, abs=1e-12), (g, p)


def test_percentiles_small_domain_matches_general(spark):
    from factlake.operators.stats import percentiles_small_domain

    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.randint(1, 365)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, d int")
    probs, names = [0.0, 0.25, 0.5, 0.95, 1.0], ["a", "b", "c", "d", "e"]
    got = {r["g"]: r for r in percentiles_small_domain(df, ["g"], "d", probs, names, "n").collect()}
    for g in ("a", "b", None):
        vals = [d for gg, d in rows if gg == g]
        assert got[g]["n"] == len(vals)
        for p, nm in zip(probs, names):
            assert got[g][nm] == pytest.approx(_pct_ref(vals, p), rel=1e-12, abs=1e-12)


def test_percentiles_order_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (5.0, 6.0, nan)] + [("b", v) for v in (-inf, -1.0, 2.0, inf, inf)]
                               + [("c", nan)], "g string, v double")
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", [0.0, 0.5, 1.0], ["lo", "mid", "hi"], "n", "s").collect()}
    assert (got["a"]["lo"], got["a"]["mid"]) == (5.0, 6.0) and got["a"]["hi"] != got["a"]["hi"]
    assert (got["b"]["lo"], got["b"]["mid"], got["b"]["hi"]) == (-inf, 2.0, inf)
    assert got["c"]["n"] == 1 and got["c"]["mid"] != got["c"]["mid"]


def test_concepts_are_the_stated_tags():
    """The tag lists by hand, not from the module under test."""
    from factlake.schema import CONCEPTS, EXPENSE_TAGS, SECTOR_SICS

    assert CONCEPTS["revenue"] == ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"]
    assert CONCEPTS["cogs"] == ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"]
    assert CONCEPTS["net_income"] == ["NetIncomeLoss", "ProfitLoss"]
    assert CONCEPTS["capex"] == ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]
    assert CONCEPTS["income_tax"] == ["IncomeTaxExpenseBenefit"]
    assert len(EXPENSE_TAGS) == 11 and SECTOR_SICS == [2834, 7372, 6022, 7370, 1311]


def test_percentiles_shuffle_no_row_per_distinct_value(spark, monkeypatch):
    """20,000 distinct values: what is aggregated by value is next to a wanted rank; also where
    the targets are too many to broadcast."""
    import numpy as np
    from pyspark.sql import functions as F

    from factlake.operators import stats

    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), (F.col("id") * 17.25 % 99_991 - 500).alias("v"))
    want = {g: np.percentile([r.v for r in df.where(F.col("g").eqNullSafe(F.lit(g))).collect()], [1, 50, 99]) for g in ("a", None)}
    seen = []
    located = stats._located
    monkeypatch.setattr(stats, "_located", lambda c, by, key: seen.append((key, c)) or located(c, by, key))
    for limit in (stats.BROADCAST_TARGETS, 0):
        monkeypatch.setattr(stats, "BROADCAST_TARGETS", limit)
        for r in stats.percentiles(df, ["g"], "v", [0.01, 0.5, 0.99], ["p1", "p50", "p99"]).collect():
            assert np.allclose([r.p1, r.p50, r.p99], want[r.g], rtol=0, atol=1e-9)
    assert all(c.count() < 200 for key, c in seen if key == "_v")
