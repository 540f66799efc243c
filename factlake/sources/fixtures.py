"""Fixture views: the four filing tables derived from the driver's TPC-H-style
tables, once as Spark DataFrames and once as SQL text (CTEs) so an
independent engine can compute the same inputs.

Mapping (see FIXTURES.md §3): orders -> sub (one filing per order),
lineitem -> num and pre (one fact / presentation line per line item),
tag = distinct (tag, version) of num.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping: the 16 fact tags picked by
# l_partkey mod 16, in this order.
FIXTURE_TAGS = [
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "CostOfRevenue",
    "CostOfGoodsAndServicesSold",
    "GrossProfit",
    "ResearchAndDevelopmentExpense",
    "SellingGeneralAndAdministrativeExpense",
    "OperatingIncomeLoss",
    "NetIncomeLoss",
    "ProfitLoss",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
    "IncomeTaxExpenseBenefit",
    "NetCashProvidedByUsedInOperatingActivities",
    "PaymentsToAcquirePropertyPlantAndEquipment",
    "MarketingExpense",
    "CustomTag",
]
# sic by cik mod 10 (index 9 -> NULL).
FIXTURE_SICS = [2834, 7372, 6022, 7370, 1311, 6770, 5961, 4812, 4931, None]
FIXTURE_FORMS = {"F": "10-K", "P": "10-K/A", "O": "10-Q"}
FIXTURE_AFS = {"1-URGENT": "1-LAF", "2-HIGH": "2-ACC", "3-MEDIUM": "3-SRA",
               "4-NOT SPECIFIED": "4-NON"}


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _sql_case(col: str, mapping: dict, quote_key=True) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else str(v)
    parts = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {parts} END"


@dataclass
class FilingTables:
    sub: DataFrame
    num: DataFrame
    tag: DataFrame
    pre: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {"sub": self.sub, "num": self.num, "tag": self.tag, "pre": self.pre}


def fixture_sub(orders: DataFrame) -> DataFrame:
    filed = F.to_date("o_orderdate")
    cik = F.expr("o_custkey div 10")
    sic_map = {i: s for i, s in enumerate(FIXTURE_SICS) if s is not None}
    period = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("date")).otherwise(
        F.make_date(F.year(filed) - 1, F.lit(12), F.lit(31)))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("adsh"),
        cik.alias("cik"),
        F.concat(F.lit("Company "), cik.cast("string")).alias("name"),
        _case(cik % 10, sic_map).cast("int").alias("sic"),
        _case(F.col("o_orderpriority"), FIXTURE_AFS).alias("afs"),
        F.lit(0).cast("tinyint").alias("wksi"),
        _case(F.col("o_orderstatus"), FIXTURE_FORMS).alias("form"),
        period.alias("period"),
        F.year(period).cast("smallint").alias("fy"),
        F.lit("FY").alias("fp"),
        filed.alias("filed"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("accepted"),
        F.lit(0).cast("tinyint").alias("prevrpt"),
        F.lit(0).cast("tinyint").alias("detail"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".xml")).alias("instance"),
        F.lit(1).alias("nciks"),
        F.concat(F.year(filed).cast("string"), F.lit("q"),
                 F.quarter(filed).cast("string")).alias("quarter"),
    )


def _fixture_tag_col(partkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in FIXTURE_TAGS]),
                        (partkey % len(FIXTURE_TAGS) + 1).cast("int"))


def fixture_num(lineitem: DataFrame) -> DataFrame:
    sign = F.when(F.col("l_tax") == 0, F.lit(-1)).otherwise(F.lit(1))
    value = (sign * F.col("l_extendedprice").cast("decimal(12,2)")
             * F.lit(1000000)).cast("decimal(28,4)")
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("adsh"),
        _fixture_tag_col(F.col("l_partkey")).alias("tag"),
        F.concat(F.lit("us-gaap/"), (F.lit(2022) + F.col("l_suppkey") % 3).cast("string")).alias("version"),
        F.make_date(F.year("l_shipdate") - 1, F.lit(12), F.lit(31)).alias("ddate"),
        F.when(F.col("l_linenumber") == 7, F.lit(1)).otherwise(F.lit(4)).cast("smallint").alias("qtrs"),
        F.when(F.col("l_quantity") == 50, F.lit("shares")).otherwise(F.lit("USD")).alias("uom"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Seg="), F.col("l_linestatus")))
        .otherwise(F.lit("")).alias("segments"),
        F.lit("").alias("coreg"),
        value.alias("value"),
        F.lit(None).cast("string").alias("footnote"),
    )


def fixture_tag(num: DataFrame) -> DataFrame:
    pairs = num.select("tag", "version").distinct()
    return pairs.select(
        "tag", "version",
        F.when(F.col("tag") == "CustomTag", 1).otherwise(0).cast("tinyint").alias("custom"),
        F.when((F.col("tag") == "GrossProfit") & (F.col("version") == "us-gaap/2022"), 1)
        .otherwise(0).cast("tinyint").alias("abstract"),
        F.lit("monetary").alias("datatype"),
        F.lit("D").alias("iord"),
        F.lit(None).cast("string").alias("crdr"),
        F.concat(F.lit("Label "), F.col("tag")).alias("tlabel"),
        F.lit(None).cast("string").alias("doc"),
    )


def fixture_pre(lineitem: DataFrame) -> DataFrame:
    stmt = _case(F.col("l_returnflag"), {"A": "IS", "N": "BS", "R": "CF"})
    tag = _fixture_tag_col(F.col("l_partkey"))
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("adsh"),
        (F.col("l_linenumber") + 10 * (F.col("l_suppkey") % 100)).cast("smallint").alias("report"),
        ((F.col("l_partkey") * 31 + F.col("l_quantity").cast("int")
          + 97 * F.datediff("l_shipdate", F.lit("1970-01-01").cast("date"))) % 30011).cast("smallint").alias("line"),
        stmt.alias("stmt"),
        F.lit(0).cast("tinyint").alias("inpth"),
        F.lit("H").alias("rfile"),
        tag.alias("tag"),
        F.concat(F.lit("us-gaap/"), (F.lit(2022) + F.col("l_suppkey") % 3).cast("string")).alias("version"),
        F.concat(F.lit("Label "), tag).alias("plabel"),
        F.when(F.col("l_tax") == 0, 1).otherwise(0).cast("tinyint").alias("negating"),
    )


class _LazyFixtures:
    """Fixture views built on first use (a query touching only ``sub`` never
    plans the others)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._cache = spark, sf_dir, {}

    def _read(self, name: str) -> DataFrame:
        key = "_" + name
        if key not in self._cache:
            self._cache[key] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._cache[key]

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def sub(self) -> DataFrame:
        return self._get("sub", lambda: fixture_sub(self._read("orders")))

    @property
    def num(self) -> DataFrame:
        return self._get("num", lambda: fixture_num(self._read("lineitem")))

    @property
    def tag(self) -> DataFrame:
        return self._get("tag", lambda: fixture_tag(self.num))

    @property
    def pre(self) -> DataFrame:
        return self._get("pre", lambda: fixture_pre(self._read("lineitem")))

    def as_dict(self) -> dict[str, DataFrame]:
        return {"sub": self.sub, "num": self.num, "tag": self.tag, "pre": self.pre}


_FIXTURES: "weakref.WeakKeyDictionary[SparkSession, dict[str, _LazyFixtures]]" = \
    weakref.WeakKeyDictionary()


def fixture_tables(spark: SparkSession, sf_dir: str) -> _LazyFixtures:
    """The four filing tables as lazy DataFrames over the driver's parquet.

    Plans are built once per (session, directory) and reused: DataFrames are
    immutable plans, so sharing them between queries is safe. The memo is
    keyed weakly by the session object, so a new session never sees plans
    of a stopped one."""
    per_session = _FIXTURES.setdefault(spark, {})
    if sf_dir not in per_session:
        per_session[sf_dir] = _LazyFixtures(spark, sf_dir)
    return per_session[sf_dir]


# --------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracle.
# --------------------------------------------------------------------------

def _sql_tag_expr(partkey: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FIXTURE_TAGS))
    return f"CASE {partkey} % {len(FIXTURE_TAGS)} {whens} END"


_SQL_SIC = _sql_case("(o_custkey // 10) % 10",
                     {i: s for i, s in enumerate(FIXTURE_SICS) if s is not None})

SQL_VIEWS = {
    "sub": f"""sub AS (
    SELECT
        CAST(o_orderkey AS VARCHAR) AS adsh,
        o_custkey // 10 AS cik,
        'Company ' || CAST(o_custkey // 10 AS VARCHAR) AS name,
        CAST({_SQL_SIC} AS INTEGER) AS sic,
        {_sql_case('o_orderpriority', FIXTURE_AFS)} AS afs,
        {_sql_case('o_orderstatus', FIXTURE_FORMS)} AS form,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL
             ELSE make_date(CAST(year(o_orderdate) AS INTEGER) - 1, 12, 31) END AS period,
        CAST(o_orderdate AS DATE) AS filed,
        CAST(o_orderdate AS TIMESTAMP) AS accepted,
        CAST(0 AS TINYINT) AS wksi,
        CAST(0 AS TINYINT) AS prevrpt,
        CAST(0 AS TINYINT) AS detail,
        CAST(o_orderkey AS VARCHAR) || '.xml' AS instance,
        1 AS nciks,
        CAST(year(o_orderdate) AS VARCHAR) || 'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter
    FROM orders)""",
    "num": f"""num AS (
    SELECT
        CAST(l_orderkey AS VARCHAR) AS adsh,
        {_sql_tag_expr('l_partkey')} AS tag,
        'us-gaap/' || CAST(2022 + l_suppkey % 3 AS VARCHAR) AS version,
        make_date(CAST(year(l_shipdate) AS INTEGER) - 1, 12, 31) AS ddate,
        CAST(CASE WHEN l_linenumber = 7 THEN 1 ELSE 4 END AS SMALLINT) AS qtrs,
        CASE WHEN l_quantity = 50 THEN 'shares' ELSE 'USD' END AS uom,
        CASE WHEN l_returnflag = 'R' THEN 'Seg=' || l_linestatus ELSE '' END AS segments,
        '' AS coreg,
        CAST((CASE WHEN l_tax = 0 THEN -1 ELSE 1 END)
             * CAST(l_extendedprice AS DECIMAL(12,2)) * 1000000 AS DECIMAL(28,4)) AS value
    FROM lineitem)""",
    "tag": """tag AS (
    SELECT tag, version,
        CAST(CASE WHEN tag = 'CustomTag' THEN 1 ELSE 0 END AS TINYINT) AS custom,
        CAST(CASE WHEN tag = 'GrossProfit' AND version = 'us-gaap/2022' THEN 1 ELSE 0 END AS TINYINT) AS abstract,
        'Label ' || tag AS tlabel
    FROM (SELECT DISTINCT tag, version FROM num) d)""",
    "pre": f"""pre AS (
    SELECT
        CAST(l_orderkey AS VARCHAR) AS adsh,
        CAST(l_linenumber + 10 * (l_suppkey % 100) AS SMALLINT) AS report,
        CAST((l_partkey * 31 + CAST(l_quantity AS INTEGER)
              + 97 * date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) % 30011 AS SMALLINT) AS line,
        CASE l_returnflag WHEN 'A' THEN 'IS' WHEN 'N' THEN 'BS' WHEN 'R' THEN 'CF' END AS stmt,
        {_sql_tag_expr('l_partkey')} AS tag,
        'us-gaap/' || CAST(2022 + l_suppkey % 3 AS VARCHAR) AS version,
        CAST(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS TINYINT) AS negating,
        CAST(0 AS TINYINT) AS inpth,
        'H' AS rfile,
        'Label ' || ({_sql_tag_expr('l_partkey')}) AS plabel
    FROM lineitem)""",
}

_DEPENDS = {"tag": ["num"]}


def sql_with(*views: str, extra: str = "") -> str:
    """``WITH <views>[, <extra CTEs>]`` for an oracle query."""
    order: list[str] = []
    for v in views:
        for dep in _DEPENDS.get(v, []):
            if dep not in order:
                order.append(dep)
        if v not in order:
            order.append(v)
    # keep the canonical order sub, num, tag, pre
    canon = [v for v in ("sub", "num", "tag", "pre") if v in order]
    ctes = [SQL_VIEWS[v] for v in canon]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(ctes) + "\n"
