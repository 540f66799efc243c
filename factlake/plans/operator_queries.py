"""One entry per reusable operator, each run over the whole
fixture views, with an independent SQL formulation for the oracle.

The cleaning entries feed the cleaners with text columns rendered from the
fixture views (with deterministic bad values: invalid dates, NULL markers,
non-numeric text) so the typed result can be checked against SQL parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import days_between, fiscal_year, parse_yyyymmdd
from factlake.operators.clean import (apply_null_markers, clean_num, clean_pre, clean_sub,
                                      clean_tag, drop_flagged)
from factlake.operators.dedup import latest_value
from factlake.operators.facts import consolidated_annual, filing_facts
from factlake.operators.joins import missing_concept, orphans
from factlake.operators.quality import (custom_tag_share, key_uniqueness, null_audit,
                                        reporting_multiplicity, table_counts)
from factlake.operators.ranking import rank_topn, topk_per_row
from factlake.operators.series import prior_value, rolling
from factlake.operators.stats import group_totals, percentiles, share_of_total
from factlake.operators.upsert import first_wins, insert_if_absent, replace_by_key
from factlake.plans.analytics import annual_revenue, latest_concepts
from factlake.plans.oracle import yearly, yearly_tags
from factlake.schema import (ANNUAL_FORMS, CONCEPTS, KEYS, NULL_MARKERS, NUM_COLUMNS,
                             PRE_COLUMNS, TAG_COLUMNS)
from factlake.session import apply_plan_confs
from factlake.sources.fixtures import sql_with, fixture_tables
from factlake.sources.tsv import quarters_in_range

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_plan_confs(spark)
            return fn(fixture_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _in(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


REV = CONCEPTS["revenue"]
CA = "n.qtrs = 4 AND n.uom = 'USD' AND n.segments = '' AND n.coreg = ''"
NUM_KEY = KEYS["num"]
_NM = _in([m.replace("\\", "\\") for m in NULL_MARKERS])


def _nm(col: str) -> str:
    """SQL: NULL-marker text -> NULL."""
    return f"(CASE WHEN {col} IN ({_NM}) THEN NULL ELSE {col} END)"


# --------------------------------------------------------------------------
# Scans, filters, joins
# --------------------------------------------------------------------------

@_register("scan_project", sql_with("sub") + "SELECT adsh, cik, name, form, filed FROM sub")
def scan_project(t):
    """Table scan with projection."""
    return t.sub.select("adsh", "cik", "name", "form", "filed")


@_register("quarter_selection", sql_with("sub") + """
SELECT adsh, quarter FROM sub WHERE quarter IN ('1996q4', '1997q1', '1997q2', '1997q3')""")
def quarter_selection(t):
    """Inclusive quarter range as a predicate on the quarter label."""
    return t.sub.where(F.col("quarter").isin(quarters_in_range("1996q4", "1997q3"))).select(
        "adsh", "quarter")


@_register("consolidated_annual", sql_with("num") + f"""
SELECT adsh, tag, version, ddate, value FROM num n WHERE {CA} AND n.value > 0""")
def consolidated_annual_q(t):
    """Consolidated annual USD facts with a positive value."""
    return consolidated_annual(t.num, positive=True).select("adsh", "tag", "version", "ddate",
                                                             "value")


@_register("fact_tag_join", sql_with("num", "tag") + """
SELECT n.adsh, n.tag, n.version, n.value, t.tlabel
FROM num n JOIN tag t ON n.tag = t.tag AND n.version = t.version
WHERE t.custom = 0 AND t.abstract = 0""")
def fact_tag_join(t):
    """Facts joined to standard concrete tags on (tag, version)."""
    std = t.tag.where((F.col("custom") == 0) & (F.col("abstract") == 0)).select(
        "tag", "version", "tlabel")
    return t.num.join(std, ["tag", "version"]).select("adsh", "tag", "version", "value", "tlabel")


@_register("filing_fact_join", sql_with("sub", "num") + f"""
SELECT s.adsh, s.cik, s.filed, CAST(year(n.ddate) AS INTEGER) AS fy, n.tag, n.value
FROM sub s JOIN num n ON s.adsh = n.adsh
WHERE s.form IN ('10-K', '10-K/A') AND n.tag IN ({_in(REV)}) AND {CA} AND n.value > 0""")
def filing_fact_join(t):
    """Annual-form filings joined to their revenue facts."""
    return filing_facts(t.sub, t.num, ANNUAL_FORMS, REV, positive=True).select(
        "adsh", "cik", "filed", "fy", "tag", "value")


@_register("anti_join", sql_with("sub", "num") + f"""
SELECT s.adsh, s.period FROM sub s
WHERE s.form = '10-K' AND s.period IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM num n WHERE n.adsh = s.adsh
                  AND n.tag IN ({_in(CONCEPTS['net_income_any'])}) AND {CA})""")
def anti_join(t):
    """10-K filings without any net-income fact (NOT EXISTS)."""
    filings = t.sub.where((F.col("form") == "10-K") & F.col("period").isNotNull()).select(
        "adsh", "period")
    facts = consolidated_annual(t.num, tags=CONCEPTS["net_income_any"]).select("adsh")
    return missing_concept(filings, facts)


@_register("orphan_facts", sql_with("sub", "num") + """
SELECT n.adsh, n.tag, n.version, n.value
FROM num n LEFT JOIN (SELECT adsh FROM sub WHERE form <> '10-Q') s ON n.adsh = s.adsh
WHERE s.adsh IS NULL""")
def orphan_facts(t):
    """Facts whose filing is absent (sub without its 10-Q rows)."""
    parent = t.sub.where(F.col("form") != "10-Q")
    return orphans(t.num.select("adsh", "tag", "version", "value"), parent, "adsh")


@_register("topk_per_row", sql_with("sub", "num") + f"""
SELECT adsh, e.t AS tag, e.v AS value
FROM (
    SELECT n.adsh, unnest(list(struct_pack(v := n.value, t := n.tag) ORDER BY n.value DESC, n.tag, n.version)[1:3]) AS e
    FROM num n, sub f
    WHERE f.adsh = n.adsh AND f.period = n.ddate AND f.form = '10-K' AND {CA} AND n.value > 0
    GROUP BY n.adsh)""")
def topk_per_row_q(t):
    """The three largest current-year facts of every 10-K filing."""
    filings = t.sub.where((F.col("form") == "10-K") & F.col("period").isNotNull()).select(
        "adsh", F.col("period").alias("ddate"))
    facts = consolidated_annual(t.num, positive=True).select("adsh", "ddate", "tag", "version",
                                                              "value")
    top = topk_per_row(filings, facts, ["adsh", "ddate"], ["adsh"],
                       [F.desc("value"), F.asc("tag"), F.asc("version")], 3)
    return top.select("adsh", "tag", "value")


@_register("detail_to_total_join", sql_with(
    "sub", "num", extra=yearly("AND s.sic IS NOT NULL") + """,
sized AS (SELECT sic, fy, SUM(revenue) AS total, COUNT(*) AS members FROM rev GROUP BY sic, fy)""")
    + """
SELECT r.cik, r.sic, r.fy, r.revenue, z.total, z.members,
       CAST(r.revenue AS DOUBLE) / CAST(z.total AS DOUBLE) AS share
FROM rev r, sized z WHERE z.sic = r.sic AND z.fy = r.fy AND z.total > 0""")
def detail_to_total_join(t):
    """Each company's revenue joined to its sector-year total."""
    rev = annual_revenue(t, sub_cols=("sic",), require_sic=True)
    return share_of_total(rev, ["sic", "fy"], "revenue").select(
        "cik", "sic", "fy", "revenue", "total", "members", "share")


# --------------------------------------------------------------------------
# Windows
# --------------------------------------------------------------------------

@_register("latest_value", sql_with("sub", "num", extra=yearly()) + """
SELECT cik, fy, revenue FROM rev""")
def latest_value_q(t):
    """Latest-filed revenue per (cik, fy) with the documented tie-break."""
    return annual_revenue(t).select("cik", "fy", "revenue")


_W2_TAGS = CONCEPTS["revenue"] + CONCEPTS["cogs"]


@_register("latest_value_by_tag", sql_with("sub", "num", extra=yearly_tags(_W2_TAGS, "AND n.value > 0"))
           + "SELECT cik, fy, tag, adsh, value FROM val")
def latest_value_by_tag(t):
    """Latest-filed value per (cik, fy, tag)."""
    facts = filing_facts(t.sub, t.num, ANNUAL_FORMS, _W2_TAGS, positive=True)
    return latest_value(facts, ["cik", "fy", "tag"]).select("cik", "fy", "tag", "adsh", "value")


@_register("rank_topn", sql_with("sub", "num", extra=yearly("AND s.sic IS NOT NULL")) + """
SELECT r.sic, r.fy, r.cik, r.revenue, CAST(count(o.cik) + 1 AS INTEGER) AS sector_rank
FROM rev r LEFT JOIN rev o ON o.sic = r.sic AND o.fy = r.fy AND o.revenue > r.revenue
GROUP BY ALL HAVING count(o.cik) < 3""")
def rank_topn_q(t):
    """Top three companies by revenue per (sic, fy), RANK ties kept."""
    rev = annual_revenue(t, sub_cols=("sic",), require_sic=True)
    return rank_topn(rev, ["sic", "fy"], [F.desc("revenue")], 3, out="sector_rank").select(
        "sic", "fy", "cik", "revenue", "sector_rank")


@_register("lag_prior", sql_with("sub", "num", extra=yearly()) + """
SELECT r.cik, r.fy, r.revenue, arg_max(p.revenue, p.fy) AS prior_revenue
FROM rev r LEFT JOIN rev p ON p.cik = r.cik AND p.fy < r.fy GROUP BY r.cik, r.fy, r.revenue""")
def lag_prior(t):
    """Previous available year's revenue."""
    return prior_value(annual_revenue(t), "cik", "fy", "revenue", "prior_revenue")


@_register("rolling_sum", sql_with("sub", "num", extra=yearly()) + """
SELECT r.cik, r.fy, r.revenue, list_sum(list_reverse_sort(list(struct_pack(y := p.fy, v := p.revenue)))[1:3].list_transform(lambda x: x.v)) AS revenue_3yr_sum,
       least(count(*), 3) AS years_in_window
FROM rev r JOIN rev p ON p.cik = r.cik AND p.fy <= r.fy GROUP BY r.cik, r.fy, r.revenue""")
def rolling_sum(t):
    """Trailing three-row sum and count, partial frames kept."""
    return rolling(annual_revenue(t), "cik", "fy", "revenue", 3, "revenue_3yr_sum",
                   "years_in_window")


@_register("partition_total", sql_with(
    "sub", "num", extra=yearly("AND s.sic IS NOT NULL")) + """
SELECT r.cik, r.sic, r.fy, r.revenue, SUM(o.revenue) AS sector_total, COUNT(*) AS firms
FROM rev r JOIN rev o ON o.sic = r.sic AND o.fy = r.fy GROUP BY r.cik, r.sic, r.fy, r.revenue""")
def partition_total(t):
    """Partition total on every row (as a group aggregate joined back,
    so a huge partition is never one window task)."""
    rev = annual_revenue(t, sub_cols=("sic",), require_sic=True)
    totals = group_totals(rev, ["sic", "fy"], "revenue", "sector_total", "firms")
    return rev.join(totals, ["sic", "fy"]).select("cik", "sic", "fy", "revenue", "sector_total",
                                                   "firms")


# --------------------------------------------------------------------------
# Aggregations
# --------------------------------------------------------------------------

_PIVOT = ["revenue", "cogs", "gross_profit", "rd", "sga", "op_income", "net_income"]
_PIVOT_TAGS = [tg for n in _PIVOT for tg in CONCEPTS[n]]


def _sql_filter(concept):
    return f"MAX(value) FILTER (WHERE tag IN ({_in(CONCEPTS[concept])}))"


@_register("pivot_concepts", sql_with("sub", "num", extra=yearly_tags(_PIVOT_TAGS, "AND n.value IS NOT NULL")) + f"""
SELECT cik, fy, MAX(name) AS name, {', '.join(f'{_sql_filter(n)} AS {n}' for n in _PIVOT)}
FROM val GROUP BY cik, fy""")
def pivot_concepts_q(t):
    """Seven concepts (synonym tags, MAX not SUM) side by side."""
    concepts = {n: CONCEPTS[n] for n in _PIVOT}
    return latest_concepts(t, concepts, sub_cols=("name",), not_null=True,
                           carry_sub_cols=("name",)).select("cik", "fy", "name", *_PIVOT)


@_register("percentiles", sql_with(
    "sub", "num", extra=yearly("AND s.sic IS NOT NULL") + """,
spread AS (SELECT sic, COUNT(*) AS n, quantile_cont(CAST(revenue AS DOUBLE), [0.25, 0.5, 0.75]) AS p FROM rev GROUP BY sic)""") + """
SELECT sic, n, CAST(p[1] AS DECIMAL(28,2)) AS p25, CAST(p[2] AS DECIMAL(28,2)) AS p50,
       CAST(p[3] AS DECIMAL(28,2)) AS p75, CAST(p[3] - p[1] AS DECIMAL(28,2)) AS iqr
FROM spread""")
def percentiles_q(t):
    """Exact quartiles and IQR of annual revenue per sector."""
    rev = annual_revenue(t, sub_cols=("sic",), require_sic=True)
    q = percentiles(rev, ["sic"], "revenue", [0.25, 0.5, 0.75], ["p25", "p50", "p75"],
                    count_name="n")
    return q.select("sic", "n", *[F.col(c).cast("decimal(28,2)").alias(c)
                                  for c in ("p25", "p50", "p75")],
                    (F.col("p75") - F.col("p25")).cast("decimal(28,2)").alias("iqr"))


@_register("conditional_count", sql_with("sub") + """
SELECT form, CAST(year(filed) AS INTEGER) AS filing_year, COUNT(*) AS filings,
       CAST(SUM(CASE WHEN filed - period > 90 THEN 1 ELSE 0 END) AS BIGINT) AS late_filings
FROM sub WHERE period IS NOT NULL GROUP BY 1, 2""")
def conditional_count(t):
    """A10: count and conditional count in one aggregate."""
    return (t.sub.where(F.col("period").isNotNull())
            .groupBy("form", fiscal_year("filed").alias("filing_year"))
            .agg(F.count(F.lit(1)).alias("filings"),
                 F.sum(F.when(days_between("filed", "period") > 90, 1).otherwise(0))
                 .cast("bigint").alias("late_filings")))


@_register("count_distinct", sql_with("sub") + """
SELECT sic, COUNT(DISTINCT cik) AS companies, COUNT(DISTINCT form) AS forms, COUNT(*) AS filings
FROM sub GROUP BY sic""")
def count_distinct(t):
    """A5: distinct counts per group (NULL sic is its own group)."""
    return t.sub.groupBy("sic").agg(F.countDistinct("cik").alias("companies"),
                                    F.countDistinct("form").alias("forms"),
                                    F.count(F.lit(1)).alias("filings"))


# --------------------------------------------------------------------------
# Keyed writes
# --------------------------------------------------------------------------

@_register("insert_if_absent_tags", sql_with("num", "tag", extra="""existing AS (
    SELECT tag, version, custom, abstract, tlabel FROM tag WHERE version <> 'us-gaap/2024'
), incoming AS (
    SELECT tag, version, custom, abstract, 'New ' || tag AS tlabel FROM tag
)""") + """
SELECT * FROM existing
UNION ALL
SELECT * FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.tag = i.tag AND e.version = i.version)""")
def insert_if_absent_tags(t):
    """Tag rows are insert-if-absent on (tag, version): existing wins."""
    cols = ["tag", "version", "custom", "abstract", "tlabel"]
    existing = t.tag.where(F.col("version") != "us-gaap/2024").select(*cols)
    incoming = t.tag.withColumn("tlabel", F.concat(F.lit("New "), F.col("tag"))).select(*cols)
    new = insert_if_absent(existing, incoming, ["tag", "version"], [F.asc("tlabel")])
    return existing.unionByName(new)


_KEY_SQL = ", ".join(NUM_KEY)


@_register("insert_if_absent_facts", sql_with("num", extra=f"""existing AS (
    SELECT {_KEY_SQL}, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY_SQL} ORDER BY value) AS rn
        FROM num WHERE year(ddate) <= 1997) e WHERE rn = 1
), incoming AS (
    SELECT {_KEY_SQL}, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY_SQL} ORDER BY value) AS rn
        FROM num) i WHERE rn = 1
)""") + f"""
SELECT * FROM existing
UNION ALL
SELECT * FROM incoming i WHERE NOT EXISTS (
    SELECT 1 FROM existing e WHERE {' AND '.join(f'e.{k} = i.{k}' for k in NUM_KEY)})""")
def insert_if_absent_facts(t):
    """Facts are insert-if-absent on the 8-column key; duplicates inside
    the incoming batch keep the first by (value)."""
    cols = [*NUM_KEY, "value"]
    order = [F.asc("value")]
    existing = first_wins(t.num.where(F.year("ddate") <= 1997), NUM_KEY, order).select(*cols)
    new = insert_if_absent(existing, t.num.select(*cols), NUM_KEY, order)
    return existing.unionByName(new)


@_register("replace_by_filing", sql_with("sub", "num", extra="""amended AS (
    SELECT adsh FROM sub WHERE form = '10-K/A'
)""") + f"""
SELECT {_KEY_SQL}, value FROM num WHERE adsh NOT IN (SELECT adsh FROM amended)
UNION ALL
SELECT {_KEY_SQL}, CAST(value * 2 AS DECIMAL(28,4)) AS value
FROM num WHERE adsh IN (SELECT adsh FROM amended)""")
def replace_by_filing(t):
    """Reloading filings deletes their rows by accession number and
    appends the new rows."""
    cols = [*NUM_KEY, "value"]
    amended = t.sub.where(F.col("form") == "10-K/A").select("adsh")
    new = (t.num.join(amended.hint("shuffle_hash"), "adsh")
           .withColumn("value", (F.col("value") * 2).cast("decimal(28,4)")).select(*cols))
    return replace_by_key(t.num.select(*cols), new, "adsh", listed=amended)


# --------------------------------------------------------------------------
# Cleaning (text columns rendered from the fixture views)
# --------------------------------------------------------------------------

def _num_text(num: DataFrame) -> DataFrame:
    return num.select(
        "adsh", "tag", "version",
        F.when(F.col("segments") != "", F.lit("20241399"))
        .otherwise(F.date_format("ddate", "yyyyMMdd")).alias("ddate"),
        F.col("qtrs").cast("string").alias("qtrs"),
        F.when(F.col("uom") == "shares", F.lit("NA")).otherwise(F.col("uom")).alias("uom"),
        "segments", F.lit("\\N").alias("coreg"),
        F.when(F.col("value") < 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
        .alias("value"),
        F.lit("").alias("footnote"))


_NUM_TEXT_SQL = """num_text AS (
    SELECT adsh, tag, version,
        CASE WHEN segments <> '' THEN '20241399' ELSE strftime(ddate, '%Y%m%d') END AS ddate,
        CAST(qtrs AS VARCHAR) AS qtrs,
        CASE WHEN uom = 'shares' THEN 'NA' ELSE uom END AS uom,
        segments, '\\N' AS coreg,
        CASE WHEN value < 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
        '' AS footnote
    FROM num)"""


def _date_sql(col: str) -> str:
    c = _nm(col)
    return (f"(CASE WHEN regexp_matches({c}, '^[0-9]{{8}}$') THEN "
            f"(CASE WHEN CAST(try_strptime({c}, '%Y%m%d') AS DATE) BETWEEN DATE '1677-09-22' "
            f"AND DATE '2262-04-11' THEN CAST(try_strptime({c}, '%Y%m%d') AS DATE) END) END)")


@_register("clean_num", sql_with("num", extra=_NUM_TEXT_SQL + """, typed AS (
    SELECT """ + f"""{_nm('adsh')} AS adsh, {_nm('tag')} AS tag, {_nm('version')} AS version,
        {_date_sql('ddate')} AS ddate, TRY_CAST({_nm('qtrs')} AS SMALLINT) AS qtrs,
        {_nm('uom')} AS uom, COALESCE({_nm('segments')}, '') AS segments,
        COALESCE({_nm('coreg')}, '') AS coreg,
        TRY_CAST({_nm('value')} AS DECIMAL(28,4)) AS value, {_nm('footnote')} AS footnote
    FROM num_text)""") + """
SELECT * FROM typed WHERE adsh IS NOT NULL AND tag IS NOT NULL AND version IS NOT NULL
  AND ddate IS NOT NULL AND qtrs IS NOT NULL AND uom IS NOT NULL""")
def clean_num_q(t):
    """Typed facts from text, NULL-key rows dropped."""
    return drop_flagged(clean_num(apply_null_markers(_num_text(t.num)))).select(*NUM_COLUMNS)


@_register("clean_tag", sql_with("num", "tag", extra="""tag_text AS (
    SELECT tag, CASE WHEN abstract = 1 THEN '\\N' ELSE version END AS version,
        CAST(custom AS VARCHAR) AS custom, CAST(abstract AS VARCHAR) AS abstract,
        'monetary' AS datatype, 'D' AS iord, '' AS crdr, tlabel, 'null' AS doc
    FROM tag)""") + f"""
SELECT * FROM (SELECT {_nm('tag')} AS tag, {_nm('version')} AS version,
        TRY_CAST({_nm('custom')} AS TINYINT) AS custom, TRY_CAST({_nm('abstract')} AS TINYINT) AS abstract,
        {_nm('datatype')} AS datatype, {_nm('iord')} AS iord, {_nm('crdr')} AS crdr,
        {_nm('tlabel')} AS tlabel, {_nm('doc')} AS doc FROM tag_text) x
WHERE tag IS NOT NULL AND version IS NOT NULL""")
def clean_tag_q(t):
    """Typed tags from text, rows with a NULL key dropped."""
    text = t.tag.select(
        "tag", F.when(F.col("abstract") == 1, F.lit("\\N")).otherwise(F.col("version")).alias("version"),
        F.col("custom").cast("string").alias("custom"),
        F.col("abstract").cast("string").alias("abstract"),
        "datatype", "iord", F.coalesce("crdr", F.lit("")).alias("crdr"), "tlabel",
        F.lit("null").alias("doc"))
    return drop_flagged(clean_tag(apply_null_markers(text))).select(*TAG_COLUMNS)


@_register("clean_pre", sql_with("pre", extra="""pre_text AS (
    SELECT adsh, CAST(report AS VARCHAR) AS report,
        CASE WHEN stmt = 'CF' THEN 'NULL' ELSE CAST(line AS VARCHAR) END AS line,
        stmt, CAST(inpth AS VARCHAR) AS inpth, rfile, tag, version, plabel,
        CAST(negating AS VARCHAR) AS negating
    FROM pre)""") + f"""
SELECT * FROM (SELECT {_nm('adsh')} AS adsh, TRY_CAST({_nm('report')} AS SMALLINT) AS report,
        TRY_CAST({_nm('line')} AS SMALLINT) AS line, {_nm('stmt')} AS stmt,
        TRY_CAST({_nm('inpth')} AS TINYINT) AS inpth, {_nm('rfile')} AS rfile,
        {_nm('tag')} AS tag, {_nm('version')} AS version, {_nm('plabel')} AS plabel,
        TRY_CAST({_nm('negating')} AS TINYINT) AS negating FROM pre_text) x
WHERE adsh IS NOT NULL AND report IS NOT NULL AND line IS NOT NULL AND tag IS NOT NULL
  AND version IS NOT NULL""")
def clean_pre_q(t):
    """Typed presentation lines from text, NULL-key rows dropped."""
    text = t.pre.select(
        "adsh", F.col("report").cast("string").alias("report"),
        F.when(F.col("stmt") == "CF", F.lit("NULL")).otherwise(F.col("line").cast("string"))
        .alias("line"),
        "stmt", F.col("inpth").cast("string").alias("inpth"), "rfile", "tag", "version",
        "plabel", F.col("negating").cast("string").alias("negating"))
    return drop_flagged(clean_pre(apply_null_markers(text))).select(*PRE_COLUMNS)


_SUB_OUT = ["adsh", "cik", "name", "sic", "changed", "afs", "wksi", "form", "period", "fy",
            "filed", "accepted", "prevrpt", "detail", "instance", "nciks"]


@_register("clean_sub", sql_with("sub", extra="""sub_text AS (
    SELECT adsh, CAST(cik AS VARCHAR) AS cik, name, COALESCE(CAST(sic AS VARCHAR), '') AS sic,
        CASE WHEN form = '10-Q' THEN 'abc' ELSE strftime(filed, '%Y%m%d') END AS changed,
        COALESCE(afs, '') AS afs, '0' AS wksi, form,
        COALESCE(strftime(period, '%Y%m%d'), '') AS period,
        COALESCE(CAST(year(period) AS VARCHAR), '') AS fy,
        strftime(filed, '%Y%m%d') AS filed,
        strftime(accepted, '%Y-%m-%d %H:%M:%S') || '.0' AS accepted,
        '0' AS prevrpt, '0' AS detail, adsh || '.xml' AS instance, '1' AS nciks
    FROM sub)""") + f"""
SELECT {_nm('adsh')} AS adsh, TRY_CAST({_nm('cik')} AS BIGINT) AS cik, {_nm('name')} AS name,
       TRY_CAST({_nm('sic')} AS INTEGER) AS sic, {_date_sql('changed')} AS changed,
       {_nm('afs')} AS afs, TRY_CAST({_nm('wksi')} AS TINYINT) AS wksi, {_nm('form')} AS form,
       {_date_sql('period')} AS period, TRY_CAST({_nm('fy')} AS SMALLINT) AS fy,
       {_date_sql('filed')} AS filed, TRY_CAST({_nm('accepted')} AS TIMESTAMP) AS accepted,
       TRY_CAST({_nm('prevrpt')} AS TINYINT) AS prevrpt, TRY_CAST({_nm('detail')} AS TINYINT) AS detail,
       {_nm('instance')} AS instance, TRY_CAST({_nm('nciks')} AS INTEGER) AS nciks
FROM sub_text""")
def clean_sub_q(t):
    """Typed filing headers from text (no row is dropped)."""
    s = t.sub
    text = s.select(
        "adsh", F.col("cik").cast("string").alias("cik"), "name",
        F.coalesce(F.col("sic").cast("string"), F.lit("")).alias("sic"),
        F.when(F.col("form") == "10-Q", F.lit("abc"))
        .otherwise(F.date_format("filed", "yyyyMMdd")).alias("changed"),
        F.coalesce("afs", F.lit("")).alias("afs"), F.lit("0").alias("wksi"), "form",
        F.coalesce(F.date_format("period", "yyyyMMdd"), F.lit("")).alias("period"),
        F.coalesce(F.year("period").cast("string"), F.lit("")).alias("fy"),
        F.date_format("filed", "yyyyMMdd").alias("filed"),
        F.concat(F.date_format("accepted", "yyyy-MM-dd HH:mm:ss"), F.lit(".0")).alias("accepted"),
        F.lit("0").alias("prevrpt"), F.lit("0").alias("detail"),
        F.concat("adsh", F.lit(".xml")).alias("instance"), F.lit("1").alias("nciks"))
    return clean_sub(apply_null_markers(text)).select(*_SUB_OUT)


@_register("date_parse", sql_with("sub", extra="""texts AS (
    SELECT adsh, 'plain' AS variant, strftime(filed, '%Y%m%d') AS txt FROM sub
    UNION ALL SELECT adsh, 'seven', substr(strftime(filed, '%Y%m%d'), 1, 7) FROM sub
    UNION ALL SELECT adsh, 'far', '29' || substr(strftime(filed, '%Y%m%d'), 3) FROM sub
)""") + f"SELECT adsh, variant, txt, {_date_sql('txt')} AS parsed FROM texts")
def date_parse(t):
    """YYYYMMDD parsing with the 7-digit and far-future guards."""
    d = F.date_format("filed", "yyyyMMdd")
    plain = t.sub.select("adsh", F.lit("plain").alias("variant"), d.alias("txt"))
    seven = t.sub.select("adsh", F.lit("seven").alias("variant"), F.substring(d, 1, 7).alias("txt"))
    far = t.sub.select("adsh", F.lit("far").alias("variant"),
                       F.concat(F.lit("29"), F.substring(d, 3, 6)).alias("txt"))
    u = plain.unionByName(seven).unionByName(far)
    return u.withColumn("parsed", parse_yyyymmdd("txt"))


# --------------------------------------------------------------------------
# Data quality
# --------------------------------------------------------------------------

def _uniq_sql(table: str, key: list[str]) -> str:
    k = ", ".join(key)
    return f"""SELECT '{table}' AS table_name, CAST(SUM(n) AS BIGINT) AS row_count,
       COUNT(*) AS distinct_keys, COUNT(*) FILTER (WHERE n > 1) AS duplicated_keys,
       CAST(COALESCE(SUM(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT {k}, COUNT(*) AS n FROM {table} GROUP BY {k}) g"""


@_register("key_uniqueness", sql_with("sub", "num", "tag", "pre") + "\nUNION ALL\n".join(
    _uniq_sql(tb, KEYS[tb]) for tb in ("sub", "tag", "num", "pre")))
def key_uniqueness_q(t):
    """Q2: natural-key uniqueness of the four tables."""
    parts = [key_uniqueness(getattr(t, tb), KEYS[tb], tb) for tb in ("sub", "tag", "num", "pre")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_AUDIT_COLS = ["name", "sic", "afs", "form", "period", "filed"]


@_register("null_audit", sql_with("sub") + "\nUNION ALL\n".join(
    f"SELECT 'sub' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM sub"
    for c in _AUDIT_COLS))
def null_audit_q(t):
    """Q3: NULL count per column in one pass."""
    return null_audit(t.sub, _AUDIT_COLS, "sub")


@_register("union_counts", sql_with("sub", "num", "tag", "pre") + "\nUNION ALL\n".join(
    f"SELECT '{tb}' AS table_name, COUNT(*) AS row_count FROM {tb}"
    for tb in ("num", "pre", "sub", "tag")))
def union_counts(t):
    """Per-table row counts as one UNION ALL."""
    return table_counts(t.as_dict())


@_register("custom_tag_share", sql_with("num", "tag") + """
SELECT CAST(SUM(n) AS BIGINT) AS tag_versions, CAST(SUM(c) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) AS custom_share,
       COUNT(*) FILTER (WHERE v > 1) AS multi_version_tags
FROM (SELECT tag, COUNT(*) AS n, SUM(custom) AS c, COUNT(DISTINCT version) AS v FROM tag GROUP BY tag) g""")
def custom_tag_share_q(t):
    """Q6: share of custom tags, tags present in several versions."""
    return custom_tag_share(t.tag)


@_register("reporting_multiplicity", sql_with("sub", "num") + """
SELECT ROUND(AVG(n), 6) AS avg_reports, MAX(n) AS max_reports, COUNT(*) AS series_points
FROM (SELECT s.cik, year(n.ddate) AS fy, n.tag, COUNT(*) AS n
      FROM sub s JOIN num n ON s.adsh = n.adsh GROUP BY 1, 2, 3) g""")
def reporting_multiplicity_q(t):
    """Q7: how many times a (cik, fy, tag) value is reported."""
    facts = t.num.select("adsh", "tag", fiscal_year("ddate").alias("fy")).join(
        t.sub.select("adsh", "cik"), "adsh")
    r = reporting_multiplicity(facts)
    return r.select(F.round("avg_reports", 6).alias("avg_reports"), "max_reports", "series_points")


def _dq_sql(**expected: str) -> str:
    from factlake.schema import REQUIRED
    parts = ["""SELECT 'orphan_facts' AS "check", 'num' AS table_name,
       CAST(COUNT(*) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS expected
FROM num n WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.adsh = n.adsh)"""]
    for tb in ("sub", "tag", "num", "pre"):
        k = ", ".join(KEYS[tb])
        parts.append(f"""SELECT 'duplicate_keys', '{tb}', CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE), 0.0
FROM (SELECT {k}, COUNT(*) AS n FROM {tb} GROUP BY {k}) g""")
        parts.append(f"SELECT 'row_count', '{tb}', CAST(COUNT(*) AS DOUBLE), {expected.get(tb, 'NULL')} FROM {tb}")
        for c in REQUIRED[tb]:
            parts.append(f"SELECT 'null:{c}', '{tb}', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE), 0.0 FROM {tb}")
    parts.append("""SELECT 'custom_tag_share', 'tag', CAST(SUM(custom) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), NULL FROM tag""")
    parts.append("""SELECT 'multi_version_tags', 'tag', CAST(COUNT(*) AS DOUBLE), NULL
FROM (SELECT tag FROM tag GROUP BY tag HAVING COUNT(DISTINCT version) > 1) g""")
    parts.append("""SELECT 'avg_reports_per_value', 'num', ROUND(AVG(n), 6), NULL
FROM (SELECT s.cik, year(n.ddate) AS fy, n.tag, COUNT(*) AS n
      FROM num n JOIN sub s ON s.adsh = n.adsh GROUP BY 1, 2, 3) g""")
    parts.append(f"""SELECT 'filings_missing_net_income', 'sub', CAST(COUNT(*) AS DOUBLE), NULL
FROM sub s WHERE s.form = '10-K' AND NOT EXISTS (SELECT 1 FROM num n WHERE n.adsh = s.adsh
    AND n.tag IN ({_in(CONCEPTS['net_income_any'])}) AND {CA})""")
    body = "\nUNION ALL\n".join(parts)
    return sql_with("sub", "num", "tag", "pre", extra=f"report AS ({body})") + """
SELECT *, CASE WHEN expected IS NULL THEN NULL WHEN expected = 0 THEN value = 0
               ELSE abs(value - expected) <= 0.005 * expected END AS ok
FROM report"""


@_register("dq_report", _dq_sql())
def dq_report_q(t):
    """Q1-Q8 / §3.3: the post-load data-quality report."""
    from factlake.plans.dq import dq_report
    return dq_report(t)


@_register("dq_expected_counts", _dq_sql(num="(SELECT CAST(COUNT(*) AS DOUBLE) * 1.004 FROM pre)",
                                         sub="(SELECT CAST(COUNT(*) AS DOUBLE) FROM num)"))
def dq_expected_counts(t):
    """Q4: the report against expected row counts, one within the tolerance of
    half a percent and one beyond it."""
    from factlake.plans.dq import dq_report
    return dq_report(t, {"num": t.pre.count() * 1.004, "sub": t.num.count()})


# Columns compared after a load: those that the SQL fixture has.
_LOADED = {
    "sub": ["adsh", "cik", "name", "sic", "afs", "form", "period", "filed"],
    "tag": ["tag", "version", "custom", "abstract", "tlabel"],
    "num": [*NUM_KEY, "value"], "pre": PRE_COLUMNS,
}


def _row_sql(table: str) -> str:
    """SQL: a row's columns as one text."""
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _LOADED[table])


def _loaded_rows(lake_tables) -> DataFrame:
    """(table_name, quarter, row_text) of every row of a lake."""
    out = None
    for table, cols in _LOADED.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
        rows = getattr(lake_tables, table).select(F.lit(table).alias("table_name"), "quarter", text.alias("row_text"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Files list facts by falling value, so the first listed of equal keys is the largest.
_FIRST_LISTED = f"""SELECT {', '.join(k for k in NUM_KEY)}, max(value) AS value FROM {{}} GROUP BY ALL"""

_ROUNDTRIP_SQL = sql_with("sub", "num", "tag", "pre", extra=f"""facts AS ({_FIRST_LISTED.format('num')})""") + f"""
SELECT 'sub' AS table_name, quarter, {_row_sql('sub')} AS row_text FROM sub
UNION ALL
SELECT 'num', (SELECT s.quarter FROM sub s WHERE s.adsh = facts.adsh), {_row_sql('num')} FROM facts
WHERE adsh IN (SELECT adsh FROM sub)
UNION ALL
SELECT 'pre', (SELECT s.quarter FROM sub s WHERE s.adsh = pre.adsh), {_row_sql('pre')} FROM pre
WHERE adsh IN (SELECT adsh FROM sub)
UNION ALL
SELECT 'tag', (SELECT min(s.quarter) FROM num n, sub s WHERE n.adsh = s.adsh AND n.tag = tag.tag AND n.version = tag.version),
       {_row_sql('tag')} FROM tag
WHERE EXISTS (FROM num n, sub s WHERE n.adsh = s.adsh AND n.tag = tag.tag AND n.version = tag.version)"""


def _load_folder(spark) -> str:
    import uuid

    from factlake.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/factlake-roundtrip-{uuid.uuid4().hex}"


def _loaded(spark, work: str, tables, name: str) -> None:
    """Write the tables as quarterly files and load them into ``work``/lake. The fixture's keys
    may repeat (pre's line is a hash), which would fail whole quarters: files list each key once."""
    from factlake.plans.ingest import ingest_quarters
    from factlake.sources.export import publishable, write_quarter_files
    from factlake.sources.lake import remove
    from factlake.sources.tsv import SPARK_LAYOUT

    raw = f"{work}/{name}"
    quarters = write_quarter_files(publishable(tables), raw)
    res = ingest_quarters(spark, raw, f"{work}/lake", quarters, layout=SPARK_LAYOUT, staged=lambda: remove(spark, raw))
    if res.failed:
        raise RuntimeError(f"quarters failed to load: {res.failed}")


@_register("ingest_roundtrip", _ROUNDTRIP_SQL)
def ingest_roundtrip(t):
    """S1-S13, C1-C12 end to end: the fixture tables are written by Spark as
    quarterly tab-separated files into the shared checkpoint folder, loaded
    with the ingest job, and every row of the lake is returned."""
    from factlake.sources.lake import LakeTables

    spark = t.sub.sparkSession
    work = _load_folder(spark)
    _loaded(spark, work, t, "raw")
    return _loaded_rows(LakeTables(spark, f"{work}/lake"))


_AMENDED = "'1996q1', '1997q2'"

_INCREMENTAL_SQL = sql_with("sub", "num", "tag", "pre", extra=f"""late AS (
    SELECT * FROM sub WHERE quarter IN ({_AMENDED})),
facts AS ({_FIRST_LISTED.format('num')}),
late_facts AS (SELECT * REPLACE (CAST(value + 1 AS DECIMAL(28,4)) AS value) FROM facts WHERE adsh IN (SELECT adsh FROM late)),
late_pre AS (SELECT * REPLACE ('Amended ' || plabel AS plabel) FROM pre WHERE adsh IN (SELECT adsh FROM late))""") + f"""
SELECT 'sub' AS table_name, quarter, {_row_sql('sub')} AS row_text FROM sub WHERE adsh NOT IN (SELECT adsh FROM late)
UNION ALL
SELECT 'sub', '2099q1', {_row_sql('sub')} FROM (SELECT * REPLACE ('Amended ' || name AS name) FROM late)
UNION ALL
SELECT 'num', (SELECT s.quarter FROM sub s WHERE s.adsh = facts.adsh), {_row_sql('num')} FROM facts
WHERE adsh IN (SELECT adsh FROM sub) AND adsh NOT IN (SELECT adsh FROM late)
UNION ALL
SELECT 'num', '2099q1', {_row_sql('num')} FROM late_facts
UNION ALL
SELECT 'pre', (SELECT s.quarter FROM sub s WHERE s.adsh = pre.adsh), {_row_sql('pre')} FROM pre
WHERE adsh IN (SELECT adsh FROM sub) AND adsh NOT IN (SELECT adsh FROM late)
UNION ALL
SELECT 'pre', '2099q1', {_row_sql('pre')} FROM late_pre
UNION ALL
SELECT 'tag', (SELECT min(s.quarter) FROM num n, sub s WHERE n.adsh = s.adsh AND n.tag = tag.tag AND n.version = tag.version),
       {_row_sql('tag')} FROM tag
WHERE EXISTS (FROM num n, sub s WHERE n.adsh = s.adsh AND n.tag = tag.tag AND n.version = tag.version)"""


@_register("ingest_incremental", _INCREMENTAL_SQL)
def ingest_incremental(t):
    """S9-S13 on a lake that holds rows: after all quarters, a later one relists
    the filings of two of them with other names, values and labels, and repeats
    their tags with other labels. Filings are replaced, tags are not."""
    from types import SimpleNamespace

    from factlake.sources.lake import LakeTables

    spark = t.sub.sparkSession
    work = _load_folder(spark)
    _loaded(spark, work, t, "raw")
    late = t.sub.where(f"quarter in ({_AMENDED})").withColumns(
        {"quarter": F.lit("2099q1"), "name": F.concat(F.lit("Amended "), "name")})
    ids = late.select("adsh")
    again = SimpleNamespace(
        sub=late, num=t.num.join(ids, "adsh", "left_semi").withColumn("value", (F.col("value") + 1).cast("decimal(28,4)")),
        pre=t.pre.join(ids, "adsh", "left_semi").withColumn("plabel", F.concat(F.lit("Amended "), "plabel")),
        tag=t.tag.withColumn("tlabel", F.concat(F.lit("Later "), "tlabel")))
    _loaded(spark, work, again, "late")
    return _loaded_rows(LakeTables(spark, f"{work}/lake"))


# Fixed values of the dirty load: what is done to a fact's line, by its value's whole part modulo 40.
_DIRT = {"bad value": 1, "bad date": 2, "marker": 3, "long": 4, "short": 5, "line break": 6, "bad bytes": 7}
_NO_PRE, _NO_CIK = "1995q2", "1996q3"
_AUDITED = ["rows_read", "dropped_null_key", "long_lines", "short_lines", "damaged_lines", "joined_line_breaks",
            "unclosed_quotes", "bad_dates", "bad_numbers", "rows_in_lake", "not_inserted"]


def _dirty_sql() -> str:
    d = _DIRT
    short = f"(kind = {d['short']} AND segments = '' AND coreg = '')"
    row = " || '|' || ".join(
        f"coalesce(CAST({c} AS VARCHAR), '~')" for c in [
            *NUM_KEY, f"CASE WHEN kind = {d['bad value']} OR {short} THEN NULL ELSE value END",
            f"""CASE kind WHEN {d['line break']} THEN 'see "note"' || chr(10) || 'line' || chr(9) || 'three' WHEN {d['bad bytes']} THEN 'bad' || chr(65533) END"""])
    counts = {"rows_read": "count(*)", "dropped_null_key": f"count(*) FILTER (kind IN ({d['bad date']}, {d['marker']}))",
              "long_lines": f"count(*) FILTER (kind = {d['long']})", "short_lines": f"count(*) FILTER ({short})",
              "damaged_lines": f"count(*) FILTER (kind = {d['bad bytes']})", "joined_line_breaks": f"count(*) FILTER (kind = {d['line break']})",
              "unclosed_quotes": "0", "bad_dates": f"count(*) FILTER (kind = {d['bad date']})", "bad_numbers": f"count(*) FILTER (kind = {d['bad value']})",
              "rows_in_lake": f"CASE WHEN status = 'loaded' THEN count(*) FILTER (kind NOT IN ({d['bad date']}, {d['marker']})) END",
              "not_inserted": "CASE WHEN status = 'loaded' THEN 0 END"}
    text = " || '|' || ".join(f"CASE WHEN quarter = '{_NO_PRE}' THEN '~' ELSE coalesce(CAST({counts[c]} AS VARCHAR), '~') END" for c in _AUDITED)
    return sql_with("sub", "num", extra=f"""facts AS ({_FIRST_LISTED.format('num')}),
line AS (
  SELECT facts.*, sub.quarter, coalesce(CAST(floor(value) AS BIGINT) % 40, 0) AS kind,
         CASE quarter WHEN '{_NO_PRE}' THEN 'missing files: pre' WHEN '{_NO_CIK}' THEN 'missing required value in sub' ELSE 'loaded' END AS status
  FROM facts JOIN sub ON facts.adsh = sub.adsh)""") + f"""
SELECT 'audit' AS what, quarter, status || '|' || {text} AS row_text FROM line GROUP BY quarter, status
UNION ALL
SELECT 'num', quarter, {row} FROM line
WHERE status = 'loaded' AND kind NOT IN ({d['bad date']}, {d['marker']})"""


def _dirty_lines(num: DataFrame) -> DataFrame:
    """(quarter, value): the text lines of facts, damaged by ``_DIRT``; a header first."""
    kind = F.coalesce(F.floor("value").cast("long") % 40, F.lit(0))

    def when(what: str, bad: Column, good: Column) -> Column:
        return F.when(kind == _DIRT[what], bad).otherwise(good)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    head = [text("adsh"), text("tag"), text("version"), when("bad date", F.lit("20241399"), F.date_format("ddate", "yyyyMMdd")),
            text("qtrs"), when("marker", F.lit("NA"), text("uom"))]
    broken = F.lit('"see ""note""\nline\tthree"')
    note = when("line break", broken, when("bad bytes", F.concat(F.lit("bad"), F.unhex(F.lit("FF")).cast("string")), F.lit("")))
    full = F.concat_ws("\t", *head, text("segments"), text("coreg"), when("bad value", F.lit("abc"), text("value")), note)
    short = (kind == _DIRT["short"]) & (F.col("segments") == "") & (F.col("coreg") == "")
    line = F.when(short, F.concat_ws("\t", *head)).otherwise(when("long", F.concat(full, F.lit("\tone too many")), full))
    lines = num.select("quarter", F.lit(1).alias("o"), line.alias("value"))
    header = num.select("quarter").distinct().select("quarter", F.lit(0).alias("o"), F.lit("\t".join(NUM_COLUMNS)).alias("value"))
    return header.union(lines).repartition("quarter").sortWithinPartitions("quarter", "o", "value").select("quarter", "value")


@_register("ingest_dirty", _dirty_sql())
def ingest_dirty(t):
    """A load of damaged text. Facts have values and dates that
    are none, NULL markers in keys, lines with too many and too few fields, line breaks in quoted fields, bytes
    that are no UTF-8; one quarter has no pre file, one no cik. Returns the audit
    of the facts and every loaded fact with its footnote."""
    from types import SimpleNamespace

    from factlake.operators.upsert import share, shares
    from factlake.plans.ingest import ingest_quarters
    from factlake.session import shuffles_removed
    from factlake.sources.export import COMPRESSED, input_bytes, write_quarter_files
    from factlake.sources.lake import LakeTables, remove
    from factlake.sources.tsv import SPARK_LAYOUT

    spark = t.sub.sparkSession
    work = _load_folder(spark)
    late = t.sub.where(F.col("quarter") == _NO_PRE).select("adsh")
    sub = t.sub.withColumn("cik", F.when(F.col("quarter") != _NO_CIK, F.col("cik")))
    quarters = write_quarter_files(SimpleNamespace(sub=sub, tag=t.tag, num=t.num, pre=t.pre.join(late, "adsh", "left_anti")), f"{work}/raw", ("sub", "tag", "pre"))
    n = shares(input_bytes(t.num))
    for i in range(n):
        # dealt by filing, the facts meet their keys and their filings in one shuffle
        facts = (share(t.num, i, n).repartition("adsh").groupBy(*NUM_KEY).agg(F.max("value").alias("value"))
                 .join(share(t.sub.select("adsh", "quarter"), i, n), "adsh"))
        with shuffles_removed(spark):
            _dirty_lines(facts).write.mode("append" if i else "overwrite").partitionBy("quarter").options(**COMPRESSED).text(f"{work}/raw/num")
    res = ingest_quarters(spark, f"{work}/raw", f"{work}/lake", quarters, layout=SPARK_LAYOUT, staged=lambda: remove(spark, f"{work}/raw"))
    counts = F.concat_ws("|", "status", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in _AUDITED])
    audit = res.audit.where("table_name = 'num'").select(F.lit("audit").alias("what"), "quarter", counts.alias("row_text"))
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [*NUM_KEY, "value", "footnote"]])
    return audit.union(LakeTables(spark, f"{work}/lake").num.select(F.lit("num"), "quarter", row))


_COUNTS_SQL = sql_with("sub", "num", "pre", "tag", extra=f"facts AS ({_FIRST_LISTED.format('num')})") + """
SELECT 'sub' AS table_name, count(*) AS n_rows, min(filed) AS lo_date, max(filed) AS hi_date FROM sub
UNION ALL
SELECT 'num', count(*), min(ddate), max(ddate) FROM facts WHERE adsh IN (SELECT adsh FROM sub)
UNION ALL
SELECT 'pre', count(*), NULL, NULL FROM pre WHERE adsh IN (SELECT adsh FROM sub)
UNION ALL
SELECT 'tag', count(*), NULL, NULL FROM tag
WHERE EXISTS (FROM num n, sub s WHERE n.adsh = s.adsh AND n.tag = tag.tag AND n.version = tag.version)"""


@_register("lake_statistics", _COUNTS_SQL)
def lake_statistics(t):
    """Rows and date bounds of a loaded lake's tables, from its manifest alone."""
    from factlake.sources.lake import table_counts

    spark = t.sub.sparkSession
    work = _load_folder(spark)
    _loaded(spark, work, t, "raw")
    return table_counts(spark, f"{work}/lake")


_SKETCH_SQL = sql_with("sub") + """
SELECT form, count(DISTINCT cik) AS companies, count(DISTINCT adsh) AS filings, true AS within_bound
FROM sub GROUP BY form"""


@_register("distinct_sketches", _SKETCH_SQL)
def distinct_sketches_q(t):
    """A5: distinct companies and filings by form from sketches of the quarters, beside the exact
    counts: whether they are within the stated bound."""
    from factlake.operators.sketches import ERROR_BOUND, distinct_sketches, merged_counts

    cols = ["cik", "adsh"]
    by_quarter = merged_counts(distinct_sketches(t.sub, ["form", "quarter"], cols), ["form"], cols)
    exact = t.sub.groupBy("form").agg(F.countDistinct("cik").alias("companies"), F.countDistinct("adsh").alias("filings"))
    near = [F.abs(F.col(a) - F.col(n)) <= F.greatest(F.col(n) * ERROR_BOUND, F.lit(1)) for a, n in (("m_cik", "companies"), ("m_adsh", "filings"))]
    merged = by_quarter.select("form", *[F.col(c).alias(f"m_{c}") for c in cols])
    return exact.join(merged, "form").select("form", "companies", "filings", (near[0] & near[1]).alias("within_bound"))


def operator_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def operator_sql() -> dict[str, str]:
    return dict(_SQL)
