"""Independent SQL formulations (DuckDB dialect) of the registered analyses,
over the same fixture views (as CTEs).

They state each analysis with other means than the DataFrame plans do. The
latest value of a company's year is found by aggregates only: the greatest
(filed, accession number) of the year names the filing, the greatest (date,
version, value) of each of its tags is that tag's value, and the first tag in
the alphabet gives the year's. Neighbouring years come from a list per company,
ranks from counting larger values, the largest facts of a filing from an
ordered list, concentration from the sum of squares over the squared sum.

Shared conventions with the Spark side (SURVEY §5.1): ratios in double,
money percentiles cast to decimal(28,2), ratio percentiles rounded to 6
places, year/day values as INTEGER, ranks as INTEGER, explicit total orders
before every LIMIT.
"""

from __future__ import annotations

from factlake.plans.registry import FIXTURE_PARAMS
from factlake.schema import CONCEPTS, EXPENSE_TAGS
from factlake.sources.fixtures import sql_with


def _in(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


REV = _in(CONCEPTS["revenue"])
CA = "n.qtrs = 4 AND n.uom = 'USD' AND n.segments = '' AND n.coreg = ''"


def _p(name, key):
    return FIXTURE_PARAMS[name][key]


def _facts(tags, where: str = "") -> str:
    """CTE ``fact``: consolidated annual facts of annual reports, with the
    company and fiscal year they speak of."""
    return f"""fact AS (
    SELECT s.cik, CAST(year(n.ddate) AS INTEGER) AS fy, s.filed, n.adsh, n.tag, n.ddate, n.version, n.value
    FROM num n, sub s
    WHERE n.adsh = s.adsh AND s.form IN ('10-K', '10-K/A') AND n.tag IN ({_in(tags)}) AND {CA} {where})"""


def yearly(where: str = "") -> str:
    """CTE ``rev`` (cik, fy, revenue and the filing's sic and name): the revenue
    that the company's latest filing reports for the year."""
    return _facts(CONCEPTS["revenue"], f"AND n.value > 0 {where}") + """,
newest AS (SELECT cik, fy, max(struct_pack(filed := filed, adsh := adsh)) AS f FROM fact GROUP BY cik, fy),
by_tag AS (
    SELECT cik, fy, adsh, tag, max(struct_pack(d := ddate, r := version, v := value)).v AS v
    FROM fact GROUP BY cik, fy, adsh, tag),
rev AS (
    SELECT b.cik, b.fy, any_value(s.sic) AS sic, any_value(s.name) AS name, arg_min(b.v, b.tag) AS revenue
    FROM by_tag b, newest w, sub s
    WHERE w.cik = b.cik AND w.fy = b.fy AND w.f.adsh = b.adsh AND s.adsh = b.adsh
    GROUP BY b.cik, b.fy)"""


def yearly_tags(tags, where: str = "") -> str:
    """CTE ``val`` (cik, fy, tag, value, and the filing's adsh, sic and name): each
    tag's value in the latest filing that has it for the year."""
    return _facts(tags, where) + """,
best AS (
    SELECT cik, fy, tag, max(struct_pack(f := filed, a := adsh, d := ddate, r := version, v := value)) AS b
    FROM fact GROUP BY cik, fy, tag),
val AS (
    SELECT x.cik, x.fy, x.tag, x.b.v AS value, s.adsh, s.sic, s.name FROM best x, sub s WHERE s.adsh = x.b.a)"""


def _f(concept: str) -> str:
    return f"MAX(value) FILTER (WHERE tag IN ({_in(CONCEPTS[concept])}))"


def analysis_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["filings_by_year"] = sql_with("sub") + """
SELECT CAST(year(filed) AS INTEGER) AS filing_year, form, COUNT(*) AS filings
FROM sub GROUP BY 1, 2 ORDER BY filing_year, filings DESC, form"""

    q["sectors"] = sql_with("sub") + """
SELECT sic, COUNT(DISTINCT cik) AS companies, COUNT(*) AS filings
FROM sub WHERE sic IS NOT NULL GROUP BY sic
ORDER BY companies DESC, sic LIMIT 25"""

    q["top_filers"] = sql_with("sub") + """
SELECT cik, MAX(name) AS latest_name, COUNT(*) AS filings, COUNT(DISTINCT form) AS form_types,
       MIN(filed) AS first_filed, MAX(filed) AS last_filed
FROM sub GROUP BY cik ORDER BY filings DESC, cik LIMIT 20"""

    q["top_standard_tags"] = sql_with("num", "tag") + """
SELECT n.tag, COUNT(*) AS occurrences, MAX(t.tlabel) AS sample_label
FROM num n JOIN tag t ON n.tag = t.tag AND n.version = t.version
WHERE t.custom = 0 AND t.abstract = 0
GROUP BY n.tag ORDER BY occurrences DESC, n.tag LIMIT 25"""

    q["revenue_distribution"] = sql_with("sub", "num") + f"""
SELECT CAST(year(n.ddate) AS INTEGER) AS fiscal_year, n.version AS taxonomy_version,
       COUNT(*) AS filings_reporting,
       CAST(quantile_cont(CAST(n.value AS DOUBLE), 0.5) AS DECIMAL(28,2)) AS median_revenue,
       CAST(AVG(n.value) AS DECIMAL(28,2)) AS mean_revenue,
       CAST(SUM(n.value) AS DECIMAL(28,0)) AS total_revenue
FROM num n JOIN sub s USING (adsh)
WHERE s.form = '10-K' AND n.tag IN ({REV}) AND {CA} AND n.value > 0
GROUP BY 1, 2 ORDER BY 1, 2"""

    q["missing_net_income"] = sql_with("sub", "num") + f"""
SELECT CAST(year(s.period) AS INTEGER) AS fiscal_year, COUNT(*) AS filings_missing_ni
FROM sub s
WHERE s.form = '10-K' AND s.period IS NOT NULL
  AND NOT EXISTS (FROM num n WHERE n.adsh = s.adsh AND n.tag IN ({_in(CONCEPTS['net_income_any'])}) AND {CA})
GROUP BY 1 ORDER BY 1"""

    by_company = """,
career AS (SELECT cik, list(struct_pack(fy := fy, v := revenue) ORDER BY fy) AS y FROM rev GROUP BY cik),
year_no AS (SELECT cik, y, unnest(range(1, len(y) + 1)) AS i FROM career)"""
    q["revenue_yoy"] = sql_with("sub", "num", extra=yearly() + by_company) + """
SELECT cik, y[i].fy AS fiscal_year, y[i].v AS revenue,
       CASE WHEN i > 1 THEN y[i - 1].v END AS prior_revenue,
       CASE WHEN i > 1 AND y[i - 1].v <> 0
            THEN CAST(y[i].v - y[i - 1].v AS DOUBLE) / CAST(y[i - 1].v AS DOUBLE) END AS yoy_growth
FROM year_no ORDER BY cik, fiscal_year LIMIT 30"""

    q["revenue_rolling"] = sql_with("sub", "num", extra=yearly() + by_company) + """
SELECT n.cik, any_value(n.y[n.i].fy) AS fiscal_year, any_value(n.y[n.i].v) AS revenue,
       SUM(n.y[k.k].v) AS revenue_3yr_sum, COUNT(*) AS years_in_window
FROM year_no n, (SELECT unnest(range(0, 3)) AS back) b, LATERAL (SELECT n.i - b.back AS k) k
WHERE k.k >= 1
GROUP BY n.cik, n.i ORDER BY n.cik, fiscal_year LIMIT 30"""

    y0, y1 = _p("top_by_sector", "years")
    q["top_by_sector"] = sql_with("sub", "num", extra=yearly("AND s.sic IS NOT NULL")) + f"""
SELECT r.sic, r.fy AS fiscal_year, CAST(count(o.cik) + 1 AS INTEGER) AS sector_rank, r.cik, r.name, r.revenue
FROM rev r LEFT JOIN rev o ON o.sic = r.sic AND o.fy = r.fy AND o.revenue > r.revenue
WHERE r.fy BETWEEN {y0} AND {y1} AND r.sic IN (2834, 7372, 6022, 7370, 1311)
GROUP BY ALL HAVING count(o.cik) < 5
ORDER BY r.sic, fiscal_year, sector_rank, r.cik"""

    mc = FIXTURE_PARAMS["margin_compression"]
    q["margin_compression"] = sql_with(
        "sub", "num", extra=yearly_tags(CONCEPTS["revenue"] + CONCEPTS["cogs"], "AND n.value > 0") + f""",
year_margin AS (
    SELECT cik, fy, MAX(name) AS name, {_f('revenue')} AS revenue, {_f('cogs')} AS cogs
    FROM val GROUP BY cik, fy HAVING {_f('revenue')} IS NOT NULL AND {_f('cogs')} IS NOT NULL),
margin AS (SELECT *, CAST(revenue - cogs AS DOUBLE) / CAST(revenue AS DOUBLE) AS gm FROM year_margin)""") + f"""
SELECT now.cik, now.name, now.fy AS fiscal_year, now.revenue, now.gm AS gross_margin,
       arg_max(old.gm, old.fy) AS prior_margin, now.gm - arg_max(old.gm, old.fy) AS margin_change_pp
FROM margin now JOIN margin old ON old.cik = now.cik AND old.fy < now.fy
WHERE now.fy = {mc['year']} AND now.revenue > {int(mc['min_revenue'])}
GROUP BY now.cik, now.name, now.fy, now.revenue, now.gm
ORDER BY margin_change_pp ASC, now.cik LIMIT 20"""

    q["restatement_pairs"] = sql_with("sub") + """
SELECT o.cik, o.name, o.period, o.filed AS filed_original, a.filed AS filed_amended,
       CAST(a.filed - o.filed AS INTEGER) AS days_between,
       o.adsh AS adsh_original, a.adsh AS adsh_amended
FROM sub o JOIN sub a ON a.cik = o.cik AND a.period = o.period AND a.filed > o.filed
WHERE o.form = '10-K' AND a.form = '10-K/A' AND o.period IS NOT NULL
  AND a.filed - o.filed BETWEEN 1 AND 1095
ORDER BY days_between DESC, o.cik, o.period, adsh_original, adsh_amended LIMIT 25"""

    ciks = _in(FIXTURE_PARAMS["top_expenses"]["ciks"])
    q["top_expenses"] = sql_with("sub", "num") + f"""
SELECT name, fy, e.t AS tag, e.v AS value
FROM (
    SELECT any_value(f.name) AS name, CAST(year(any_value(f.period)) AS INTEGER) AS fy,
           unnest(list(struct_pack(v := n.value, t := n.tag) ORDER BY n.value DESC, n.tag, n.version)[1:3]) AS e
    FROM num n, sub f
    WHERE f.adsh = n.adsh AND n.ddate = f.period AND f.form = '10-K' AND f.cik IN ({ciks})
      AND n.tag IN ({_in(EXPENSE_TAGS)}) AND {CA} AND n.value > 0
    GROUP BY n.adsh)
ORDER BY name, fy DESC, value DESC, tag"""

    hp = FIXTURE_PARAMS["hhi_concentration"]
    q["hhi_concentration"] = sql_with("sub", "num", extra=yearly("AND s.sic IS NOT NULL") + f""",
sector AS (
    SELECT sic, fy, COUNT(*) AS firm_count, SUM(revenue) AS sector_revenue,
           10000 * SUM(CAST(revenue AS DOUBLE) * CAST(revenue AS DOUBLE))
             / (CAST(SUM(revenue) AS DOUBLE) * CAST(SUM(revenue) AS DOUBLE)) AS h
    FROM rev WHERE fy = {hp['fy']} GROUP BY sic, fy)""") + f"""
SELECT sic, fy, firm_count, sector_revenue, CAST(h AS DECIMAL(8,1)) AS hhi,
       -- fixed values: the labels and their cuts
       CASE WHEN h > 2500 THEN 'highly concentrated' WHEN h > 1500 THEN 'moderately concentrated'
            ELSE 'competitive' END AS concentration_label
FROM sector WHERE firm_count >= {hp['min_firms']}
ORDER BY hhi DESC, sic LIMIT 25"""

    ep = FIXTURE_PARAMS["etr_dispersion"]
    q["etr_dispersion"] = sql_with(
        "sub", "num",
        extra=yearly_tags(CONCEPTS["pretax_income"] + CONCEPTS["income_tax"], "AND s.sic IS NOT NULL")) + f"""
SELECT sic, fy, firms, ROUND(qs[1], 6) AS p25_etr, ROUND(qs[2], 6) AS median_etr,
       ROUND(qs[3], 6) AS p75_etr, ROUND(qs[3] - qs[1], 6) AS iqr
FROM (
    SELECT sic, fy, COUNT(*) AS firms, quantile_cont(rate, [0.25, 0.5, 0.75]) AS qs
    FROM (
        SELECT sic, fy, CAST(tax AS DOUBLE) / NULLIF(CAST(pretax AS DOUBLE), 0) AS rate
        FROM (SELECT cik, sic, fy, {_f('pretax_income')} AS pretax, {_f('income_tax')} AS tax
              FROM val GROUP BY cik, sic, fy) p
        WHERE pretax > 1000000 AND tax IS NOT NULL) r
    WHERE fy = {ep['fy']} AND rate BETWEEN -1 AND 1
    GROUP BY sic, fy HAVING COUNT(*) >= {ep['min_firms']}) d
ORDER BY qs[3] - qs[1] DESC, sic LIMIT 20"""

    q["cash_conversion"] = sql_with(
        "sub", "num", extra=yearly_tags(CONCEPTS["cfo"] + CONCEPTS["net_income"])
    ) + f"""
SELECT cik, name, years_with_data,
       CAST(ROUND(avg_c, 9) AS DECIMAL(10,3)) AS avg_conversion,
       CAST(min_c AS DECIMAL(10,3)) AS min_conversion,
       CAST(max_c AS DECIMAL(10,3)) AS max_conversion
FROM (
    SELECT cik, MAX(name) AS name, COUNT(*) AS years_with_data,
           AVG(conv) AS avg_c, MIN(conv) AS min_c, MAX(conv) AS max_c
    FROM (
        SELECT cik, name, CAST(cfo AS DOUBLE) / NULLIF(CAST(ni AS DOUBLE), 0) AS conv
        FROM (SELECT cik, MAX(name) AS name, fy, {_f('cfo')} AS cfo, {_f('net_income')} AS ni
              FROM val GROUP BY cik, fy) p
        WHERE cfo IS NOT NULL AND ni IS NOT NULL AND ni > 50000000) r
    WHERE conv BETWEEN 0 AND 5
    GROUP BY cik HAVING COUNT(*) >= 4) c
ORDER BY avg_conversion DESC, cik LIMIT 25"""

    ip = FIXTURE_PARAMS["income_statement_wide"]
    names = ["revenue", "cogs", "gross_profit", "rd", "sga", "op_income", "net_income"]
    tags = [tg for n in names for tg in CONCEPTS[n]]
    q["income_statement_wide"] = sql_with(
        "sub", "num",
        extra=yearly_tags(tags, f"AND n.value IS NOT NULL AND s.cik IN ({_in(ip['ciks'])})")) + f"""
SELECT MAX(name) AS name, fy,
       {', '.join(f'CAST({_f(n)} AS DECIMAL(28,0)) AS {n}' for n in names)}
FROM val WHERE fy = {ip['fy']}
GROUP BY cik, fy ORDER BY revenue DESC NULLS FIRST, name"""

    fp = FIXTURE_PARAMS["fcf_margin"]
    q["fcf_margin"] = sql_with(
        "sub", "num",
        extra=yearly_tags(CONCEPTS["revenue"] + CONCEPTS["cfo"] + CONCEPTS["capex"])) + f"""
SELECT cik, name, sic, fy,
       CAST(revenue AS DECIMAL(28,0)) AS revenue, CAST(cfo AS DECIMAL(28,0)) AS cfo,
       CAST(capex AS DECIMAL(28,0)) AS capex, CAST(cfo - capex AS DECIMAL(28,0)) AS fcf,
       CAST(CAST(cfo - capex AS DOUBLE) / NULLIF(CAST(revenue AS DOUBLE), 0) AS DECIMAL(10,4)) AS fcf_margin
FROM (SELECT cik, MAX(name) AS name, MAX(sic) AS sic, fy, {_f('revenue')} AS revenue,
             {_f('cfo')} AS cfo, {_f('capex')} AS capex
      FROM val GROUP BY cik, fy) p
WHERE fy = {fp['fy']} AND revenue > {int(fp['min_revenue'])}
  AND cfo IS NOT NULL AND capex IS NOT NULL
ORDER BY fcf_margin DESC NULLS LAST, cik LIMIT 25"""

    q["filing_lag"] = sql_with("sub") + """
SELECT afs, CAST(year(period) AS INTEGER) AS period_year, COUNT(*) AS filings,
       quantile_cont(CAST(filed - period AS DOUBLE), 0.25) AS p25_days,
       quantile_cont(CAST(filed - period AS DOUBLE), 0.50) AS median_days,
       quantile_cont(CAST(filed - period AS DOUBLE), 0.75) AS p75_days,
       quantile_cont(CAST(filed - period AS DOUBLE), 0.95) AS p95_days,
       COUNT(*) FILTER (WHERE filed - period > 90) AS late_filings
FROM sub
WHERE form = '10-K' AND period IS NOT NULL AND afs IS NOT NULL
  AND filed - period BETWEEN 1 AND 365
GROUP BY afs, period_year ORDER BY afs, period_year"""

    sp = FIXTURE_PARAMS["short_lived_filers"]
    q["short_lived_filers"] = sql_with("sub") + f"""
SELECT cik, MAX(name) AS name, MIN(filed) AS first_filing, MAX(filed) AS last_filing,
       CAST(MAX(filed) - MIN(filed) AS INTEGER) AS days_active,
       COUNT(*) AS filing_count, COUNT(DISTINCT form) AS form_types
FROM sub WHERE sic = 6770
GROUP BY cik
HAVING MAX(filed) - MIN(filed) BETWEEN 30 AND {sp['max_days']}
   AND MAX(filed) < DATE '{sp['stopped_before'].isoformat()}'
ORDER BY filing_count DESC, days_active DESC, cik LIMIT 25"""

    tp = FIXTURE_PARAMS["top5_share_shift"]
    a, b = tp["y0"], tp["y1"]
    q["top5_share_shift"] = sql_with("sub", "num", extra=yearly("AND s.sic IS NOT NULL") + f""",
sized AS (
    SELECT sic, fy, COUNT(*) AS firms, SUM(revenue) AS total, list_reverse_sort(list(revenue)) AS v
    FROM rev WHERE fy IN ({a}, {b}) GROUP BY sic, fy
    HAVING SUM(revenue) > {int(tp['min_total'])} AND COUNT(*) >= {tp['min_firms']}),
led AS (
    SELECT z.sic, z.fy, z.firms, z.total,
           CAST(SUM(r.revenue) AS DOUBLE) / CAST(z.total AS DOUBLE) AS share
    FROM sized z, rev r WHERE r.sic = z.sic AND r.fy = z.fy AND r.revenue >= z.v[least(5, z.firms)]
    GROUP BY z.sic, z.fy, z.firms, z.total)""") + f"""
SELECT sic, any_value(firms) FILTER (fy = {a}) AS firms_{a}, any_value(firms) FILTER (fy = {b}) AS firms_{b},
       CAST(any_value(total) FILTER (fy = {a}) AS DECIMAL(28,0)) AS total_{a},
       CAST(any_value(total) FILTER (fy = {b}) AS DECIMAL(28,0)) AS total_{b},
       CAST(any_value(share) FILTER (fy = {a}) AS DECIMAL(6,4)) AS top5_share_{a},
       CAST(any_value(share) FILTER (fy = {b}) AS DECIMAL(6,4)) AS top5_share_{b},
       CAST(any_value(share) FILTER (fy = {b}) - any_value(share) FILTER (fy = {a}) AS DECIMAL(6,4)) AS share_change
FROM led GROUP BY sic HAVING COUNT(*) = 2
ORDER BY abs(any_value(share) FILTER (fy = {b}) - any_value(share) FILTER (fy = {a})) DESC, sic LIMIT 25"""
    return q
