"""Filing ingest, snapshots and redisclosure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.config import (
    BALANCE_FIELDS, BALANCE_RATIOS, BASIS_PREFIX, CONCEPTS, FIELDS, FILING_META, FUNDAMENTAL_FEATURES, GROWTH, RATIOS,
)
from pitline.operators import snapshots as snap
from pitline.plans.market import rounded
from pitline.plans.registry import Tables, query
from pitline.plans.sql import R, cte, sdiv
from pitline.sources import charts, facts

META = ", ".join(FILING_META)

# ---- SQL views -------------------------------------------------------------------------------------
_ratio = []
for basis, prefix in BASIS_PREFIX.items():
    for name, num in RATIOS.items():
        _ratio.append(f"CASE WHEN data_period_type = '{basis}' THEN {sdiv(num, 'revenue')} END AS {prefix}_{name}")
_ratio += [f"{sdiv(n, d)} AS {name}" for name, (n, d) in BALANCE_RATIOS.items()]
cte("elig", "SELECT *, form LIKE '%/A' AS amended FROM filings WHERE data_period_type IN ('quarterly', 'annual')")
cte("elig_ratio", f"SELECT *, {', '.join(_ratio)} FROM elig")
_key = "symbol, accession, period_start, period_end, data_period_type"
_akey = ", ".join(f"a.{c.strip()}" for c in _key.split(","))
_same = "a.symbol = b.symbol AND a.data_period_type = b.data_period_type AND a.fiscal_period = b.fiscal_period AND b.filing_date <= a.filing_date"
cte(
    "yoy_now",
    f"""SELECT {_akey}, count(DISTINCT (b.period_start, b.period_end)) AS n_now
FROM elig a JOIN elig b ON {_same} AND a.fiscal_year = b.fiscal_year GROUP BY ALL""",
)
cte(
    "yoy_before",
    f"""SELECT *, count(*) OVER (PARTITION BY {_key}) AS n_rows FROM (
SELECT {_akey}, {', '.join(f'b.{c} AS r_{c}' for c in (*FILING_META, *GROWTH.values()))},
  (SELECT count(DISTINCT (p.period_start, p.period_end)) FROM elig p WHERE p.symbol = a.symbol AND p.data_period_type = a.data_period_type
     AND p.fiscal_period = a.fiscal_period AND p.fiscal_year = a.fiscal_year - 1 AND p.filing_date <= a.filing_date) AS n_before,
  row_number() OVER (PARTITION BY {_akey} ORDER BY b.filing_date DESC, b.period_end DESC, b.amended DESC, b.period_start DESC, b.accession DESC) AS rn
FROM elig a JOIN elig b ON {_same} AND a.fiscal_year = b.fiscal_year + 1) WHERE rn = 1""",
)
_status = """CASE WHEN n_now > 1 THEN 'ambiguous_current_period' WHEN n_before IS NULL THEN 'missing_previous_period'
 WHEN n_before > 1 THEN 'ambiguous_previous_period'
 WHEN NOT (period_start - r_period_start BETWEEN 330 AND 400 AND period_end - r_period_end BETWEEN 330 AND 400) OR r_period_end >= period_start
 THEN 'noncomparable_period_dates' ELSE 'available' END"""
_growth = [
    f"CASE WHEN status = 'available' AND data_period_type = '{basis}' THEN {sdiv(field, 'r_' + field, True)} END AS {prefix}_{name}_growth_yoy"
    for basis, prefix in BASIS_PREFIX.items()
    for name, field in GROWTH.items()
]
_refs = ", ".join(f"CASE WHEN status = 'available' THEN r_{c} END AS yoy_reference_{c}" for c in FILING_META)
cte(
    "snaps",
    f"""SELECT * EXCLUDE (status), status AS yoy_comparison_status, {', '.join(_growth)}, {_refs}
FROM (SELECT e.*, n.n_now, b.* EXCLUDE ({_key}), {_status} AS status FROM elig_ratio e JOIN yoy_now n USING ({_key})
      LEFT JOIN yoy_before b USING ({_key}))""",
)
def concept_sql(field: str, table: str = "") -> str:
    """Concept that a filing discloses a field under: revenue changes its concept by fiscal year."""
    names = CONCEPTS[field][0]
    return f"CASE WHEN {table}fiscal_year % 2 = 1 THEN '{names[1]}' ELSE '{names[0]}' END" if field == "revenue" else f"'{names[0]}'"


_unpivoted = " UNION ALL ".join(
    f"""SELECT symbol, {concept_sql(f)} AS concept, '{unit}' AS unit, '{f}' AS field, {'NULL::DATE' if basis == 'instant' else 'period_start'} AS start,
 period_end AS "end", {f} AS val, accession AS accn, fiscal_year AS fy, CASE WHEN form = '10-K' THEN 'FY' ELSE fiscal_period END AS fp,
 form, filing_date AS filed, data_period_type FROM filings WHERE {f} IS NOT NULL {"AND data_period_type NOT IN ('annual', 'ytd')" if basis == 'instant' else ''}"""
    for f, (cs, unit, basis) in CONCEPTS.items()
)
cte("own_facts", _unpivoted)
_fc = 'symbol, concept, unit, start, "end", val, accn, fy, fp, form, filed'
cte(
    "facts_v",
    f"""SELECT {_fc} FROM own_facts
UNION ALL SELECT symbol, 'Revenues', unit, start, "end", val + 1, accn, fy, fp, form, filed FROM own_facts WHERE field = 'revenue'
UNION ALL SELECT {_fc} FROM own_facts WHERE field = 'gross_profit' AND val > 400000
UNION ALL SELECT symbol, concept, unit, start, "end", val - 1, accn, fy, fp, form, filed FROM own_facts WHERE field = 'net_income' AND val < 0
UNION ALL SELECT symbol, concept, unit, start, "end", val, accn, fy, fp, '8-K', filed FROM own_facts WHERE field = 'revenue' AND form = '10-Q/A'
UNION ALL SELECT symbol, concept, unit, start, "end", val, accn, fy, fp, form, "end" - 1 FROM own_facts WHERE field = 'revenue' AND form = '10-K'
UNION ALL SELECT n.symbol, p.concept, n.unit, p.start, p."end", CASE WHEN p.val > 600000 THEN p.val + 5 ELSE p.val END, n.accn, n.fy, n.fp, n.form, n.filed
  FROM own_facts n JOIN own_facts p ON n.symbol = p.symbol AND n.fy = p.fy + 1 AND n.fp = p.fp AND n.field = 'revenue' AND p.field = 'revenue'
   AND n.form = '10-Q' AND p.form = '10-Q' AND n.data_period_type = 'quarterly' AND p.data_period_type = 'quarterly'""",
)


# ---- queries ---------------------------------------------------------------------------------------
@query("derived_filings", "P4", f"SELECT symbol, {META}, {', '.join(FIELDS)} FROM filings")
def _(t: Tables):
    return t.filings


@query("derived_facts", "S5", f"SELECT {_fc} FROM facts_v")
def _(t: Tables):
    return t.facts


_conf = "net_income < 0"
_fields_in = ", ".join(f"CASE WHEN {_conf} THEN NULL ELSE {f} END AS {f}" if f == "net_income" else f for f in FIELDS)
_concepts_in = ", ".join(
    f"CASE WHEN {f} IS NULL {'OR ' + _conf if f == 'net_income' else ''} THEN NULL ELSE {concept_sql(f)} END AS {f}_concept"
    for f in CONCEPTS
)


@query(
    "facts_to_observations",
    "S5 A2 A3 A4 P5 U2",
    f"""SELECT symbol, {META}, {_fields_in}, {_concepts_in},
(CASE WHEN gross_profit > 400000 THEN 1 ELSE 0 END)::BIGINT AS duplicates_removed,
(CASE WHEN {_conf} THEN 1 ELSE 0 END)::BIGINT AS conflicting_fields FROM filings""",
)
def _(t: Tables):
    docs = facts.build_documents(t.facts)
    return facts.normalise_facts(facts.explode_documents(docs))


@query(
    "fact_issues",
    "S5 A4",
    """SELECT symbol, accession, 'net_income' AS field, 'conflicting_values' AS reason, count(*) AS n FROM filings WHERE net_income < 0 GROUP BY ALL
UNION ALL SELECT symbol, accession, 'revenue', 'invalid_chronology', count(*) FROM filings WHERE form = '10-K' GROUP BY ALL""",
)
def _(t: Tables):
    return facts.fact_issues(t.facts)


@query(
    "comparative_facts_excluded",
    "A3",
    """SELECT symbol, count(*) AS usable_facts, count_if("end" <> latest)::BIGINT AS comparative_facts_excluded
FROM (SELECT *, max("end") OVER (PARTITION BY symbol, accn) AS latest FROM facts_v WHERE form <> '8-K' AND filed >= "end") GROUP BY symbol""",
)
def _(t: Tables):
    return facts.comparative_counts(t.facts)


@query(
    "filing_validation",
    "V3",
    """SELECT f.symbol, count(*) AS observations, 0::BIGINT AS errors, 0::BIGINT AS duplicate_keys FROM filings f GROUP BY f.symbol""",
)
def _(t: Tables):
    f = t.filings
    n = f.groupBy("symbol").agg(F.count(F.lit(1)).alias("observations"))
    e = facts.filing_errors(f).groupBy("symbol").agg(F.count(F.lit(1)).alias("errors"))
    d = facts.duplicate_filings(f).groupBy("symbol").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    out = n.join(e, "symbol", "left").join(d, "symbol", "left")
    return out.na.fill(0, ["errors", "duplicate_keys"])


@query(
    "filing_snapshots",
    "P1 P2 P3 P4 P6 J5 J7 K1 K2",
    f"SELECT symbol, {META}, {', '.join(f'{R(c)} AS {c}' for c in FUNDAMENTAL_FEATURES)}, {', '.join(snap.PROVENANCE)} FROM snaps",
)
def _(t: Tables):
    return rounded(snap.build_snapshots(t.filings), ["symbol", *FILING_META, *snap.PROVENANCE], FUNDAMENTAL_FEATURES)


@query(
    "growth_reference_check",
    "C15 J5",
    f"""SELECT symbol, count(*) AS snapshots, 0::BIGINT AS reference_violations, 0::BIGINT AS unknown_reference_violations,
{', '.join(f'0::BIGINT AS {g}_violations' for g in GROWTH)} FROM elig GROUP BY symbol""",
)
def _(t: Tables):
    return snap.reference_violations(snap.build_snapshots(t.filings), t.filings)


@query(
    "comparison_status_counts",
    "A39",
    "SELECT symbol, yoy_comparison_status, count(*) AS n FROM snaps GROUP BY ALL",
)
def _(t: Tables):
    return snap.build_snapshots(t.filings).groupBy("symbol", "yoy_comparison_status").agg(F.count(F.lit(1)).alias("n"))


_metrics = ("revenue", "gross_profit", "operating_income", "net_income", "research_and_development", "operating_cash_flow")
_rd = " UNION ALL ".join(
    f"""SELECT s.symbol, s.accession AS snapshot_accession, s.period_start AS snapshot_period_start, s.period_end AS snapshot_period_end,
 s.data_period_type AS snapshot_data_period_type, r.accession AS reference_accession, '{m}' AS metric, {concept_sql(m, 'r.')} AS concept,
 r.{m} AS retained, s.filing_date AS cutoff, r.period_start AS start, r.period_end AS "end"
FROM snaps s JOIN filings r ON r.symbol = s.symbol AND r.accession = s.yoy_reference_accession AND r.period_start = s.yoy_reference_period_start
 AND r.period_end = s.yoy_reference_period_end AND r.data_period_type = s.yoy_reference_data_period_type WHERE r.{m} IS NOT NULL {'AND r.net_income >= 0' if m == 'net_income' else ''}"""
    for m in _metrics
)


@query(
    "redisclosed_denominators",
    "J6",
    f"""WITH w AS ({_rd}),
f AS (SELECT *, form LIKE '%/A' AS amended FROM facts_v WHERE form <> '8-K' AND unit = 'USD' AND start IS NOT NULL),
j AS (SELECT w.*, f.filed, f.accn, f.val, rank() OVER (PARTITION BY w.symbol, snapshot_accession, snapshot_period_start, snapshot_period_end,
   snapshot_data_period_type, metric ORDER BY f.filed DESC, f.amended DESC, f.accn DESC, f.form DESC) AS rk
  FROM w JOIN f ON f.symbol = w.symbol AND f.concept = w.concept AND f.start = w.start AND f."end" = w."end" AND f.filed <= w.cutoff)
SELECT symbol, snapshot_accession, snapshot_period_start, snapshot_period_end, snapshot_data_period_type, reference_accession, metric, concept,
 any_value(retained) AS retained, any_value(filed) AS latest_filing_date, any_value(accn) AS latest_accession,
 CASE WHEN min(val) = max(val) THEN min(val) END AS latest_value,
 CASE WHEN min(val) <> max(val) THEN 'conflicting_latest_values' WHEN any_value(retained) <> min(val) THEN 'different' ELSE 'equal' END AS status
FROM j WHERE rk = 1 GROUP BY ALL""",
)
def _(t: Tables):
    return facts.redisclosed(snap.build_snapshots(t.filings), facts.normalise_facts(t.facts), t.facts)


@query(
    "chart_rows",
    "S12 V13",
    """SELECT symbol, date, 1::BIGINT AS bars, volume, false AS ambiguous FROM bars""",
)
def _(t: Tables):
    return charts.chart_session_counts(charts.chart_rows(charts.build_charts(t.bars)))


@query(
    "corporate_actions",
    "S13",
    """SELECT symbol, date, 'dividends' AS event_type, NULL::DOUBLE AS split_ratio, open AS dividend_amount FROM bars WHERE volume >= 90
UNION ALL SELECT symbol, date, 'splits', 2.0::DOUBLE, NULL::DOUBLE FROM bars WHERE high >= low * 2""",
)
def _(t: Tables):
    return charts.corporate_actions(charts.build_charts(t.bars))


