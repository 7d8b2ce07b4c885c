"""Vintage comparison, probes, governance and assessment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.config import BALANCE_FIELDS, BAR_COLUMNS, FIELDS, HORIZONS, MARKET_FEATURES, PRICE_COLUMNS, STREAM_FEATURES
from pitline.functions.dates import is_plain_date, strict_date
from pitline.functions.numeric import is_close, is_integral_count
from pitline.operators import audits as aud
from pitline.operators import bars as bar_ops
from pitline.operators import compare as cmp
from pitline.operators import labels as lab
from pitline.operators import metrics as met
from pitline.operators import models as mod
from pitline.operators import pit
from pitline.operators import profile as prof
from pitline.operators import rolling
from pitline.operators import splits
from pitline.operators import stability as stab
from pitline.plans.market import rounded
from pitline.plans.models import ARMS1, NAMES1, PAIRS, SINGLE, SLOPE, Study, cv1, metric_sql, walk1
from pitline.plans.registry import Tables, query
from pitline.plans.sql import CTES, R, cte
from pitline.sources import charts

KEY = ["symbol", "date"]
OUT = (*MARKET_FEATURES, *aud.RETURNS)


def vintage_b(bars: DataFrame) -> DataFrame:
    """A second vintage: heavy days gain one unit of volume, wide days close halfway to their high."""
    return bars.withColumns(
        {
            "volume": F.when(F.col("volume") >= 95, F.col("volume") + 1).otherwise(F.col("volume")),
            "close": F.when(F.col("high") >= F.col("low") * 2.5, (F.col("close") + F.col("high")) / 2).otherwise(F.col("close")),
        }
    )


# ---- SQL views -------------------------------------------------------------------------------------
cte(
    "bars_b",
    """SELECT symbol, date, open, high, low, CASE WHEN high >= low * 2.5 THEN (close + high) / 2 ELSE close END AS close,
 CASE WHEN volume >= 95 THEN volume + 1 ELSE volume END AS volume FROM bars""",
)
START_B = "1997-01-01"
cte("bars_late", f"SELECT * FROM bars WHERE date >= DATE '{START_B}'")
cte("features_late", CTES["features"].replace("FROM bars WINDOW", "FROM bars_late WINDOW"))


# ---- table comparison ------------------------------------------------------------------------------
_dc = BAR_COLUMNS[1:]


@query(
    "vintage_cell_diff",
    "C1 J15 U4",
    "SELECT * FROM (SELECT '__rows__' AS \"column\", 0::BIGINT AS changed_cells UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', count_if(a.{c} IS DISTINCT FROM b.{c})::BIGINT FROM bars a JOIN bars_b b USING (symbol, date)" for c in _dc)
    + ")",
)
def _(t: Tables):
    return cmp.exact_diff(t.bars, vintage_b(t.bars).select(t.bars.columns), KEY)


@query(
    "vintage_changed_cells",
    "C1 J15",
    " UNION ALL ".join(
        f"SELECT a.symbol, a.date, '{c}' AS field, {R(f'a.{c}', 4)} AS old_value, {R(f'b.{c}', 4)} AS new_value FROM bars a JOIN bars_b b USING (symbol, date) WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in _dc
    ),
)
def _(t: Tables):
    from pitline.functions.numeric import rnd

    c = cmp.changed_cells(t.bars, vintage_b(t.bars), KEY, list(_dc))
    return c.select("symbol", "date", "field", *[rnd(F.col(v).cast("double"), 4).alias(v) for v in ("old_value", "new_value")])


@query(
    "session_set_difference",
    "J11 U4",
    f"SELECT symbol, date, 'only_new' AS side FROM bars WHERE date < DATE '{START_B}'",
)
def _(t: Tables):
    return cmp.session_differences(t.bars.filter(F.col("date") >= START_B), t.bars)


_fp_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
_fp_txt = " || '|' || ".join(f"coalesce({c}::VARCHAR, '~')" for c in _fp_cols)


@query(
    "table_fingerprint",
    "C3",
    f"""SELECT l_returnflag, count(*) AS row_count, sum(('0x' || substr(md5({_fp_txt}), 1, 8))::BIGINT)::VARCHAR AS digest, {', '.join(f'count_if({c} IS NULL)::BIGINT AS null_{c}' for c in _fp_cols)}
FROM lineitem GROUP BY l_returnflag""",
)
def _(t: Tables):
    f = cmp.fingerprint(t.lines, _fp_cols, ["l_returnflag"], "md5")
    return f.withColumn("digest", F.col("digest").cast("string"))


@query(
    "vintage_gate",
    "C4",
    """SELECT a.symbol AS vintage, CASE WHEN a.symbol LIKE '%9' THEN 'not_approved' WHEN b.changed > 0 THEN 'fingerprint_mismatch' ELSE 'accepted' END AS decision
FROM (SELECT DISTINCT symbol FROM bars) a JOIN (SELECT symbol, count_if(x.close IS DISTINCT FROM y.close OR x.volume <> y.volume) AS changed
 FROM bars x JOIN bars_b y USING (symbol, date) GROUP BY symbol) b USING (symbol)""",
)
def _(t: Tables):
    cols = ["date", *_dc]
    now = cmp.fingerprint(vintage_b(t.bars), cols, ["symbol"]).withColumnRenamed("symbol", "vintage")
    reg = cmp.fingerprint(t.bars, cols, ["symbol"]).select(
        F.col("symbol").alias("vintage"), (~F.col("symbol").endswith("9")).alias("approved"),
        F.array(*[F.lit(c) for c in MARKET_FEATURES]).alias("features"), F.array(F.lit("forward_return_5d")).alias("targets"), "row_count", "digest",
    )
    return cmp.vintage_gate(now, reg, MARKET_FEATURES, "forward_return_5d")


_ov = []
for _c in ("close", "volume"):
    _ov.append(f"SELECT '{_c}' AS field, count(*) AS overlap_cells, count(*) AS exact_matches, 0::BIGINT AS tolerant_matches, 0::BIGINT AS explained_differences, 0::BIGINT AS unexpected_differences FROM bars_late")
for _c in MARKET_FEATURES:
    _ov.append(
        f"""SELECT '{_c}', count(*), count_if(a.{_c} IS NOT DISTINCT FROM b.{_c} OR abs(a.{_c} - b.{_c}) <= 1e-9)::BIGINT, 0::BIGINT, count_if(a.{_c} IS NULL AND b.{_c} IS NOT NULL)::BIGINT, 0::BIGINT
FROM features_late a JOIN features b USING (symbol, date)"""
    )


@query("vintage_overlap", "C2", f"SELECT * FROM ({' UNION ALL '.join(_ov)})")
def _(t: Tables):
    old = rolling.build_features(t.bars.filter(F.col("date") >= START_B))
    o = cmp.overlap_audit(old, t.features, ["close", "volume"], list(MARKET_FEATURES), [])
    # window sums may differ in the last bit; both kinds count as a match here
    return o.select("field", "overlap_cells", (F.col("exact_matches") + F.col("tolerant_matches")).alias("exact_matches"), F.lit(0).cast("bigint").alias("tolerant_matches"), "explained_differences", "unexpected_differences")


_ef = ("effective_date", "effective_date_basis", "effective_date_is_sample_truncated", "days_since_effective_date")


@query(
    "state_overlap",
    "C2",
    f"""WITH late AS (SELECT b.symbol, b.date, s.first_date FROM bars_late b JOIN (SELECT symbol, min(date) AS first_date FROM bars_late GROUP BY symbol) s USING (symbol)),
o AS (SELECT d.symbol, d.date, d.q_accession, d.q_filing_date, d.q_effective_date, l.first_date,
  d.q_filing_date < l.first_date AS trunc_old FROM late l JOIN daily_v d USING (symbol, date)),
x AS (SELECT count(*) AS n, count_if(q_accession IS NOT NULL AND trunc_old AND q_effective_date < first_date)::BIGINT AS moved,
  count_if(q_accession IS NOT NULL AND trunc_old)::BIGINT AS relabelled FROM o)
{' UNION ALL '.join(f"SELECT 'q_{c}' AS field, n AS overlap_cells, n - {'moved' if c in ('effective_date', 'days_since_effective_date') else 'relabelled'} AS exact_matches, 0::BIGINT AS tolerant_matches, {'moved' if c in ('effective_date', 'days_since_effective_date') else 'relabelled'} AS explained_differences, 0::BIGINT AS unexpected_differences FROM x" for c in _ef)}""",
)
def _(t: Tables):
    late = t.bars.filter(F.col("date") >= START_B).select(*KEY)
    old = pit.attach_states(late, t.snapshots, ("q",))
    new = pit.attach_states(t.bars.select(*KEY), t.snapshots, ("q",))
    return cmp.overlap_audit(old, new, [], [], ["q"])


_layers = ["raw_prints", "standardised", "bars", "features"]


def trace(t: Tables) -> DataFrame:
    """Daily volume at four stages of two lineages; the legacy raw stage is lost for single-unit days."""
    raw = t.lines.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").cast("bigint").alias("value")
    )
    kept = F.when(F.col("value") >= 2, F.col("value"))
    out = raw.select(*KEY, F.inline(F.array(
        F.struct(F.lit("legacy").alias("side"), F.lit("raw_prints").alias("layer"), kept.alias("value"), kept.isNotNull().alias("available")),
        F.struct(F.lit("expanded").alias("side"), F.lit("raw_prints").alias("layer"), F.col("value").alias("value"), F.lit(True).alias("available")),
    )))
    for side, frame in (("legacy", vintage_b(t.bars)), ("expanded", t.bars)):
        later = F.array(*[F.lit(x) for x in _layers[1:]])
        out = out.unionByName(frame.select(*KEY, F.lit(side).alias("side"), F.explode(later).alias("layer"), F.col("volume").alias("value"), F.lit(True).alias("available")))
    return out


@query(
    "first_divergence",
    "C5",
    """SELECT symbol, date, CASE WHEN volume >= 95 THEN 'standardised' END AS first_observed_divergence_layer,
 CASE WHEN volume < 2 THEN 1 ELSE 0 END::INTEGER AS missing_earlier_layers, volume >= 95 AS cause_identified,
 CASE WHEN volume >= 95 THEN 'standardised' END AS first_divergence_layer FROM bars""",
)
def _(t: Tables):
    return cmp.first_divergence(trace(t), _layers, KEY)


@query(
    "lineage_propagation",
    "C5",
    """SELECT 'legacy' AS side, count_if(volume >= 2) + 2 * count(*) AS edges_checked, count_if(volume >= 95)::BIGINT AS propagation_violations FROM bars
UNION ALL SELECT 'expanded', 3 * count(*), 0::BIGINT FROM bars""",
)
def _(t: Tables):
    return cmp.propagation(trace(t), _layers, KEY)


@query(
    "trace_validity",
    "C5",
    "SELECT unnest(['legacy', 'expanded']) AS side, 0::BIGINT AS layer_violations, 0::BIGINT AS fabricated_values",
)
def _(t: Tables):
    return cmp.trace_validity(trace(t), _layers, KEY)


# ---- calendar and corporate actions ----------------------------------------------------------------
def _easter(y: str) -> str:
    return f"""(SELECT make_date({y}::INTEGER, (d // 31)::INTEGER, (d % 31 + 1)::INTEGER) FROM (SELECT h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS d FROM
 (SELECT a, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - (c % 4)) % 7 AS m, b FROM (SELECT {y} % 19 AS a, {y} // 100 AS b, {y} % 100 AS c,
  (19 * ({y} % 19) + {y} // 100 - ({y} // 100) // 4 - (8 * ({y} // 100) + 13) // 25 + 15) % 30 AS h))))"""


def _near(m: int, d: int) -> str:
    return f"(month(date) = {m} AND ((day(date) = {d} AND dayofweek(date) NOT IN (0, 6)) OR (day(date) = {d - 1} AND dayofweek(date) = 5) OR (day(date) = {d + 1} AND dayofweek(date) = 1)))"


cte("easters", f"SELECT y, {_easter('y')} AS easter FROM (SELECT unnest(range(1990, 2010)) AS y)")
cte(
    "exchange_days",
    f"""SELECT date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY))::DATE AS date) JOIN easters ON y = year(date)
WHERE dayofweek(date) NOT IN (0, 6) AND NOT ((month(date) = 1 AND day(date) = 1) OR (month(date) = 1 AND day(date) = 2 AND dayofweek(date) = 1)
 OR (month(date) IN (1, 2) AND dayofweek(date) = 1 AND day(date) BETWEEN 15 AND 21) OR date = easter - 2
 OR (month(date) = 5 AND dayofweek(date) = 1 AND day(date) >= 25) OR {_near(7, 4)} OR (month(date) = 9 AND dayofweek(date) = 1 AND day(date) <= 7)
 OR (month(date) = 11 AND dayofweek(date) = 4 AND day(date) BETWEEN 22 AND 28) OR {_near(12, 25)})""",
)


@query(
    "calendar_audit",
    "C9 J11",
    """WITH e AS (SELECT f.symbol, d.date FROM first_session f JOIN exchange_days d ON d.date BETWEEN f.first_date AND f.last_date)
SELECT symbol, count_if(x IS NOT NULL)::BIGINT AS expected_sessions, count_if(y IS NOT NULL)::BIGINT AS observed_sessions,
 count_if(y IS NULL)::BIGINT AS missing_expected_sessions, count_if(x IS NULL)::BIGINT AS unexpected_sessions
FROM (SELECT coalesce(e.symbol, b.symbol) AS symbol, e.date AS x, b.date AS y FROM e FULL JOIN bars b ON b.symbol = e.symbol AND b.date = e.date) GROUP BY symbol""",
)
def _(t: Tables):
    return aud.calendar_audit(t.bars.select(*KEY))


_cx = ", ".join(f"max(abs(r{h})) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING) AS c{h}" for h in HORIZONS)
_cr = ", ".join(f"lead(close, {h}) OVER w / lead(open, 1) OVER w - 1 AS r{h}" for h in HORIZONS)
_px = " AND ".join(f"coalesce(q_{c} BETWEEN 0.5 AND 2, true)" for c in PRICE_COLUMNS)


@query(
    "corporate_action_audit",
    "C8 V12",
    f"""WITH ev AS (SELECT symbol, date, 'dividends' AS event_type FROM bars WHERE volume >= 90 UNION ALL SELECT symbol, date, 'splits' FROM bars WHERE high >= low * 2),
p AS (SELECT *, {_cr}, close / lag(close) OVER w AS close_ratio, open / lag(close) OVER w AS otp, {', '.join(f'{c} / lag({c}) OVER w AS q_{c}' for c in PRICE_COLUMNS)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
q AS (SELECT *, {_cx} FROM p)
SELECT ev.symbol, ev.date, event_type, {R('close_ratio')} AS close_ratio, {R('otp')} AS open_to_prior_close, false AS absent_from_bars, {_px} AS ratios_within_bounds,
 coalesce(event_type = 'splits' AND abs(close_ratio - 0.5) < abs(close_ratio - 1), false) AS inverse_split_jump,
 {R("CASE WHEN event_type = 'splits' THEN greatest(c1, c5, c20) END")} AS max_abs_crossing_return,
 event_type = 'splits' AND coalesce(greatest(c1, c5, c20) > 0.5, false) AS crossing_violation FROM ev JOIN q USING (symbol, date)""",
)
def _(t: Tables):
    a = aud.corporate_audit(t.bars, charts.corporate_actions(charts.build_charts(t.bars)))
    num = ("close_ratio", "open_to_prior_close", "max_abs_crossing_return")
    return rounded(a, [c for c in a.columns if c not in num], num)


# ---- probes ----------------------------------------------------------------------------------------
PROBE_DAY = "1998-06-30"
CHANGES = {
    "open": lambda c: c * 1.01,
    "high": lambda c: c * 1.01,
    "low": lambda c: c * 0.99,
    "close": lambda c: c * 1.01,
    "volume": lambda c: c * 10 + 123,
}
_mut = {"open": "open * 1.01", "high": "high * 1.01", "low": "low * 0.99", "close": "close * 1.01", "volume": "volume * 10 + 123"}
cte("probe_days", f"SELECT symbol, min(date) AS probe_date FROM bars WHERE date >= DATE '{PROBE_DAY}' GROUP BY symbol")
for _f, _e in _mut.items():
    _rest = ", ".join(f"CASE WHEN date = probe_date THEN {_e} ELSE {c} END AS {c}" if c == _f else c for c in BAR_COLUMNS[1:])
    cte(f"bars_m_{_f}", f"SELECT bars.symbol, date, {_rest} FROM bars LEFT JOIN probe_days ON probe_days.symbol = bars.symbol")
    _ret = ", ".join(f"lead(close, {h}) OVER w / lead(open, 1) OVER w - 1 AS forward_return_{h}d" for h in HORIZONS)
    cte(f"out_m_{_f}", f"SELECT *, {_ret} FROM ({CTES['features'].replace('FROM bars WINDOW', f'FROM bars_m_{_f} WINDOW')}) WINDOW w AS (PARTITION BY symbol ORDER BY date)")
cte("out_base", f"SELECT f.*, l.* EXCLUDE (symbol, date) FROM features f JOIN labels_v l USING (symbol, date)")
_probe = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, u.o AS output, u.n AS changed_cells FROM (SELECT unnest([{', '.join(f"{{'o': '{c}', 'n': count_if(abs(a.{c} - b.{c}) > 1e-9)::BIGINT}}" for c in OUT)}]) AS u
FROM out_base a JOIN out_m_{f} b USING (symbol, date))"""
    for f in _mut
)
cte("probe_v", _probe)


def probe(t: Tables) -> DataFrame:
    return aud.dependency_probe(t.bars, PROBE_DAY, CHANGES)


@query("probe_dates", "K7", "SELECT symbol, probe_date FROM probe_days")
def _(t: Tables):
    return aud.first_on_or_after(t.bars, PROBE_DAY)


@query("dependency_probe", "C10", "SELECT field, output, changed_cells > 0 AS depends FROM probe_v")
def _(t: Tables):
    return probe(t).select("field", "output", (F.col("changed_cells") > 0).alias("depends"))


@query(
    "feature_lineage",
    "C18",
    "SELECT output, coalesce(string_agg(CASE WHEN changed_cells > 0 THEN field END, '|' ORDER BY field), '') AS source_fields, coalesce(bool_or(field = 'volume' AND changed_cells > 0), false) AS forbidden FROM probe_v GROUP BY output",
)
def _(t: Tables):
    return aud.scope_violations(aud.lineage(probe(t)), ("volume",))


@query(
    "materiality_and_approval",
    "C6",
    """WITH d AS (SELECT field, bool_or(changed_cells > 0) AS dependent FROM probe_v GROUP BY field),
c AS (SELECT u.f AS field, u.n AS changed_cells FROM (SELECT unnest([{'f': 'open', 'n': count_if(a.open <> b.open)}, {'f': 'high', 'n': count_if(a.high <> b.high)}, {'f': 'low', 'n': count_if(a.low <> b.low)},
 {'f': 'close', 'n': count_if(a.close <> b.close)}, {'f': 'volume', 'n': count_if(a.volume <> b.volume)}]) AS u FROM bars a JOIN bars_b b USING (symbol, date)))
SELECT field, changed_cells::BIGINT AS changed_cells, dependent, CASE WHEN dependent THEN 'MATERIAL_TO_CURRENT_RESEARCH' ELSE 'NONMATERIAL_TO_CURRENT_RESEARCH' END AS materiality,
 CASE WHEN dependent AND changed_cells > 0 THEN 'REJECTED' WHEN changed_cells > 0 THEN 'APPROVED_WITH_QUALIFICATIONS' ELSE 'APPROVED' END AS decision FROM c JOIN d USING (field)""",
)
def _(t: Tables):
    dep = probe(t).groupBy("field").agg(F.max(F.col("changed_cells") > 0).alias("dependent"))
    diff = cmp.exact_diff(t.bars, vintage_b(t.bars).select(t.bars.columns), KEY).withColumnRenamed("column", "field")
    yes = F.lit(True)
    m = diff.join(dep, "field").withColumn("materiality", aud.materiality(F.col("dependent"), F.lit(False), yes, yes, yes, yes))
    harmless = (F.col("changed_cells") == 0) | (F.col("materiality") == "NONMATERIAL_TO_CURRENT_RESEARCH")
    return m.select("field", "changed_cells", "dependent", "materiality", aud.approval(yes, F.col("changed_cells"), harmless).alias("decision"))


CUT = "1999-06-30"


@query(
    "future_bars_probe",
    "C11",
    f"SELECT symbol, count_if(date <= DATE '{CUT}')::BIGINT AS past_sessions, 0::BIGINT AS past_cells_changed, count_if(date > DATE '{CUT}') > 0 AS future_reacts FROM bars GROUP BY symbol",
)
def _(t: Tables):
    return aud.future_bars_probe(t.bars, CUT)


CUTS = ["1996-06-30", "1998-06-30", "2000-06-30"]


@query(
    "prefix_rebuild_probe",
    "C11",
    " UNION ALL ".join(f"SELECT DATE '{c}' AS cutoff, count(DISTINCT symbol) AS rows_checked, 0::BIGINT AS violations FROM bars WHERE date <= DATE '{c}'" for c in CUTS),
)
def _(t: Tables):
    return aud.prefix_probe(t.bars, CUTS)


_watch = ["q_gross_margin", "q_revenue_growth_yoy", "fy_net_margin", "current_ratio", *[f"bs_{c}" for c in BALANCE_FIELDS]]


@query(
    "future_filings_probe",
    "C11",
    f"SELECT symbol, count_if(date <= DATE '{CUT}')::BIGINT AS past_sessions, 0::BIGINT AS past_cells_changed, true AS future_reacts FROM bars GROUP BY symbol",
)
def _(t: Tables):
    from pitline.operators.snapshots import build_snapshots

    market = t.bars.select(*KEY)
    return aud.future_filings_probe(lambda f: pit.attach_states(market, build_snapshots(f)), t.filings, CUT, FIELDS, _watch)


@query(
    "input_order_probe",
    "C11 V6",
    "SELECT '__rows__' AS \"column\", 0::BIGINT AS changed_cells UNION ALL SELECT unnest(['q_accession', 'fy_accession', 'bs_accession', 'q_effective_date', 'q_gross_margin', 'current_ratio']), 0::BIGINT",
)
def _(t: Tables):
    from pitline.operators.snapshots import build_snapshots

    cols = ["q_accession", "fy_accession", "bs_accession", "q_effective_date", "q_gross_margin", "current_ratio"]
    a = pit.attach_states(t.bars.select(*KEY), t.snapshots)
    shuffled = t.filings.repartition(F.xxhash64("accession", "data_period_type"))
    b = pit.attach_states(t.bars.select(*KEY).repartition("date"), build_snapshots(shuffled))
    return cmp.exact_diff(a.select(*KEY, *cols), b.select(*KEY, *cols), KEY)


_ca = " UNION ALL ".join(
    f"""SELECT symbol, '{p}' AS stream, (count(*) * {len(STREAM_FEATURES[p])})::BIGINT AS cells, 0::BIGINT AS unknown_sources, 0::BIGINT AS ineligible_states, 0::BIGINT AS unknown_references,
 0::BIGINT AS value_violations, 0::BIGINT AS values_without_state FROM bars GROUP BY symbol"""
    for p in ("q", "fy", "bs")
)


@query("pit_cell_audit", "C12 V6", f"SELECT * FROM ({_ca})")
def _(t: Tables):
    keys = [f"{p}_{c}" for p in ("q", "fy", "bs") for c in (*cmp.CELL_KEY, "filing_date", "effective_date")]
    daily = t.daily_kept(*keys, *[c for p in ("q", "fy", "bs") for c in STREAM_FEATURES[p]])
    parts = [cmp.cell_audit(daily, t.snapshots, p, STREAM_FEATURES[p], p != "bs") for p in ("q", "fy", "bs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "governance_audit",
    "C20",
    """WITH r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS ratio FROM bars)
SELECT 'bars_valid' AS "check", 0::BIGINT AS violations, 'PASS' AS status UNION ALL SELECT 'ohlc_bounds', 0, 'PASS'
UNION ALL SELECT 'price_continuity', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count_if(ratio < 0.5 OR ratio > 2)::BIGINT AS n FROM r)
UNION ALL SELECT 'volume_legal', 0, 'PASS' UNION ALL SELECT 'labels_rebuild', 0, 'PASS' UNION ALL SELECT 'state_timing', 0, 'PASS'
UNION ALL SELECT 'vintage_identity', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT (count_if(a.close <> b.close) + count_if(a.volume <> b.volume))::BIGINT AS n FROM bars a JOIN bars_b b USING (symbol, date))""",
)
def _(t: Tables):
    v = bar_ops.bar_violations(t.bars)
    o = bar_ops.ohlc_bounds(t.bars)
    states = pit.timing_violations(pit.attach_states(t.bars.select(*KEY), t.snapshots))
    timing = F.col("filing_not_before_session") + F.col("future_effective_date") + F.col("negative_age") + F.col("wrong_basis") + F.col("reference_after_state")
    lv = lab.validate_labels(lab.build_labels(t.bars), t.bars)
    return aud.governance(
        {
            "bars_valid": (v, F.col("duplicate_dates") + F.col("missing_dates") + F.col("nonfinite") + F.col("nonpositive")),
            "ohlc_bounds": (o, F.col("bound_violations")),
            "price_continuity": (o, F.col("discontinuities")),
            "volume_legal": (v, F.col("negative_volume") + F.col("non_integral_volume")),
            "labels_rebuild": (lv, F.col("position_violations") + F.col("price_violations") + F.col("formula_violations")),
            "state_timing": (states, timing),
            "vintage_identity": (cmp.exact_diff(t.bars, vintage_b(t.bars).select(t.bars.columns), KEY), F.col("changed_cells")),
        }
    )


# ---- assessments -----------------------------------------------------------------------------------
_rel = ("close_to_sma_20_ols", "close_to_sma_20_ridge")
_in = ", ".join(f"'{m}'" for m in _rel)


@query(
    "predictive_assessment",
    "A40",
    f"""WITH g AS (SELECT symbol, model, bool_and(mean_delta_MAE < 0 AND median_delta_MAE < 0 AND win_rate > 0.5) AS six, bool_and(mean_delta_MAE < 0 AND win_rate > 0.5) AS core
 FROM paired_v WHERE model IN ({_in}) AND reference IN ('zero_return', 'historical_mean') GROUP BY ALL)
SELECT symbol, count_if(six)::BIGINT AS models_passing_all, count_if(core)::BIGINT AS models_passing_core,
 CASE WHEN bool_or(six) THEN 'ROBUST_MULTI_YEAR_SIGNAL' WHEN NOT bool_or(core) THEN 'NO_ROBUST_MULTI_YEAR_SIGNAL' ELSE 'MIXED_OR_REGIME_DEPENDENT_SIGNAL' END AS classification FROM g GROUP BY symbol""",
)
def _(t: Tables):
    return aud.predictive_assessment(met.paired_comparison(met.fold_mae(walk1(t, once=True).oof), PAIRS), _rel)


@query(
    "incremental_assessment",
    "A40",
    """SELECT symbol, CASE WHEN bool_or(mean_delta_MAE < 0 AND median_delta_MAE < 0 AND win_rate > 0.5) THEN 'ROBUST_INCREMENTAL_FUNDAMENTAL_VALUE'
 WHEN NOT bool_or(mean_delta_MAE < 0 AND win_rate > 0.5) THEN 'NO_ROBUST_INCREMENTAL_FUNDAMENTAL_VALUE' ELSE 'MIXED_OR_REGIME_DEPENDENT_INCREMENTAL_VALUE' END AS classification
FROM paired_v WHERE reference LIKE 'sma_20%' GROUP BY symbol""",
)
def _(t: Tables):
    p = met.paired_comparison(met.fold_mae(walk1(t, once=True).oof), PAIRS)
    return aud.incremental_assessment(p, [("close_to_sma_20_ols", "sma_20_ols"), ("close_to_sma_20_ridge", "sma_20_ridge")])


def endpoints(s: Study) -> DataFrame:
    """Extremes of control (sma_20) and treatment (close_to_sma_20) per fold and pooled."""
    arm = F.when(F.col("feature") == "sma_20", "control").when(F.col("feature") == "close_to_sma_20", "treatment")
    z = met.with_scopes(s.z.withColumn("arm", arm).filter(F.col("arm").isNotNull()))
    zs = z.groupBy("symbol", "scope", "arm").agg(
        F.try_divide(F.count_if((F.col("raw") < F.col("train_min")) | (F.col("raw") > F.col("train_max"))), F.count("raw")).alias("outside_fraction"),
        F.max("abs_z").alias("max_abs_z"),
    )
    name = F.col("model")
    p = s.oof.withColumns(
        {
            "arm": F.when(name.startswith("close_to_sma_20_"), "treatment").when(name.startswith("sma_20_"), "control"),
            "family": F.element_at(F.split(name, "_"), -1),
        }
    ).filter(F.col("arm").isNotNull())
    a = F.abs("prediction")
    ps = met.with_scopes(p).groupBy("symbol", "scope", "arm", "family").agg(
        F.avg(a).alias("mean_abs_prediction"), F.count_if(a > 0.10).alias("count_gt_0_10"), F.count_if(a > 0.30).alias("count_gt_0_30")
    )
    return ps.join(zs, ["symbol", "scope", "arm"])


_scope = "(SELECT *, fold::VARCHAR AS scope FROM {t} UNION ALL SELECT *, 'pooled' FROM {t})"


@query(
    "mechanism_assessment",
    "A40 A19",
    f"""WITH z AS (SELECT symbol, scope, CASE feature WHEN 'sma_20' THEN 'control' ELSE 'treatment' END AS arm, count_if(raw < train_min OR raw > train_max)::DOUBLE / nullif(count(raw), 0) AS o, max(abs(z)) AS m
 FROM {_scope.format(t='cv_z')} WHERE role = 'validation' AND feature IN ('sma_20', 'close_to_sma_20') GROUP BY ALL),
p AS (SELECT symbol, scope, CASE WHEN model LIKE 'close%' THEN 'treatment' ELSE 'control' END AS arm, CASE WHEN model LIKE '%ols' THEN 'ols' ELSE 'ridge' END AS family, avg(abs(prediction)) AS a,
  count_if(abs(prediction) > 0.10) AS c1, count_if(abs(prediction) > 0.30) AS c3 FROM {_scope.format(t='cv_oof')} WHERE model IN ('sma_20_ols', 'sma_20_ridge', 'close_to_sma_20_ols', 'close_to_sma_20_ridge') GROUP BY ALL),
e AS (SELECT * FROM p JOIN z USING (symbol, scope, arm)),
w AS (SELECT t.symbol, t.scope, t.family, CASE WHEN c.o > 0 THEN t.o / c.o WHEN t.o = 0 THEN 1 END AS ro, CASE WHEN c.m > 0 THEN t.m / c.m WHEN t.m = 0 THEN 1 END AS rm, CASE WHEN c.a > 0 THEN t.a / c.a WHEN t.a = 0 THEN 1 END AS ra,
  (t.m > 5 AND t.m > c.m) OR t.c1 > c.c1 OR t.c3 > c.c3 AS worse FROM e t JOIN e c USING (symbol, scope, family) WHERE t.arm = 'treatment' AND c.arm = 'control'),
s AS (SELECT symbol, (sum((coalesce(ro <= 0.75, false)::INTEGER + coalesce(rm <= 0.75, false)::INTEGER + coalesce(ra <= 0.75, false)::INTEGER)) FILTER (scope = '3'))::BIGINT AS material_endpoints,
  (count_if(scope = '3') * 3)::BIGINT AS endpoint_count, bool_and(scope <> 'pooled' OR (coalesce(ro < 1, false) AND coalesce(rm < 1, false) AND coalesce(ra < 1, false))) AS pooled_all_improve,
  count_if(scope NOT IN ('3', 'pooled') AND worse)::BIGINT AS new_instability FROM w GROUP BY symbol)
SELECT *, CASE WHEN material_endpoints = endpoint_count AND pooled_all_improve AND new_instability = 0 THEN 'SUPPORTED' WHEN material_endpoints > 0 THEN 'PARTIALLY_SUPPORTED_OR_INCONCLUSIVE' ELSE 'NOT_SUPPORTED' END AS category FROM s""",
)
def _(t: Tables):
    return aud.mechanism_assessment(endpoints(cv1(t)))


_fr = ("CASE WHEN count({m}_sign_match) > 0 THEN count_if({m}_sign_match)::DOUBLE / count({m}_sign_match) END AS {m}")


@query(
    "signal_assessment",
    "A40 A19",
    f"""WITH x AS (SELECT *, CASE WHEN model LIKE '%_ols' THEN 'ols' ELSE 'ridge' END AS family FROM cv_oof WHERE model IN ({_in})),
m AS (SELECT symbol, fold, family, Pearson, Spearman FROM ({metric_sql('x', 'symbol, fold, family')})),
cal AS (SELECT symbol, fold, family, avg(prediction - actual) AS bias, {SLOPE} AS slope, stddev_samp(actual) AS sa,
  CASE WHEN stddev_samp(actual) > 0 THEN CASE WHEN min(prediction) = max(prediction) THEN 0 ELSE stddev_samp(prediction) END / stddev_samp(actual) END AS ratio FROM x GROUP BY ALL),
adv AS (SELECT x.symbol, x.fold, x.family, count(*) AS n, count_if(abs(x.actual - x.prediction) - abs(b.actual - b.prediction) < -1e-15)::DOUBLE / count(*) AS beat
  FROM x JOIN cv_oof b ON b.symbol = x.symbol AND b.fold = x.fold AND b.date = x.date WHERE b.model = 'zero_return' GROUP BY ALL),
j AS (SELECT *, abs(beat - 0.5) <= 1.0 / n + 1e-15 AS near, abs(bias) / sa > 0.25 OR ratio NOT BETWEEN 0.75 AND 1.25 OR slope NOT BETWEEN 0.75 AND 1.25 AS problem
  FROM m JOIN cal USING (symbol, fold, family) JOIN adv USING (symbol, fold, family)),
per AS (SELECT symbol, family, bool_and(slope > 1e-15) AS a, bool_and(Pearson > 1e-15) AS b, count_if(Spearman > 1e-15) AS sp, count_if(beat > 0.5 AND NOT near) AS majority,
  count_if(beat <= 0.5 AND NOT near) AS nonmajority, count_if(problem) AS problems, bool_or(slope > 1e-15) AND bool_or(slope < -1e-15) OR count_if(slope <= 1e-15) >= 2 AS unstable,
  bool_and(slope IS NOT NULL AND Pearson IS NOT NULL AND Spearman IS NOT NULL AND ratio IS NOT NULL) AS defined FROM j GROUP BY ALL),
cos AS (SELECT symbol, family, bool_and(c > 0) AS cos_ok, count_if(c <= 0) AS cos_bad FROM (
  SELECT a.symbol, a.family, sum(a.coefficient * b.coefficient) / (sqrt(sum(a.coefficient ^ 2)) * sqrt(sum(b.coefficient ^ 2))) AS c
  FROM cv_table a JOIN cv_table b ON a.symbol = b.symbol AND a.family = b.family AND a.feature = b.feature AND a.fold < b.fold GROUP BY a.symbol, a.family, a.fold, b.fold) GROUP BY ALL),
sg AS (SELECT symbol, family, avg(CASE WHEN k = folds THEN (greatest(pos, neg, zer) = k)::INTEGER END) AS share FROM (
  SELECT symbol, family, feature, count(*) AS k, count_if(coefficient > 1e-15) AS pos, count_if(coefficient < -1e-15) AS neg, count_if(abs(coefficient) <= 1e-15) AS zer FROM cv_table GROUP BY ALL)
  JOIN (SELECT symbol, count(DISTINCT fold) AS folds FROM cv_table GROUP BY symbol) USING (symbol) GROUP BY ALL),
fr AS (SELECT symbol, scope, {_fr.format(m='pearson')}, {_fr.format(m='spearman')} FROM (SELECT *, fold::VARCHAR AS scope FROM assoc_pairs UNION ALL SELECT *, 'pooled' FROM assoc_pairs) GROUP BY ALL),
asc_v AS (SELECT symbol, bool_or(pearson >= 0.5 AND spearman >= 0.5) FILTER (scope = 'pooled') AS ok, count_if(scope <> 'pooled' AND pearson <= 0.5 AND spearman <= 0.5) >= 2 AS bad FROM fr GROUP BY symbol),
v AS (SELECT symbol, coalesce(defined AND a AND b AND sp >= 2 AND majority >= 2 AND problems >= 2 AND share >= 0.5 AND cos_ok AND ok, false) AS signal,
  coalesce(defined AND nonmajority >= 2 AND unstable AND (share < 0.5 OR cos_bad >= 2 OR bad), false) AS weak
  FROM per JOIN cos USING (symbol, family) JOIN sg USING (symbol, family) JOIN asc_v USING (symbol))
SELECT symbol, CASE WHEN bool_and(signal) THEN 'SIGNAL_WITH_CALIBRATION_INSTABILITY' WHEN bool_and(weak) THEN 'WEAK_OR_TEMPORALLY_UNSTABLE_SIGNAL' ELSE 'MIXED_OR_INCONCLUSIVE' END AS category
FROM v GROUP BY symbol""",
)
def _(t: Tables):
    s = cv1(t)
    oof = s.oof.filter(F.col("model").isin("close_to_sma_20_ols", "close_to_sma_20_ridge")).withColumn("family", F.element_at(F.split("model", "_"), -1))
    key = ["symbol", "fold", "family"]
    cal = met.calibration(oof, key).join(met.dispersion(oof, key), key).join(met.regression_metrics(oof, key).select(*key, "Pearson", "Spearman"), key)
    judged = s.oof.filter(F.col("model").startswith("close_to_sma_20") | (F.col("model") == "zero_return"))
    adv = met.baseline_advantage(judged, ("zero_return",), ["symbol", "fold"])
    adv = adv.select("symbol", "fold", F.element_at(F.split("model", "_"), -1).alias("family"), (F.col("model_beats") / F.col("n")).alias("beat_fraction"))
    return aud.signal_assessment(
        cal, adv, stab.sign_stability(s.table), stab.coefficient_cosine(s.table, ["feature"]), stab.association_stability(s.associations)
    )


# ---- scalar helpers --------------------------------------------------------------------------------
@query(
    "strict_dates",
    "",
    """SELECT o_orderkey, CASE WHEN d.n = 0 THEN o_orderdate::DATE WHEN d.n = 1 THEN o_orderdate::DATE END AS parsed, d.n AS spelling FROM orders, (SELECT unnest([0, 1, 2, 3])::INTEGER AS n) d""",
)
def _(t: Tables):
    d = F.col("o_orderdate")
    spellings = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy-M-d'x'"), F.date_format(d, "dd.MM.yyyy"))
    o = t.table("orders").select("o_orderkey", F.posexplode(spellings).alias("spelling", "text"))
    return o.select("o_orderkey", strict_date("text").alias("parsed"), "spelling")


@query(
    "plain_dates_and_counts",
    "V4 V13",
    """SELECT l_returnflag, count_if(l_shipdate = date_trunc('day', l_shipdate))::BIGINT AS plain_dates, count_if(l_quantity >= 0 AND l_quantity = floor(l_quantity))::BIGINT AS integral_counts,
 count_if(l_extendedprice >= 0 AND l_extendedprice = floor(l_extendedprice))::BIGINT AS integral_prices, count_if(abs(l_discount - 0.05) <= 0.01 + 1e-12)::BIGINT AS near_five_percent FROM lineitem GROUP BY ALL""",
)
def _(t: Tables):
    return t.lines.groupBy("l_returnflag").agg(
        F.count_if(is_plain_date("l_shipdate")).alias("plain_dates"), F.count_if(is_integral_count("l_quantity")).alias("integral_counts"),
        F.count_if(is_integral_count("l_extendedprice")).alias("integral_prices"),
        F.count_if(is_close("l_discount", F.lit(0.05), 0.0, 0.01 + 1e-12)).alias("near_five_percent"),
    )


