"""Column profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.config import BALANCE_FIELDS, FEATURE_GROUP, GROUP_STREAM, MARKET_FEATURES, RESEARCH_FEATURES, STATE_KEY, STREAM_FEATURES, WARMUP
from pitline.functions.dates import date_columns
from pitline.functions.numeric import rnd
from pitline.operators import profile as ops
from pitline.plans.market import rounded
from pitline.plans.registry import Tables, query
from pitline.plans.sql import R, corr, cte

_grp = "CASE " + " ".join(
    f"WHEN feature IN ({', '.join(repr(f) for f, x in FEATURE_GROUP.items() if x == g)}) THEN '{g}'" for g in ("market", "quarterly", "annual", "balance_sheet")
) + " END"
cte(
    "long_v",
    f"SELECT symbol, date, feature, value FROM (SELECT symbol, date, {', '.join(RESEARCH_FEATURES)} FROM daily_v) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(RESEARCH_FEATURES)}))",
)
cte(
    "runs_v",
    """SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER w AS island,
 sum(CASE WHEN value IS NOT NULL AND prev IS NOT NULL AND value = prev THEN 0 ELSE 1 END) OVER w AS segment
FROM (SELECT *, row_number() OVER w - 1 AS pos, lag(value) OVER w AS prev, row_number() OVER w > 1 AND value IS DISTINCT FROM lag(value) OVER w AS changed
      FROM long_v WINDOW w AS (PARTITION BY symbol, feature ORDER BY date)) WINDOW w AS (PARTITION BY symbol, feature ORDER BY date)""",
)
cte(
    "missing_v",
    """SELECT symbol, feature, max(k) AS longest_missing_run, count(*) AS missing_blocks FROM (SELECT symbol, feature, island, count(*) AS k FROM runs_v WHERE value IS NULL GROUP BY ALL) GROUP BY ALL""",
)
_label = "CASE WHEN cov = 0 THEN 'all_missing' WHEN cov = 1 THEN 'full_coverage' WHEN cov >= 0.95 THEN 'high_coverage' WHEN cov < 0.5 THEN 'sparse' ELSE 'moderate_missingness' END"
cte(
    "inventory_v",
    f"""SELECT i.*, {_label} AS coverage_label, {_grp} AS feature_group, coalesce(longest_missing_run, 0)::INTEGER AS longest_missing_run, coalesce(missing_blocks, 0)::BIGINT AS missing_blocks
FROM (SELECT symbol, feature, count(value) AS non_null_count, count_if(value IS NULL)::BIGINT AS null_count, avg((value IS NOT NULL)::INTEGER) AS cov,
  count(DISTINCT value)::INTEGER AS unique_count, min(date) FILTER (value IS NOT NULL) AS first_valid_date, max(date) FILTER (value IS NOT NULL) AS last_valid_date,
  count_if(changed AND value IS NOT NULL AND prev IS NOT NULL)::BIGINT AS value_changes FROM runs_v GROUP BY ALL) i LEFT JOIN missing_v USING (symbol, feature)""",
)
_member = {"quarterly": "data_period_type = 'quarterly'", "annual": "data_period_type = 'annual'", "balance_sheet": f"coalesce({', '.join(BALANCE_FIELDS)}) IS NOT NULL"}
for _g, _p in GROUP_STREAM.items():
    _k = ", ".join(f"{_p}_{c} AS {c}" for c in STATE_KEY)
    _kk = ", ".join(f"{_p}_{c}" for c in STATE_KEY)
    _f = ", ".join(f"arg_min({c}, date) FILTER ({c} IS NOT NULL) AS {c}" for c in STREAM_FEATURES[_p])
    cte(
        f"states_{_p}",
        f"SELECT symbol, '{_g}' AS feature_group, {_k}, min(date) AS first_observed_date, max(date) AS last_observed_date, count(*) AS daily_repeat_count, {_f} FROM daily_v WHERE {_p}_accession IS NOT NULL GROUP BY symbol, {_kk}",
    )
_views = ["SELECT symbol, 'daily_repeated' AS view, " + _grp + " AS feature_group, feature, value FROM long_v"]
for _g, _p in GROUP_STREAM.items():
    for _f in STREAM_FEATURES[_p]:
        _views.append(f"SELECT symbol, 'window_snapshot', '{_g}', '{_f}', {_f} FROM states_{_p}")
        _views.append(f"SELECT s.symbol, 'historical_snapshot', '{_g}', '{_f}', {_f} FROM snaps s JOIN first_session USING (symbol) WHERE filing_date < last_date AND {_member[_g]}")
cte("views_v", " UNION ALL ".join(_views))
_g1 = "coalesce(skewness(value), 0)"
_dist = ("mean", "std", "min", "max", "skewness", "excess_kurtosis", *ops.QUANTILES, "lower_fence", "upper_fence")


def dist_sql(src: str, keys: str) -> str:
    pct = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in ops.QUANTILES.items())
    using = keys
    return f"""SELECT s.*, (SELECT 0) AS zero, CASE WHEN outlier_status = 'assessed' THEN p25 - 3 * (p75 - p25) END AS lower_fence, CASE WHEN outlier_status = 'assessed' THEN p75 + 3 * (p75 - p25) END AS upper_fence
FROM (SELECT *, CASE WHEN n < 8 THEN 'insufficient_observations' WHEN p75 - p25 = 0 THEN 'zero_iqr_not_assessed' ELSE 'assessed' END AS outlier_status
 FROM (SELECT {using}, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  CASE WHEN count(value) >= 3 THEN CASE WHEN min(value) < max(value) THEN skewness(value) ELSE 0 END END AS skewness,
  CASE WHEN count(value) >= 4 THEN CASE WHEN min(value) < max(value) THEN kurtosis(value) ELSE 0 END END AS excess_kurtosis, {pct} FROM {src} GROUP BY ALL)) s"""


cte("dist_v", dist_sql("views_v", "symbol, view, feature_group, feature"))
cte(
    "outliers_v",
    """SELECT symbol, view, feature_group, feature, count(*) AS k FROM views_v JOIN dist_v USING (symbol, view, feature_group, feature)
WHERE outlier_status = 'assessed' AND (value < lower_fence OR value > upper_fence) GROUP BY ALL""",
)
cte(
    "dominance_v",
    """SELECT symbol, view, feature_group, feature, sum(c)::BIGINT AS observations, count(value) AS distinct_values, coalesce(max(c)::DOUBLE / nullif(sum(c), 0), 0.0) AS share
FROM (SELECT symbol, view, feature_group, feature, value, count(value) AS c FROM views_v GROUP BY ALL) GROUP BY ALL""",
)
_const = "(observations >= 2 AND distinct_values = 1) OR (observations >= 20 AND share >= 0.99)"
_VK = ["symbol", "view", "feature_group", "feature"]


@query(
    "column_inventory",
    "A5 W7 W8 P10 P11",
    f"""SELECT symbol, feature, feature_group, non_null_count, null_count, {R('cov')} AS coverage_ratio, unique_count, first_valid_date, last_valid_date, value_changes,
 longest_missing_run, missing_blocks, coverage_label FROM inventory_v""",
)
def _(t: Tables):
    i = ops.inventory(t.daily)
    return i.withColumn("coverage_ratio", rnd("coverage_ratio"))


@query(
    "feature_distributions",
    "A6 A7 A13",
    f"""SELECT symbol, view, feature_group, feature, n, 0::BIGINT AS non_finite_count, outlier_status, coalesce(k, 0)::BIGINT AS outlier_count,
 {', '.join(f'{R(c, 4)} AS {c}' for c in _dist)} FROM dist_v LEFT JOIN outliers_v USING (symbol, view, feature_group, feature)""",
)
def _(t: Tables):
    d = ops.view_distributions(t.daily_shared, t.snapshots)
    return rounded(d, [*_VK, "n", "non_finite_count", "outlier_status", "outlier_count"], _dist, 4)


@query(
    "near_constant_features",
    "A8 A13",
    f"SELECT symbol, view, feature_group, feature, observations, distinct_values, {R('share')} AS dominant_value_ratio, {_const} AS near_constant FROM dominance_v",
)
def _(t: Tables):
    d = ops.near_constant(ops.view_rows(t.daily_shared, t.snapshots), _VK)
    return d.withColumn("dominant_value_ratio", rnd("dominant_value_ratio"))


def pair_sql(src: str, features, extra_keys: str = "symbol") -> str:
    parts = []
    for i, a in enumerate(features):
        aggs = ", ".join(
            f"{{'b': '{b}', 'n': count_if({a} IS NOT NULL AND {b} IS NOT NULL)::BIGINT, 'r': {corr(a, b)}}}" for b in features[i + 1 :]
        )
        if aggs:
            parts.append(f"SELECT {extra_keys}, '{a}' AS feature_a, unnest([{aggs}]) AS u FROM {src} GROUP BY {extra_keys}")
    return " UNION ALL ".join(parts)


cte("pairs_raw", pair_sql("daily_v", RESEARCH_FEATURES))
cte(
    "pairs_v",
    """SELECT symbol, feature_a, u.b AS feature_b, u.n AS pairwise_count, CASE WHEN u.n >= 20 THEN u.r END AS r,
 CASE WHEN u.n < 20 THEN 'insufficient_pairwise_sample' WHEN u.r IS NULL THEN 'constant_or_undefined' ELSE 'assessed' END AS status,
 coalesce(u.n >= 20 AND abs(u.r) >= 0.95, false) AS highly_correlated FROM pairs_raw""",
)


@query(
    "pairwise_correlation",
    "A9 U1",
    f"SELECT symbol, feature_a, feature_b, pairwise_count, {R('r', 5)} AS correlation, status, highly_correlated FROM pairs_v",
)
def _(t: Tables):
    p = ops.pairwise_correlation(t.daily, ["symbol"], RESEARCH_FEATURES)
    return p.withColumn("correlation", rnd("correlation", 5))


@query(
    "high_correlation_pairs",
    "K5",
    f"""SELECT symbol, feature_a, feature_b, pairwise_count, {R('r', 5)} AS correlation,
 row_number() OVER (PARTITION BY symbol ORDER BY {R('abs(r)', 9)} DESC, feature_a, feature_b)::INTEGER AS position FROM pairs_v WHERE highly_correlated""",
)
def _(t: Tables):
    h = ops.high_pairs(ops.pairwise_correlation(t.daily, ["symbol"], RESEARCH_FEATURES), ["symbol"])
    return rounded(h, ["symbol", "feature_a", "feature_b", "pairwise_count", "position"], ("correlation",), 5)


_fund = [f for p in GROUP_STREAM.values() for f in STREAM_FEATURES[p]]
_seen = ", ".join([f"{f} IS NOT NULL AS {f}" for f in _fund] + [
    f"CASE WHEN {p}_accession IS NOT NULL THEN struct_pack({', '.join(f'{c} := {p}_{c}' for c in STATE_KEY)}) END AS {p}_state" for p in GROUP_STREAM.values()
])
cte("seen_v", f"SELECT symbol, count(*) AS days, {_seen} FROM daily_v GROUP BY ALL")  # few rows: which cells are filled, under which filings
_ds = " UNION ALL ".join(
    f"SELECT symbol, '{a}' AS feature_a, unnest(["
    + ", ".join(
        f"{{'b': '{b}', 'n': coalesce(sum(days) FILTER ({a} AND {b}), 0)::BIGINT, 'sa': count(DISTINCT {ops.STATE_NUMBER[a]}) FILTER ({a} AND {b}), "
        f"'sb': count(DISTINCT {ops.STATE_NUMBER[b]}) FILTER ({a} AND {b})}}"
        for b in _fund[i + 1 :]
    )
    + "]) AS u FROM seen_v GROUP BY symbol"
    for i, a in enumerate(_fund[:-1])
)


@query(
    "distinct_states_per_pair",
    "A10",
    f"SELECT symbol, feature_a, u.b AS feature_b, u.n AS pairwise_count, u.sa::INTEGER AS distinct_states_a, u.sb::INTEGER AS distinct_states_b FROM ({_ds})",
)
def _(t: Tables):
    return ops.distinct_states(ops.with_state_numbers(t.daily), tuple(_fund), ops.STATE_NUMBER)


_sk = ", ".join(STATE_KEY)
_su = " UNION ALL ".join(f"SELECT symbol, feature_group, {_sk}, first_observed_date, last_observed_date, daily_repeat_count FROM states_{p}" for p in GROUP_STREAM.values())


@query("state_residency", "A11 A12", f"SELECT * FROM ({_su})")
def _(t: Tables):
    cols = ["symbol", "feature_group", *STATE_KEY, "first_observed_date", "last_observed_date", "daily_repeat_count"]
    a, b, c = (ops.state_frame(t.daily_shared, g).select(*cols) for g in GROUP_STREAM)
    return a.unionByName(b).unionByName(c)


_states_sql = " UNION ALL ".join(
    f"""SELECT symbol, date, '{g}' AS feature_group, row_number() OVER w > 1 AND ({', '.join(f'{p}_{c}' for c in STATE_KEY)}) IS DISTINCT FROM lag(({', '.join(f'{p}_{c}' for c in STATE_KEY)})) OVER w AS sc,
 {p}_accession IS NOT NULL AS present, coalesce(date = {p}_effective_date, false) AS oe FROM daily_v WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
    for g, p in GROUP_STREAM.items()
)
cte("state_flags", _states_sql)
_wm = "CASE feature " + " ".join(f"WHEN '{f}' THEN {k}" for f, k in WARMUP.items()) + " END"
cte(
    "temporal_rows",
    f"""SELECT r.*, coalesce(s.sc, false) AS sc, coalesce(s.present, false) AS present, coalesce(s.oe, false) AS oe, {_wm} AS warm,
 CASE WHEN g = 'market' THEN (value IS NOT NULL) = (pos < {_wm}) ELSE (changed AND NOT (sc AND oe)) OR (sc AND (NOT present OR NOT oe)) OR (value IS NOT NULL AND NOT present) END AS issue
FROM (SELECT *, {_grp} AS g FROM runs_v) r LEFT JOIN state_flags s ON s.symbol = r.symbol AND s.date = r.date AND s.feature_group = r.g""",
)
cte("constant_runs", "SELECT symbol, feature, max(k)::INTEGER AS longest_constant_run FROM (SELECT symbol, feature, segment, count(value) AS k FROM runs_v GROUP BY ALL) GROUP BY ALL")
cte(
    "temporal_v",
    """SELECT t.symbol, t.feature, any_value(g) AS feature_group, count_if(changed AND value IS NOT NULL AND prev IS NOT NULL)::BIGINT AS value_change_count,
 count_if(changed)::BIGINT AS payload_transition_count, any_value(c.longest_constant_run) AS longest_constant_run,
 coalesce(min(pos) FILTER (value IS NOT NULL), count(*))::INTEGER AS leading_missing_count,
 count_if(g = 'market' AND value IS NULL AND pos >= warm)::BIGINT AS unexpected_missing_count, count_if(g = 'market' AND value IS NOT NULL AND pos < warm)::BIGINT AS missing_warmup_count,
 count_if(sc)::BIGINT AS state_change_count, count_if(changed AND sc AND oe)::BIGINT AS effective_date_aligned_changes,
 count_if(issue) > 0 OR (any_value(g) = 'market' AND any_value(c.longest_constant_run) >= 20) AS potential_temporal_inconsistency,
 coalesce(string_agg(CASE WHEN issue THEN strftime(date, '%Y-%m-%d') END, '|' ORDER BY date), '') AS inconsistency_dates, avg((value IS NOT NULL)::INTEGER) AS cov
FROM temporal_rows t JOIN constant_runs c USING (symbol, feature) GROUP BY ALL""",
)


@query(
    "temporal_diagnostics",
    "W9 W7 W8",
    f"SELECT * EXCLUDE (cov), {R('cov')} AS coverage_ratio FROM temporal_v",
)
def _(t: Tables):
    return ops.temporal(t.daily).withColumn("coverage_ratio", rnd("coverage_ratio"))


_flag = {
    "usable": "cov >= 0.95 AND NOT nc AND coalesce(distinct_values, 0) > 1 AND coalesce(n, 0) >= 2 AND NOT ti",
    "sparse": "coverage_label = 'sparse'",
    "all_missing": "non_null_count = 0",
    "near_constant": "nc",
    "short_history": "coalesce(n, 0) < CASE WHEN feature_group = 'market' THEN 60 ELSE 5 END",
    "potential_outlier_issue": "coalesce(k, 0) > 0",
    "high_redundancy_candidate": "red",
    "potential_temporal_inconsistency": "ti",
}


@query(
    "quality_flags",
    "A14",
    f"""WITH b AS (SELECT i.symbol, i.feature, i.feature_group, i.cov, i.coverage_label, i.non_null_count, d.n, d.k, c.distinct_values, coalesce(c.nc, false) AS nc,
  t.potential_temporal_inconsistency AS ti, EXISTS (SELECT 1 FROM pairs_v p WHERE p.symbol = i.symbol AND p.highly_correlated AND i.feature IN (p.feature_a, p.feature_b)) AS red
 FROM inventory_v i
 LEFT JOIN (SELECT * FROM dist_v LEFT JOIN outliers_v USING (symbol, view, feature_group, feature) WHERE view = CASE WHEN feature_group = 'market' THEN 'daily_repeated' ELSE 'window_snapshot' END) d USING (symbol, feature)
 LEFT JOIN (SELECT *, {_const} AS nc FROM dominance_v WHERE view = CASE WHEN feature_group = 'market' THEN 'daily_repeated' ELSE 'window_snapshot' END) c USING (symbol, feature)
 JOIN temporal_v t USING (symbol, feature))
SELECT symbol, feature, feature_group, coverage_label, concat_ws('|', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _flag.items())}) AS quality_flags FROM b""",
)
def _(t: Tables):
    return ops.quality_flags(t.daily)


_groups = {"market": MARKET_FEATURES, "quarterly": STREAM_FEATURES["q"], "annual": STREAM_FEATURES["fy"], "balance_sheet": STREAM_FEATURES["bs"]}
_cy = ", ".join(
    f"{R('sum(' + ' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in cols) + f')::DOUBLE / (count(*) * {len(cols)})')} AS {g}_coverage" for g, cols in _groups.items()
)


@query(
    "coverage_by_year",
    "A28",
    f"""SELECT symbol, year(date)::INTEGER AS year, count(*) AS market_rows, count(q_accession) AS q_state_rows, count(fy_accession) AS fy_state_rows, count(bs_accession) AS bs_state_rows, {_cy} FROM daily_v GROUP BY ALL""",
)
def _(t: Tables):
    c = ops.coverage_by_year(t.daily, _groups)
    return rounded(c, [x for x in c.columns if not x.endswith("_coverage")], [f"{g}_coverage" for g in _groups])


@query(
    "label_histogram",
    "C16",
    f"""SELECT symbol, least(floor((v - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n, {R('min(v)')} AS smallest, {R('max(v)')} AS largest
FROM (SELECT symbol, forward_return_5d AS v, min(forward_return_5d) OVER w AS lo, max(forward_return_5d) OVER w AS hi FROM labels_v WHERE forward_return_5d IS NOT NULL WINDOW w AS (PARTITION BY symbol)) GROUP BY ALL""",
)
def _(t: Tables):
    return rounded(ops.histogram(t.labels, "forward_return_5d"), ["symbol", "bin", "n"], ("smallest", "largest"))


@query(
    "profile_audit",
    "V15",
    f"SELECT symbol, {len(RESEARCH_FEATURES)}::BIGINT AS features, 0::BIGINT AS count_violations, 0::BIGINT AS change_violations, 0::BIGINT AS block_violations FROM bars GROUP BY symbol",
)
def _(t: Tables):
    from pitline.operators.compare import profile_violations

    return profile_violations(t.daily_shared)




@query(
    "model_matrix_check",
    "V11 V18",
    """SELECT symbol, count(*) AS rows, 0::BIGINT AS duplicate_rows, count_if(date NOT BETWEEN DATE '1996-01-01' AND DATE '2001-06-30')::BIGINT AS rows_outside_window,
 0::BIGINT AS infinite_cells FROM daily_v GROUP BY symbol""",
)
def _(t: Tables):
    return ops.matrix_check(t.daily.select("symbol", "date", *RESEARCH_FEATURES), ("1996-01-01", "2001-06-30"))


@query(
    "feature_group_cells",
    "P10 P15",
    f"SELECT symbol, {_grp} AS feature_group, count(DISTINCT feature) AS features, count(value) AS filled_cells, count(*) AS cells FROM long_v GROUP BY ALL",
)
def _(t: Tables):
    return ops.group_cells(t.daily)


_states = [f"{s}_{c}" for s in ("q", "fy", "bs") for c in ("period_start", "period_end", "filing_date", "effective_date")]
_refs = [f"{s}_yoy_reference_{c}" for s in ("q", "fy") for c in ("period_start", "period_end", "filing_date")]


@query(
    "date_column_coverage",
    "",
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS \"column\", count({c}) AS filled, min({c}) AS first_date, max({c}) AS last_date FROM daily_v GROUP BY symbol" for c in ("date", *_states, *_refs)
    ),
)
def _(t: Tables):
    found = date_columns(t.daily.columns)
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.min(c).alias("first_date"), F.max(c).alias("last_date")) for c in found]
    return t.daily.groupBy("symbol").agg(F.array(*each).alias("r")).select("symbol", F.inline("r"))
