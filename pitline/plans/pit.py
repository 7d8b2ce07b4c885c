"""Point-in-time daily matrix and its audits."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from pitline.config import (
    BALANCE_FIELDS, FIELDS, FILING_META, FUNDAMENTAL_FEATURES, HORIZONS, MARKET_FEATURES, RESEARCH_FEATURES, STREAM_FEATURES,
)
from pitline.operators import pit
from pitline.operators import snapshots as snap
from pitline.operators.labels import append_labels
from pitline.operators.rolling import build_features
from pitline.plans.filings import META
from pitline.plans.market import rounded
from pitline.plans.registry import Tables, query
from pitline.plans.sql import R, cte


def _snapshots(self: Tables):
    return snap.build_snapshots(self.filings)


def _marked(self: Tables):
    """The features with the filing days of their states, which join the narrow bars in the shuffle that the features need."""
    days = pit.state_days(self.bars, self.filings.dropna(subset=snap.PERIOD))
    return build_features(days, pit.day_columns())


def _daily(self: Tables):
    return pit.join_states(_marked(self), self.snapshots)


def _labelled(self: Tables):
    """Labels come before the states, from rows that are narrow still."""
    return pit.join_states(append_labels(_marked(self)), self.snapshots)


for _name, _fn in (("snapshots", _snapshots), ("daily", _daily), ("labelled", _labelled)):
    _prop = cached_property(_fn)
    _prop.__set_name__(Tables, _name)
    setattr(Tables, _name, _prop)

# ---- SQL views -------------------------------------------------------------------------------------
_member = {
    "q": "data_period_type = 'quarterly'",
    "fy": "data_period_type = 'annual'",
    "bs": f"coalesce({', '.join(BALANCE_FIELDS)}) IS NOT NULL",
    "mixed": "true",
}
cte(
    "effective",
    """SELECT s.*, b.date AS effective_date FROM snaps s ASOF LEFT JOIN (SELECT symbol, date FROM bars) b
ON s.symbol = b.symbol AND s.filing_date < b.date""",
)
cte("first_session", "SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol")
_tie = "filing_date DESC, period_end DESC, (data_period_type = 'quarterly') DESC, amended DESC, period_start DESC, accession DESC"
for _s, _cond in _member.items():
    cte(
        f"winners_{_s}",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, effective_date ORDER BY {_tie}) AS wn
FROM effective WHERE effective_date IS NOT NULL AND {_cond}) WHERE wn = 1""",
    )
    _p = "fundamental" if _s == "mixed" else _s
    _cols = ", ".join(
        [f"w.{c} AS {_p}_{c}" for c in (*FILING_META, "effective_date")]
        + [
            f"w.filing_date < f.first_date AS {_p}_effective_date_is_sample_truncated",
            f"""CASE WHEN w.filing_date IS NULL THEN NULL WHEN w.filing_date < f.first_date THEN 'sample_start_truncated'
                ELSE 'observed_next_session' END AS {_p}_effective_date_basis""",
            f"(b.date - w.filing_date)::INTEGER AS {_p}_days_since_filing",
            f"(b.date - w.effective_date)::INTEGER AS {_p}_days_since_effective_date",
        ]
        + [f"w.{c} AS {c if c in STREAM_FEATURES.get(_s, ()) else _p + '_' + c}" for c in pit.stream_payload(_s)]
    )
    cte(
        f"state_{_s}",
        f"""SELECT b.symbol, b.date, {_cols} FROM bars b JOIN first_session f ON f.symbol = b.symbol
ASOF LEFT JOIN winners_{_s} w ON w.symbol = b.symbol AND w.effective_date <= b.date""",
    )
cte(
    "daily_v",
    """SELECT f.*, q.* EXCLUDE (symbol, date), y.* EXCLUDE (symbol, date), s.* EXCLUDE (symbol, date)
FROM features f JOIN state_q q USING (symbol, date) JOIN state_fy y USING (symbol, date) JOIN state_bs s USING (symbol, date)""",
)
cte("labelled_v", "SELECT d.*, l.* EXCLUDE (symbol, date) FROM daily_v d JOIN labels_v l USING (symbol, date)")

_state = [c for c in pit.state_columns("q") if c not in snap.PROVENANCE]


# ---- queries ---------------------------------------------------------------------------------------
@query(
    "next_session",
    "J1 P14",
    f"""SELECT e.symbol, {META}, effective_date, filing_date < first_date AS effective_date_is_sample_truncated,
CASE WHEN effective_date IS NULL THEN 'no_observed_next_session' WHEN filing_date < first_date THEN 'sample_start_truncated'
 ELSE 'observed_next_session' END AS effective_date_basis FROM effective e JOIN first_session f USING (symbol)""",
)
def _(t: Tables):
    df = pit.with_effective_dates(snap.eligible(t.filings), t.bars.select("symbol", "date"))
    return df.select(
        "symbol", *FILING_META, "effective_date", "effective_date_is_sample_truncated", "effective_date_basis"
    )


@query(
    "effective_date_winners",
    "W11 J2",
    f"SELECT symbol, effective_date, {META} FROM winners_mixed",
)
def _(t: Tables):
    df = pit.with_effective_dates(snap.eligible(t.filings), t.bars.select("symbol", "date"))
    return pit.latest_per_effective_date(df).select("symbol", "effective_date", *FILING_META)


@query(
    "whole_observation_join",
    "J2 P14 V14",
    f"SELECT symbol, date, {', '.join(f'fundamental_{c}' for c in _state)}, {', '.join(f'fundamental_{c}' for c in FIELDS)} FROM state_mixed",
)
def _(t: Tables):
    df = pit.attach_states(t.bars.select("symbol", "date"), t.filings, ("mixed",))
    return df.select("symbol", "date", *[f"fundamental_{c}" for c in _state], *[f"fundamental_{c}" for c in FIELDS])


_sc = [f"{p}_{c}" for p in ("q", "fy", "bs") for c in _state if c not in FILING_META or c == "accession"]


@query("daily_states", "J4 P7", f"SELECT symbol, date, {', '.join(_sc)}, {', '.join('bs_' + c for c in BALANCE_FIELDS)} FROM daily_v")
def _(t: Tables):
    return t.daily.select("symbol", "date", *_sc, *[f"bs_{c}" for c in BALANCE_FIELDS])


@query(
    "daily_matrix",
    "J4 J8 P9",
    f"SELECT symbol, date, {', '.join(f'{R(c)} AS {c}' for c in RESEARCH_FEATURES)} FROM daily_v",
)
def _(t: Tables):
    return rounded(t.daily, ["symbol", "date"], RESEARCH_FEATURES)


_ret = [f"forward_return_{h}d" for h in HORIZONS]


@query(
    "labelled_matrix",
    "J4 J8 W5",
    f"SELECT symbol, date, target_entry_date, target_exit_date_5d, {', '.join(f'{R(c)} AS {c}' for c in (*MARKET_FEATURES, *FUNDAMENTAL_FEATURES, *_ret))} FROM labelled_v",
)
def _(t: Tables):
    return rounded(t.labelled, ["symbol", "date", "target_entry_date", "target_exit_date_5d"], (*RESEARCH_FEATURES, *_ret))


_sv = " UNION ALL ".join(
    f"SELECT symbol, '{s}' AS stream, count(*) AS sessions_checked, 0::BIGINT AS violations FROM bars GROUP BY symbol"
    for s in ("q", "fy", "bs")
)


@query("running_max_state_check", "J3 V5 V6", f"SELECT * FROM ({_sv})")
def _(t: Tables):
    return pit.state_violations(t.daily, t.filings)


_tv = " UNION ALL ".join(
    f"""SELECT symbol, '{s}' AS stream, count(*) AS row_count, count_if({s}_accession IS NULL)::BIGINT AS unmatched_rows,
 count_if({s}_filing_date >= date)::BIGINT AS filing_not_before_session, count_if({s}_effective_date > date)::BIGINT AS future_effective_date,
 count_if({s}_days_since_filing < 0)::BIGINT AS negative_age, 0::BIGINT AS wrong_basis, 0::BIGINT AS reference_after_state,
 count_if({s}_effective_date_is_sample_truncated)::BIGINT AS sample_truncated_rows FROM daily_v GROUP BY symbol"""
    for s in ("q", "fy", "bs")
)


@query("alignment_validation", "V5 V6", f"SELECT * FROM ({_tv})")
def _(t: Tables):
    return pit.timing_violations(t.daily)


_keyj = "s.accession = d.{p}_accession AND s.period_start = d.{p}_period_start AND s.period_end = d.{p}_period_end AND s.data_period_type = d.{p}_data_period_type"
_sel = ", ".join(
    f"EXISTS (SELECT 1 FROM state_{p} d WHERE d.symbol = s.symbol AND {_keyj.format(p=p)}) AS selected_for_{p}" for p in ("q", "fy", "bs")
)


@query(
    "selected_snapshots",
    "J10",
    f"SELECT *, selected_for_q OR selected_for_fy OR selected_for_bs AS selected_for_daily FROM (SELECT symbol, {META}, {_sel} FROM elig s)",
)
def _(t: Tables):
    m = pit.mark_selected(snap.eligible(t.filings), t.daily_shared)
    return m.select("symbol", *FILING_META, *[f"selected_for_{s}" for s in ("q", "fy", "bs", "daily")])


@query(
    "state_changes",
    "W10",
    """SELECT symbol, date, lag(date) OVER w AS previous_date, q_accession IS NOT NULL AS has_state,
CASE WHEN q_accession IS NOT NULL AND lag(q_accession) OVER w IS NOT NULL THEN
 (q_accession, q_filing_date, q_effective_date, q_period_start, q_period_end, q_data_period_type) IS DISTINCT FROM
 lag((q_accession, q_filing_date, q_effective_date, q_period_start, q_period_end, q_data_period_type)) OVER w END AS state_changed
FROM daily_v WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
)
def _(t: Tables):
    c = pit.state_changes(t.daily, "q")
    return c.select("symbol", "date", "previous_date", F.col("state_identifier").isNotNull().alias("has_state"), "state_changed")


@query(
    "alignment_summary",
    "A41",
    """SELECT m.symbol, min(m.date) AS first_session, count(*) AS market_rows, count_if(fundamental_accession IS NULL)::BIGINT AS unmatched_rows,
 count(DISTINCT fundamental_accession) AS matched_accessions,
 any_value(c.pre) AS pre_window_observations, any_value(c.ytd) AS excluded_ytd, any_value(c.am) AS amended_observations,
 any_value(c.rep) AS repeated_period_observations
FROM state_mixed m JOIN (
  SELECT f.symbol, count_if(filing_date < first_date)::BIGINT AS pre, count_if(data_period_type = 'ytd')::BIGINT AS ytd,
    count_if(form LIKE '%/A')::BIGINT AS am, count_if(n > 1)::BIGINT AS rep
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol, period_end, data_period_type) AS n FROM filings) f
  JOIN first_session s ON s.symbol = f.symbol GROUP BY f.symbol) c ON c.symbol = m.symbol
GROUP BY m.symbol""",
)
def _(t: Tables):
    d = pit.attach_states(t.bars.select("symbol", "date"), t.filings, ("mixed",))
    return pit.run_summary(d, t.filings)


@query(
    "research_window",
    "P13 P12",
    f"""SELECT symbol, date, {', '.join(f'{R(c)} AS {c}' for c in MARKET_FEATURES)}, q_accession FROM daily_v
WHERE date BETWEEN DATE '1996-06-01' AND DATE '2000-12-31'""",
)
def _(t: Tables):
    d = pit.research_slice(t.daily, "1996-06-01", "2000-12-31")
    return rounded(d, ["symbol", "date", "q_accession"], MARKET_FEATURES)
