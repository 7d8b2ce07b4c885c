"""Audits on tables with seeded faults. Their SQL counts the faults by the hash rule, from the keys of the sound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.config import GROWTH, HORIZONS, MARKET_FEATURES, STREAM_FEATURES
from pitline.functions.numeric import is_close
from pitline.operators import compare as cmp
from pitline.operators import labels as lab
from pitline.operators import metrics as met
from pitline.operators import models as mod
from pitline.operators import pit, rolling
from pitline.operators import snapshots as snap
from pitline.operators.faults import DIGITS, EVERY, plant, planted
from pitline.plans.models import SINGLE, replayed
from pitline.plans.registry import Tables, query
from pitline.sources import facts

KEY = ["symbol", "date"]
OBS = ["symbol", "accession", "period_start", "period_end", "data_period_type"]
RUN = ["symbol", "fold", "date", "model"]


def hit(name: str, key: list[str]) -> str:
    """The rule of `planted` in SQL."""
    text = ", ".join(f"coalesce({k}::VARCHAR, '')" for k in key)
    return f"(('0x' || substr(md5(concat_ws('|', '{name}', {text})), 1, {DIGITS}))::BIGINT % {EVERY} = 0)"


_exit, _open, _ret, _gone = (hit(n, KEY) for n in ("exit", "open", "return", "gone"))
_lf = " UNION ALL ".join(
    f"""SELECT symbol, {h}::INTEGER AS horizon, count(*) AS rows_checked,
 count_if(target_entry_date IS NOT NULL AND {_gone} OR {h} = 5 AND target_exit_date_{h}d IS NOT NULL AND {_exit} AND NOT {_gone})::BIGINT AS position_violations,
 count_if(target_entry_date IS NOT NULL AND ({_gone} OR {_open}))::BIGINT AS price_violations,
 count_if(forward_return_{h}d IS NOT NULL AND ({_gone} OR {h} = 20 AND {_ret}))::BIGINT AS formula_violations,
 count_if(forward_return_{h}d IS NULL)::BIGINT AS tail_nulls FROM labels_v GROUP BY symbol"""
    for h in HORIZONS
)


@query("label_audit_faults", "V7 C13", f"SELECT * FROM ({_lf})")
def _(t: Tables):
    faults = {
        "exit": ("target_exit_date_5d", F.date_add("target_exit_date_5d", 1)),
        "open": ("target_entry_open", F.col("target_entry_open") * 1.5),
        "return": ("forward_return_20d", F.col("forward_return_20d") + 0.01),
    }
    return lab.validate_labels(plant(lab.build_labels(t.bars), KEY, faults, "gone"), t.bars)


_ff = ", ".join(f"count_if({c} IS NOT NULL AND {hit(c, KEY)})::BIGINT AS {c}_violations" for c in MARKET_FEATURES)


@query("feature_rebuild_faults", "C17 V2", f"SELECT symbol, count(*) AS sessions_checked, {_ff} FROM features GROUP BY symbol")
def _(t: Tables):
    # half of the columns are shifted, the others lose their values
    value = {c: F.col(c) + 0.01 if i % 2 == 0 else F.lit(None).cast("double") for i, c in enumerate(MARKET_FEATURES)}
    bad = plant(t.features.select(*KEY, *MARKET_FEATURES), KEY, {c: (c, v) for c, v in value.items()})
    want = rolling.oracle_features(t.bars).select(*KEY, *[F.col(c).alias(f"w_{c}") for c in MARKET_FEATURES])
    return bad.join(want, KEY, "full_outer").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions_checked"),
        *[F.count_if(~is_close(c, f"w_{c}", rtol=1e-9, atol=1e-9)).alias(f"{c}_violations") for c in MARKET_FEATURES],
    )


def bad_states(t: Tables):
    """States filed on their session, effective after it, of negative age, of another basis, or with a reference filed after them."""
    faults = {}
    for s in ("q", "fy", "bs"):
        held = lambda value, s=s: F.when(F.col(f"{s}_accession").isNotNull(), value)
        faults |= {
            f"{s}_filed": (f"{s}_filing_date", held(F.col("date"))),
            f"{s}_effective": (f"{s}_effective_date", held(F.date_add("date", 1))),
            f"{s}_age": (f"{s}_days_since_filing", held(F.lit(-1))),
            f"{s}_basis": (f"{s}_data_period_type", held(F.lit("ytd"))),
        }
        if s != "bs":
            faults[f"{s}_reference"] = (f"{s}_yoy_reference_filing_date", held(F.date_add(f"{s}_filing_date", 1)))
    return plant(t.daily, KEY, faults)  # its readers read it once, so it is not kept


_tf = " UNION ALL ".join(
    f"""SELECT symbol, '{s}' AS stream, count(*) AS row_count, count_if({s}_accession IS NULL)::BIGINT AS unmatched_rows,
 count_if({s}_accession IS NOT NULL AND {hit(s + '_filed', KEY)})::BIGINT AS filing_not_before_session, count_if({s}_accession IS NOT NULL AND {hit(s + '_effective', KEY)})::BIGINT AS future_effective_date,
 count_if({s}_accession IS NOT NULL AND {hit(s + '_age', KEY)})::BIGINT AS negative_age,
 {'0' if s == 'bs' else f"count_if({s}_accession IS NOT NULL AND {hit(s + '_basis', KEY)})"}::BIGINT AS wrong_basis,
 {'0' if s == 'bs' else f"count_if({s}_accession IS NOT NULL AND {hit(s + '_reference', KEY)} AND NOT {hit(s + '_filed', KEY)})"}::BIGINT AS reference_after_state,
 count_if({s}_effective_date_is_sample_truncated)::BIGINT AS sample_truncated_rows FROM daily_v GROUP BY symbol"""
    for s in ("q", "fy", "bs")
)


@query("alignment_faults", "V5 V6", f"SELECT * FROM ({_tf})")
def _(t: Tables):
    return pit.timing_violations(bad_states(t))


_sf = " UNION ALL ".join(
    f"SELECT symbol, '{s}' AS stream, count(*) AS sessions_checked, count_if({s}_accession IS NOT NULL AND ({hit(s + '_filed', KEY)} OR {hit(s + '_basis', KEY)}))::BIGINT AS violations FROM daily_v GROUP BY symbol"
    for s in ("q", "fy", "bs")
)


@query("running_max_faults", "J3 V5", f"SELECT * FROM ({_sf})")
def _(t: Tables):
    return pit.state_violations(bad_states(t), t.filings)


_q = STREAM_FEATURES["q"]
_lost, _held = hit("q_lost", KEY), "q_accession IS NOT NULL"
_cv = " + ".join(f"count_if({_held} AND {c} IS NOT NULL AND ({_lost} OR {hit(c, KEY)}))" for c in _q)
_co = " + ".join(f"count_if(NOT ({_held}) AND {hit(c, KEY)})" for c in _q)


@query(
    "pit_cell_faults",
    "C12 V6",
    f"""SELECT symbol, 'q' AS stream, (count(*) * {len(_q)})::BIGINT AS cells, count_if({_held} AND {_lost})::BIGINT AS unknown_sources,
 count_if({_held} AND ({_lost} OR {hit('q_late', KEY)}))::BIGINT AS ineligible_states, 0::BIGINT AS unknown_references, ({_cv})::BIGINT AS value_violations, ({_co})::BIGINT AS values_without_state
FROM daily_v GROUP BY symbol""",
)
def _(t: Tables):
    held = F.col("q_accession").isNotNull()
    faults = {
        "q_lost": ("q_accession", F.when(held, F.lit("none"))),
        "q_late": ("q_effective_date", F.date_add("date", 1)),
        **{c: (c, F.when(held, F.col(c) + 1).otherwise(F.lit(1.0))) for c in _q},
    }
    return cmp.cell_audit(plant(t.daily, KEY, faults), t.snapshots, "q", _q, True)  # read once, so not kept


@query(
    "prediction_audit_faults",
    "V16 C7",
    f"""SELECT symbol, model, count(*) AS rows_checked, count_if({hit('gone', RUN)})::BIGINT AS identity_violations,
 count_if({hit('actual', RUN)} AND NOT {hit('gone', RUN)})::BIGINT AS actual_violations, count_if({hit('prediction', RUN)} AND NOT {hit('gone', RUN)})::BIGINT AS tolerance_violations
FROM cv_oof WHERE model NOT IN ('zero_return', 'historical_mean') GROUP BY ALL""",
)
def _(t: Tables):
    s, stored = replayed(t)
    bad = plant(stored, RUN, {"actual": ("actual", F.col("actual") + 0.001), "prediction": ("prediction", F.col("prediction") + 0.001)}, "gone")
    return met.control_reproduction(mod.score_from_table(s.members, s.params, s.table, SINGLE), bad).drop("max_absolute_difference")


_year, _fp, _filed, _fcf, _twice = (hit(n, OBS) for n in ("year", "fiscal", "filed", "fcf", "twice"))
_ef = {
    "invalid_fiscal_year": _year,
    "invalid_fiscal_period": _fp,
    "invalid_period_type": f"{_fp} AND data_period_type <> 'quarterly'",
    "invalid_chronology_or_form": _filed,
    "fcf_identity": f"{_fcf} AND operating_cash_flow IS NOT NULL AND capital_expenditures IS NOT NULL",
    "duplicate_key": _twice,
}


@query(
    "filing_audit_faults",
    "V3",
    " UNION ALL ".join(f"SELECT symbol, '{code}' AS error, count(*) AS n FROM filings WHERE {rule} GROUP BY symbol" for code, rule in _ef.items()),
)
def _(t: Tables):
    faults = {
        "year": ("fiscal_year", F.lit(1900)),
        "fiscal": ("fiscal_period", F.lit("Q9")),
        "filed": ("filing_date", F.date_sub("period_end", 1)),
        "fcf": ("free_cash_flow", F.col("free_cash_flow") + 1e6),
    }
    errors = facts.filing_errors(plant(t.filings, OBS, faults)).select("symbol", "error")
    twice = t.filings.unionByName(t.filings.filter(planted("twice", OBS)))
    return errors.unionByName(facts.duplicate_filings(twice).select("symbol", F.lit("duplicate_key").alias("error"))).groupBy("symbol", "error").agg(F.count(F.lit(1)).alias("n"))


_gv = ", ".join(
    f"count_if({hit(g, OBS)} AND q_{g}_growth_yoy IS NOT NULL)::BIGINT AS {g}_violations" for g in GROWTH
)


@query(
    "growth_reference_faults",
    "C15 J5",
    f"""SELECT symbol, count(*) AS snapshots, count_if({hit('reference', OBS)})::BIGINT AS reference_violations, count_if({hit('late', OBS)})::BIGINT AS unknown_reference_violations,
{_gv} FROM snaps GROUP BY symbol""",
)
def _(t: Tables):
    faults = {
        "reference": ("yoy_reference_accession", F.lit("none")),
        "late": ("yoy_reference_filing_date", F.date_add("filing_date", 1)),
        **{g: (f"q_{g}_growth_yoy", F.col(f"q_{g}_growth_yoy") + 1) for g in GROWTH},
    }
    return snap.reference_violations(plant(snap.build_snapshots(t.filings), OBS, faults), t.filings)
