"""Mutation and leakage probes, calendar and corporate-action audits, governance checks, assessment rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import HORIZONS, MARKET_FEATURES, PRICE_COLUMNS, WARMUP
from pitline.functions.numeric import is_close
from pitline.operators.labels import append_labels
from pitline.operators.rolling import build_features
from pitline.operators.variants import against_base, split_variants, with_variants

RETURNS = [f"forward_return_{h}d" for h in HORIZONS]


# ---- probes ----------------------------------------------------------------------------------------
def first_on_or_after(bars: DataFrame, day) -> DataFrame:
    """First session of each symbol on or after a date."""
    return bars.filter(F.col("date") >= F.lit(day)).groupBy("symbol").agg(F.min("date").alias("probe_date"))


def outputs(bars: DataFrame) -> DataFrame:
    return append_labels(build_features(bars)).select("symbol", "date", *MARKET_FEATURES, *RETURNS)


def dependency_probe(bars: DataFrame, day, changes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Which outputs react when one input field moves on each symbol's first session on or after a day: changed cells per (field, output).

    All fields and the unchanged rows are variants of one feature build, over the sessions that the change can reach alone: trailing
    windows from the day on, and labels of the sessions before it.
    """
    back, ahead = max(*HORIZONS, *WARMUP.values()), max(WARMUP.values())
    w = W.partitionBy("symbol")
    placed = bars.withColumn("_pos", F.row_number().over(w.orderBy("date")))
    placed = placed.withColumn("_probe", F.min(F.when(F.col("date") >= F.lit(day), F.col("_pos"))).over(w))
    near = placed.filter(F.col("_pos").between(F.col("_probe") - back, F.col("_probe") + ahead))
    hit = F.col("_pos") == F.col("_probe")
    copies = with_variants(near, {f: {f: F.when(hit, change(F.col(f))).otherwise(F.col(f))} for f, change in changes.items()})
    names = [*MARKET_FEATURES, *RETURNS]
    cells = against_base(split_variants(outputs(copies)), ["symbol", "date"], names, list(changes))
    counts = [
        F.struct(F.lit(f).alias("field"), F.lit(c).alias("output"), F.count_if((F.col("variant") == f) & ~F.col("base")[c].eqNullSafe(F.col("changed")[c])).alias("changed_cells"))
        for f in changes
        for c in names
    ]
    return cells.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def lineage(probe: DataFrame) -> DataFrame:
    """Output -> source fields registry filled from probe results."""
    return probe.groupBy("output").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("changed_cells") > 0, F.col("field")))), "|").alias("source_fields")
    )


def scope_violations(registry: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """Outputs that depend on a field they may not touch."""
    fields = F.split("source_fields", r"\|")
    return registry.select("output", "source_fields", F.arrays_overlap(fields, F.array(*[F.lit(f) for f in forbidden])).alias("forbidden"))


def future_bars_probe(bars: DataFrame, cutoff, factor: float = 17.0) -> DataFrame:
    """Features up to a cutoff must ignore every later bar: changed past cells, and changed future cells as a control."""
    later = F.col("date") > F.lit(cutoff)
    shifted = bars.withColumns({c: F.when(later, F.col(c) * factor).otherwise(F.col(c)) for c in PRICE_COLUMNS})
    a = build_features(bars).select("symbol", "date", *MARKET_FEATURES)
    b = build_features(shifted).select("symbol", "date", *[F.col(c).alias(f"m_{c}") for c in MARKET_FEATURES])
    diff = sum(((~F.col(c).eqNullSafe(F.col(f"m_{c}"))).cast("int") for c in MARKET_FEATURES), F.lit(0))
    j = a.join(b, ["symbol", "date"]).withColumn("_d", diff)
    past = F.col("date") <= F.lit(cutoff)
    return j.groupBy("symbol").agg(
        F.count_if(past).alias("past_sessions"), F.coalesce(F.sum(F.when(past, F.col("_d"))), F.lit(0)).alias("past_cells_changed"),
        (F.coalesce(F.sum(F.when(~past, F.col("_d"))), F.lit(0)) > 0).alias("future_reacts"),
    )


def prefix_probe(bars: DataFrame, cutoffs: list[str]) -> DataFrame:
    """The last row before each cutoff rebuilt from the prefix alone must equal the full-history row.

    All cutoffs run in one job: a bar joins every prefix it belongs to, so it is copied at most once per cutoff.
    """
    cuts = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    prefix = bars.select("symbol", *[c for c in bars.columns if c != "symbol"], F.explode(cuts).alias("cutoff")).filter(F.col("date") <= F.col("cutoff"))
    keyed = prefix.withColumn("symbol", F.struct("symbol", "cutoff"))
    rebuilt = build_features(keyed).select(
        F.col("symbol.cutoff").alias("cutoff"), F.col("symbol.symbol").alias("_symbol"), "date", *[F.col(c).alias(f"p_{c}") for c in MARKET_FEATURES]
    ).withColumnRenamed("_symbol", "sym")
    last = rebuilt.groupBy("sym", "cutoff").agg(F.max_by(F.struct("date", *[f"p_{c}" for c in MARKET_FEATURES]), "date").alias("r")).select(
        F.col("sym").alias("symbol"), "cutoff", "r.*"
    )
    full = build_features(bars).select("symbol", "date", *MARKET_FEATURES)
    j = last.join(full, ["symbol", "date"])
    bad = F.lit(False)
    for c in MARKET_FEATURES:
        bad = bad | ~is_close(F.col(c), F.col(f"p_{c}"))
    return j.groupBy("cutoff").agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(bad).alias("violations"))


def future_filings_probe(states: Callable[[DataFrame], DataFrame], filings: DataFrame, cutoff, fields: tuple[str, ...], watch: list[str]) -> DataFrame:
    """States up to a cutoff must ignore filings made on or after it; later states must react."""
    late = F.col("filing_date") >= F.lit(cutoff)
    changed = filings.withColumns({c: F.when(late, F.col(c) * 1000).otherwise(F.col(c)) for c in fields})
    a = states(filings).select("symbol", "date", *watch)
    b = states(changed).select("symbol", "date", *[F.col(c).alias(f"m_{c}") for c in watch])
    diff = sum(((~F.col(c).eqNullSafe(F.col(f"m_{c}"))).cast("int") for c in watch), F.lit(0))
    j = a.join(b, ["symbol", "date"]).withColumn("_d", diff)
    past = F.col("date") <= F.lit(cutoff)
    return j.groupBy("symbol").agg(
        F.count_if(past).alias("past_sessions"), F.coalesce(F.sum(F.when(past, F.col("_d"))), F.lit(0)).alias("past_cells_changed"),
        (F.coalesce(F.sum(F.when(~past, F.col("_d"))), F.lit(0)) > 0).alias("future_reacts"),
    )


# ---- calendar --------------------------------------------------------------------------------------
# Full-day closures outside the yearly rules.
SPECIAL_CLOSURES = ("2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus, in integer arithmetic."""
    y = year.cast("int")
    a, b, c = y % 19, F.floor(y / 100), y % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    day = h + m - 7 * n + 114
    return F.make_date(y, F.floor(day / 31).cast("int"), (day % 31 + 1).cast("int"))


def is_closure(d: Column) -> Column:
    """US equity full-day closures as rules on the date itself."""
    m, dom, dow, y = F.month(d), F.dayofmonth(d), F.dayofweek(d), F.year(d)
    mon, thu, fri = dow == 2, dow == 5, dow == 6

    def nearest(month: int, day: int) -> Column:
        exact = (m == month) & (dom == day) & ~dow.isin(1, 7)
        return exact | ((m == month) & (dom == day - 1) & fri) | ((m == month) & (dom == day + 1) & mon)

    return (
        ((m == 1) & (dom == 1)) | ((m == 1) & (dom == 2) & mon)
        | ((m == 1) & mon & dom.between(15, 21) & (y >= 1986))
        | ((m == 2) & mon & dom.between(15, 21))
        | (d == F.date_sub(easter(y), 2))
        | ((m == 5) & mon & (dom >= 25))
        | (nearest(6, 19) & (y >= 2022))
        | nearest(7, 4)
        | ((m == 9) & mon & (dom <= 7))
        | ((m == 11) & thu & dom.between(22, 28))
        | nearest(12, 25)
        | d.cast("string").isin(*SPECIAL_CLOSURES)
    )


def calendar_audit(sessions: DataFrame) -> DataFrame:
    """Expected equity sessions a symbol lacks and sessions outside the calendar, between its first and last date.

    The calendar is made once, a row per day between the first and last date of all symbols, with the number of open days up to it. A
    symbol's expected sessions are the difference of two such numbers, so no calendar is copied to symbols; each session meets its one day.
    """
    seen = sessions.groupBy("symbol", "date").agg(F.lit(1).alias("o"))
    ends = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    open_day = ~F.dayofweek("date").isin(1, 7) & ~is_closure(F.col("date"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date")).select("date", open_day.cast("int").alias("e"))
    # a row per calendar day, so one partition holds them
    calendar = days.withColumn("upto", F.sum("e").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    met = seen.join(F.broadcast(calendar), "date", "left")
    per = met.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observed_sessions"), F.count_if(F.col("e") == 1).alias("_both"),
        F.min(F.col("upto") - F.col("e")).alias("_before"), F.max("upto").alias("_upto"),
    )
    expected = F.coalesce(F.col("_upto") - F.col("_before"), F.lit(0))
    return per.select(
        "symbol", expected.alias("expected_sessions"), "observed_sessions", (expected - F.col("_both")).alias("missing_expected_sessions"),
        (F.col("observed_sessions") - F.col("_both")).alias("unexpected_sessions"),
    )


# ---- corporate actions -----------------------------------------------------------------------------
def corporate_audit(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Price behaviour around each event: ratios, bounds, an inverse-split jump, and labels that cross a split."""
    w = W.partitionBy("symbol").orderBy("date")
    prev = {c: F.lag(c).over(w) for c in PRICE_COLUMNS}
    outside = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    # labels of the h sessions before the event span it
    crossing = [(F.lead("close", h).over(w) / F.lead("open", 1).over(w) - 1).alias(f"_r{h}") for h in HORIZONS]
    b = bars.select(
        "symbol", "date", outside.alias("bound_violation"), (F.col("close") / prev["close"]).alias("close_ratio"),
        (F.col("open") / prev["close"]).alias("open_to_prior_close"),
        *[(F.col(c) / prev[c]).alias(f"ratio_{c}") for c in PRICE_COLUMNS], *crossing,
    )
    b = b.withColumns({f"cross_{h}": F.max(F.abs(F.col(f"_r{h}"))).over(w.rowsBetween(-h, -1)) for h in HORIZONS})
    j = events.join(b, ["symbol", "date"], "left")
    split = F.col("event_type") == "splits"
    inside = F.lit(True)
    for c in PRICE_COLUMNS:
        inside = inside & F.coalesce(F.col(f"ratio_{c}").between(0.5, 2.0), F.lit(True))
    mechanical = split & (F.abs(F.col("close_ratio") - 1 / F.col("split_ratio")) < F.abs(F.col("close_ratio") - 1))
    cross = F.greatest(*[F.col(f"cross_{h}") for h in HORIZONS])
    absent = F.col("bound_violation").isNull()
    return j.select(
        "symbol", "date", "event_type", "close_ratio", "open_to_prior_close", absent.alias("absent_from_bars"), inside.alias("ratios_within_bounds"),
        F.coalesce(mechanical, F.lit(False)).alias("inverse_split_jump"), F.when(split, cross).alias("max_abs_crossing_return"),
        (split & F.coalesce(cross > 0.5, F.lit(False))).alias("crossing_violation"),
    )


# ---- governance and rules --------------------------------------------------------------------------
def governance(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One PASS/FAIL line per check; each value is (frame, violation count expression)."""
    out: DataFrame | None = None
    for name, (df, expr) in checks.items():
        row = df.agg(F.coalesce(F.sum(expr), F.lit(0)).cast("bigint").alias("violations")).select(
            F.lit(name).alias("check"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status")
        )
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out


def materiality(dependent: Column, changed: Column, complete: Column, mutations: Column, controls: Column, legal: Column) -> Column:
    """Does a discrepancy in a field matter to current results?"""
    return (
        F.when(dependent | changed, "MATERIAL_TO_CURRENT_RESEARCH")
        .when(~complete | ~mutations | ~controls | ~legal, "MATERIALITY_NOT_ESTABLISHED")
        .otherwise("NONMATERIAL_TO_CURRENT_RESEARCH")
    )


def approval(gates_passed: Column, discrepancies: Column, all_nonmaterial: Column) -> Column:
    return (
        F.when(~gates_passed | ~all_nonmaterial, "REJECTED").when(discrepancies > 0, "APPROVED_WITH_QUALIFICATIONS").otherwise("APPROVED")
    )


def predictive_assessment(paired: DataFrame, models: tuple[str, ...], references: tuple[str, str] = ("zero_return", "historical_mean")) -> DataFrame:
    """Signal category per symbol: any model passing all six gates, none passing the four core gates, or mixed."""
    p = paired.filter(F.col("model").isin(*models) & F.col("reference").isin(*references))
    per = p.groupBy("symbol", "model").agg(
        F.every((F.col("mean_delta_MAE") < 0) & (F.col("median_delta_MAE") < 0) & (F.col("win_rate") > 0.5)).alias("all_six"),
        F.every((F.col("mean_delta_MAE") < 0) & (F.col("win_rate") > 0.5)).alias("core"),
    )
    category = (
        F.when(F.some("all_six"), "ROBUST_MULTI_YEAR_SIGNAL").when(~F.some("core"), "NO_ROBUST_MULTI_YEAR_SIGNAL").otherwise("MIXED_OR_REGIME_DEPENDENT_SIGNAL")
    )
    return per.groupBy("symbol").agg(F.count_if("all_six").alias("models_passing_all"), F.count_if("core").alias("models_passing_core"), category.alias("classification"))


def incremental_assessment(paired: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Does the treatment beat its control in mean, median and most folds?"""
    keep = F.lit(False)
    for m, r in pairs:
        keep = keep | ((F.col("model") == m) & (F.col("reference") == r))
    mean, median, wins = F.col("mean_delta_MAE") < 0, F.col("median_delta_MAE") < 0, F.col("win_rate") > 0.5
    category = (
        F.when(F.some(mean & median & wins), "ROBUST_INCREMENTAL_FUNDAMENTAL_VALUE").when(~F.some(mean & wins), "NO_ROBUST_INCREMENTAL_FUNDAMENTAL_VALUE")
        .otherwise("MIXED_OR_REGIME_DEPENDENT_INCREMENTAL_VALUE")
    )
    return paired.filter(keep).groupBy("symbol").agg(category.alias("classification"))


def mechanism_assessment(endpoints: DataFrame, last_fold: str = "3") -> DataFrame:
    """Did the treatment shrink the control's extremes? Endpoints per (symbol, scope, family, arm).

    Supported: every last-fold endpoint falls to 0.75 of the control or less, every pooled endpoint falls, and
    no earlier fold becomes more extreme. Partial: any last-fold endpoint does.
    """
    names = ("outside_fraction", "max_abs_z", "mean_abs_prediction")
    tags = ("count_gt_0_10", "count_gt_0_30")
    cols = (*names, *tags)
    wide = endpoints.groupBy("symbol", "scope", "family").agg(
        *[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("control", "treatment") for c in cols]
    )

    def ratio(c: str) -> Column:
        t, k = F.col(f"treatment_{c}"), F.col(f"control_{c}")
        return F.when(k > 0, t / k).when(t == 0, 1.0)

    material = sum((F.coalesce(ratio(c) <= 0.75, F.lit(False)).cast("int") for c in names), F.lit(0))
    improved = sum((F.coalesce(ratio(c) < 1, F.lit(False)).cast("int") for c in names), F.lit(0))
    worse = ((F.col("treatment_max_abs_z") > 5) & (F.col("treatment_max_abs_z") > F.col("control_max_abs_z")))
    for c in tags:
        worse = worse | (F.col(f"treatment_{c}") > F.col(f"control_{c}"))
    last, pooled = F.col("scope") == last_fold, F.col("scope") == "pooled"
    per = wide.groupBy("symbol").agg(
        F.sum(F.when(last, material)).alias("material_endpoints"),
        (F.count_if(last) * len(names)).alias("endpoint_count"),
        F.every(F.when(pooled, improved == len(names)).otherwise(True)).alias("pooled_all_improve"),
        F.count_if(~last & ~pooled & worse).alias("new_instability"),
    )
    category = (
        F.when((F.col("material_endpoints") == F.col("endpoint_count")) & F.col("pooled_all_improve") & (F.col("new_instability") == 0), "SUPPORTED")
        .when(F.col("material_endpoints") > 0, "PARTIALLY_SUPPORTED_OR_INCONCLUSIVE")
        .otherwise("NOT_SUPPORTED")
    )
    return per.withColumn("category", category)


def signal_assessment(calibrated: DataFrame, advantage: DataFrame, signs: DataFrame, cosine: DataFrame, association: DataFrame) -> DataFrame:
    """Conservative synthesis per symbol over calibration, advantage over zero, coefficient and association stability.

    Inputs are per-fold tables keyed by symbol and family: calibrated(slope, Pearson, Spearman, mean_bias,
    std_actual, dispersion_ratio), advantage(beat fraction, n), signs(consistent share), cosine(similarity),
    and association with match fractions per scope.
    """
    tol = 1e-15
    c = calibrated.join(advantage, ["symbol", "fold", "family"])
    s, f = F.col("calibration_slope"), F.col("beat_fraction")
    near = F.abs(f - 0.5) <= 1 / F.col("n") + tol
    problem = (
        (F.abs("mean_bias") / F.col("std_actual") > 0.25) | ~F.col("dispersion_ratio").between(0.75, 1.25) | ~s.between(0.75, 1.25)
    )
    per = c.groupBy("symbol", "family").agg(
        F.every(s > tol).alias("a"), F.every(F.col("Pearson") > tol).alias("b"), F.count_if(F.col("Spearman") > tol).alias("sp"),
        F.count_if((f > 0.5) & ~near).alias("majority"), F.count_if((f <= 0.5) & ~near).alias("nonmajority"), F.count_if(problem).alias("problems"),
        (F.some(s > tol) & F.some(s < -tol) | (F.count_if(s <= tol) >= 2)).alias("slope_unstable"),
        F.every(s.isNotNull() & F.col("Pearson").isNotNull() & F.col("Spearman").isNotNull() & F.col("dispersion_ratio").isNotNull()).alias("defined"),
    )
    co = cosine.groupBy("symbol", "family").agg(F.every(F.col("cosine_similarity") > 0).alias("cos_ok"), F.count_if(F.col("cosine_similarity") <= 0).alias("cos_bad"))
    sg = signs.groupBy("symbol", "family").agg(F.avg(F.col("sign_consistent_all_folds").cast("double")).alias("share"))
    match = (F.col("pearson_match_fraction"), F.col("spearman_match_fraction"))
    pooled = F.col("scope") == "pooled"
    asc = association.groupBy("symbol").agg(
        F.max(F.when(pooled, (match[0] >= 0.5) & (match[1] >= 0.5))).alias("assoc_ok"),
        (F.count_if(~pooled & (match[0] <= 0.5) & (match[1] <= 0.5)) >= 2).alias("assoc_bad"),
    )
    j = per.join(co, ["symbol", "family"]).join(sg, ["symbol", "family"]).join(asc, "symbol")
    signal = (
        F.col("defined") & F.col("a") & F.col("b") & (F.col("sp") >= 2) & (F.col("majority") >= 2) & (F.col("problems") >= 2)
        & (F.col("share") >= 0.5) & F.col("cos_ok") & F.col("assoc_ok")
    )
    weak = F.col("defined") & (F.col("nonmajority") >= 2) & F.col("slope_unstable") & ((F.col("share") < 0.5) | (F.col("cos_bad") >= 2) | F.col("assoc_bad"))
    category = (
        F.when(F.every(F.coalesce(signal, F.lit(False))), "SIGNAL_WITH_CALIBRATION_INSTABILITY")
        .when(F.every(F.coalesce(weak, F.lit(False))), "WEAK_OR_TEMPORALLY_UNSTABLE_SIGNAL").otherwise("MIXED_OR_INCONCLUSIVE")
    )
    return j.groupBy("symbol").agg(category.alias("category"))
