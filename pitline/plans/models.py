"""Fold-local fits, out-of-fold metrics and stability diagnostics.

Arms of one feature have a closed form in SQL; they run through exactly the code that fits wider arms.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.config import FUNDAMENTAL_FEATURES, MARKET_FEATURES, PRIMARY_HORIZON, PRIMARY_TARGET, RELATIVE_FEATURES, TIE_TOL
from pitline.functions.numeric import rnd
from pitline.operators import metrics as met
from pitline.operators import models as mod
from pitline.operators import splits
from pitline.operators import stability as stab
from pitline.operators import variants as var
from pitline.operators.rolling import with_relative
from pitline.plans.market import rounded
from pitline.plans.registry import Tables, query
from pitline.plans.sql import R, corr, cte

SINGLE = ("daily_range", "rolling_volatility_20", "sma_20", "close_to_sma_20")
ARMS1 = {f: (f,) for f in SINGLE}
NAMES1 = [f"{f}_{m}" for f in SINGLE for m in ("ols", "ridge")]
WIDE = (*MARKET_FEATURES, *[c for c in RELATIVE_FEATURES if c not in MARKET_FEATURES], *FUNDAMENTAL_FEATURES)
ARMS_WIDE = {"original": MARKET_FEATURES, "relative": RELATIVE_FEATURES, "fundamentals": (*RELATIVE_FEATURES, *FUNDAMENTAL_FEATURES)}
MARKET_WIDE = (*MARKET_FEATURES, *[c for c in RELATIVE_FEATURES if c not in MARKET_FEATURES])
ARMS_MARKET = {"control": MARKET_FEATURES, "treatment": RELATIVE_FEATURES}


class Study:
    """Members, preprocessing, fits and predictions of one fold scheme and set of arms."""

    def __init__(self, members, entries, sessions, features, arms):
        self.members, self.entries, self.sessions, self.features, self.arms = members, entries, sessions, features, arms

    @classmethod
    def walk(cls, frame, features, arms):
        return cls(splits.walk_forward_members(frame), splits.walk_forward_entries(frame), splits.walk_forward_sessions(frame), features, arms)

    @classmethod
    def cv(cls, frame, features, arms):
        return cls(splits.cv_members(frame), splits.cv_entries(frame), splits.cv_sessions(frame), features, arms)

    @classmethod
    def cv_kept(cls, frame, features, arms):
        """Sessions are kept once with the columns that fits and scores read; members and entries are their rows, none copied to folds."""
        sessions = splits.cv_sessions(frame).select("symbol", "date", PRIMARY_TARGET, *features, "entry", "valid", "folds").persist(StorageLevel.MEMORY_AND_DISK)
        scored = sessions.filter("valid IS NOT NULL").withColumns({"fold": F.col("valid"), "role": F.lit("validation")})
        return cls(scored, sessions.filter("entry IS NOT NULL"), sessions, features, arms)

    @cached_property
    def folds(self):
        # a row per symbol and fold, read by fits and predictions
        return mod.fit_folds(self.sessions, self.arms, self.features, diagnose=False).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def params(self):
        # a few numbers per symbol, fold and feature, read by both the fit and the scoring
        return mod.fit_expanding(self.entries, self.features).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def train_z(self):
        return mod.training_rows(self.members, self.params, self.features)

    @cached_property
    def fits(self):
        return mod.fits_of(mod.fit_folds(self.sessions, self.arms, self.features))

    @cached_property
    def table(self):
        return mod.parameters(mod.fits_of(self.folds), self.arms)

    @cached_property
    def oof(self):
        return mod.predictions_of(self.folds, self.arms)

    @cached_property
    def z(self):
        return mod.zscores(self.members, self.params, self.features)

    @cached_property
    def associations(self):
        return stab.sign_changes(mod.fold_associations(self.sessions, self.features))

    def influence(self, arm):
        return mod.fold_influence(self.sessions, arm, self.arms, self.features)


def labelled_frame(t: Tables, once: bool):
    """The labelled bars, kept only for plans that read them several times."""
    return with_relative(t.market_labelled if once else t.market_labelled_shared)


def walk1(t: Tables, once: bool = False) -> Study:
    return Study.walk(labelled_frame(t, once), SINGLE, ARMS1)


def replayed(t: Tables) -> tuple[Study, DataFrame]:
    """A study whose predictions are rebuilt from its parameter table, and its stored predictions, dealt by fold before a row becomes one for each model."""
    s = Study.cv_kept(labelled_frame(t, once=True), SINGLE, ARMS1)
    stored = mod.predictions_of(s.folds.repartition("symbol", "fold"), s.arms)
    return s, stored.filter(~F.col("model").isin("zero_return", "historical_mean"))


def cv1(t: Tables, once: bool = False) -> Study:
    return Study.cv(labelled_frame(t, once), SINGLE, ARMS1)


# ---- SQL views -------------------------------------------------------------------------------------
cte(
    "cv_candidates",
    """SELECT l.*, s.i::INTEGER AS fold, s.start_date AS fold_start,
 CASE WHEN l.pos < s.start_pos AND forward_return_5d IS NOT NULL AND target_exit_date_5d < s.start_date THEN 'train' WHEN l.vfold = s.i THEN 'validation' END AS role
FROM layout_v l JOIN starts_v s ON s.symbol = l.symbol AND s.fold <> 'final' JOIN ready_v r ON r.symbol = l.symbol AND r.sufficient""",
)
cte("feature_x", "SELECT *, close / sma_5 - 1 AS close_to_sma_5, close / sma_20 - 1 AS close_to_sma_20, close / sma_60 - 1 AS close_to_sma_60 FROM features")
for _p in ("wf", "cv"):
    _long = " UNION ALL ".join(
        f"""SELECT c.symbol, c.fold, c.role, c.date, c.forward_return_5d AS y, '{f}' AS feature, x.{f} AS raw
FROM {_p}_candidates c JOIN feature_x x USING (symbol, date) WHERE c.role IN ('train', 'validation')"""
        for f in SINGLE
    )
    cte(f"{_p}_long", _long)
    cte(
        f"{_p}_params",
        f"""SELECT l.symbol, l.fold, l.feature, any_value(n_train) AS n_train, any_value(n) AS n, any_value(n)::DOUBLE / any_value(n_train) AS coverage,
 any_value(med) AS median, avg(coalesce(raw, med)) AS mean, stddev_pop(coalesce(raw, med)) AS std, any_value(y_mean) AS y_mean,
 min(raw) AS train_min, max(raw) AS train_max
FROM {_p}_long l JOIN (SELECT symbol, fold, feature, count(*) AS n_train, count(raw) AS n, median(raw) AS med, avg(y) AS y_mean FROM {_p}_long
   WHERE role = 'train' GROUP BY ALL) m USING (symbol, fold, feature) WHERE role = 'train' GROUP BY ALL""",
    )
    cte(
        f"{_p}_z",
        f"""SELECT l.*, p.median, p.mean, p.std, p.y_mean, p.train_min, p.train_max, coalesce(l.raw, p.median) AS imputed,
 (coalesce(l.raw, p.median) - p.mean) / p.std AS z FROM {_p}_long l JOIN {_p}_params p USING (symbol, fold, feature)""",
    )
    cte(
        f"{_p}_fit",
        f"""SELECT symbol, fold, feature, any_value(y_mean) AS intercept, sum(z * (y - y_mean)) / sum(z * z) AS ols,
 sum(z * (y - y_mean)) / (sum(z * z) + 1.0) AS ridge FROM {_p}_z WHERE role = 'train' GROUP BY ALL""",
    )
    cte(
        f"{_p}_table",
        f"""SELECT symbol, fold, feature AS arm, 'ols' AS family, intercept, feature, ols AS coefficient FROM {_p}_fit
UNION ALL SELECT symbol, fold, feature, 'ridge', intercept, feature, ridge FROM {_p}_fit""",
    )
    cte(
        f"{_p}_oof",
        f"""SELECT symbol, fold, date, feature || '_ols' AS model, y AS actual, intercept + ols * z AS prediction FROM {_p}_z JOIN {_p}_fit USING (symbol, fold, feature) WHERE role = 'validation'
UNION ALL SELECT symbol, fold, date, feature || '_ridge', y, intercept + ridge * z FROM {_p}_z JOIN {_p}_fit USING (symbol, fold, feature) WHERE role = 'validation'
UNION ALL SELECT symbol, fold, date, 'zero_return', y, 0.0::DOUBLE FROM {_p}_z WHERE role = 'validation' AND feature = 'sma_20'
UNION ALL SELECT symbol, fold, date, 'historical_mean', y, y_mean FROM {_p}_z WHERE role = 'validation' AND feature = 'sma_20'""",
    )


def rsql(cols, digits: int = 6) -> str:
    return ", ".join(f"{R(c, digits)} AS {c}" for c in cols)


# ---- preprocessing and fits ------------------------------------------------------------------------
_pc = ("coverage", "median", "mean", "std", "train_min", "train_max", "y_mean")


@query(
    "fold_preprocessing",
    "M2 V18 A24",
    f"SELECT symbol, fold, feature, n_train, n, 'used' AS drop_reason, {rsql(_pc)} FROM wf_params",
)
def _(t: Tables):
    u = mod.usage(walk1(t, once=True).params)
    return rounded(u, ["symbol", "fold", "feature", "n_train", "n", "drop_reason"], _pc)


@query(
    "model_parameters",
    "M3 M7",
    f"SELECT symbol, fold, arm, family, feature, {rsql(('intercept', 'coefficient'))} FROM wf_table",
)
def _(t: Tables):
    return rounded(walk1(t, once=True).table, ["symbol", "fold", "arm", "family", "feature"], ("intercept", "coefficient"))


@query(
    "cv_predictions",
    "M4 M5",
    f"SELECT symbol, fold, date, model, {rsql(('actual', 'prediction'))} FROM cv_oof",
)
def _(t: Tables):
    return rounded(cv1(t, once=True).oof, ["symbol", "fold", "date", "model"], ("actual", "prediction"))


@query(
    "walk_forward_predictions",
    "M4 M7",
    f"SELECT symbol, fold, date, model, {rsql(('actual', 'prediction'))} FROM wf_oof",
)
def _(t: Tables):
    return rounded(walk1(t, once=True).oof, ["symbol", "fold", "date", "model"], ("actual", "prediction"))


@query(
    "scores_from_parameter_table",
    "J16 M11",
    f"SELECT symbol, fold, date, model, {rsql(('actual', 'prediction'))} FROM cv_oof WHERE model NOT IN ('zero_return', 'historical_mean')",
)
def _(t: Tables):
    s, _ = replayed(t)
    rebuilt = mod.score_from_table(s.members, s.params, s.table, SINGLE)
    return rounded(rebuilt, ["symbol", "fold", "date", "model"], ("actual", "prediction"))


@query(
    "prediction_rebuild_audit",
    "V16 C7",
    """SELECT symbol, model, count(*) AS rows_checked, 0::BIGINT AS identity_violations, 0::BIGINT AS actual_violations, 0::BIGINT AS tolerance_violations
FROM cv_oof WHERE model NOT IN ('zero_return', 'historical_mean') GROUP BY ALL""",
)
def _(t: Tables):
    s, stored = replayed(t)
    return met.control_reproduction(mod.score_from_table(s.members, s.params, s.table, SINGLE), stored).drop("max_absolute_difference")


@query("walk_forward_wide_models", "M3 M7 M8")
def _(t: Tables):
    s = Study.walk(with_relative(t.labelled), WIDE, ARMS_WIDE)
    return met.fold_mae(s.oof)


@query("representation_models", "M8 A23")
def _(t: Tables):
    s = Study.walk(labelled_frame(t, once=True), MARKET_WIDE, ARMS_MARKET)
    return met.prediction_summary(s.oof, ["symbol", "model"])


@query("design_conditioning", "M9")
def _(t: Tables):
    s = Study.cv(labelled_frame(t, once=True), MARKET_WIDE, ARMS_MARKET)
    return mod.conditioning(s.fits)


@query("training_influence", "M10")
def _(t: Tables):
    return Study.cv(labelled_frame(t, once=True), MARKET_WIDE, ARMS_MARKET).influence("treatment")


_ic = ("actual", "fitted", "residual", "leverage", "residual_mse", "studentised_residual", "cooks_distance")


@query(
    "single_feature_influence",
    "M10",
    f"""WITH r AS (SELECT z.symbol, z.fold, z.date, z.y AS actual, f.intercept + f.ols * z.z AS fitted, z.z, p.n_train AS n
  FROM cv_z z JOIN cv_fit f USING (symbol, fold, feature) JOIN cv_params p USING (symbol, fold, feature) WHERE feature = 'sma_20' AND role = 'train'),
g AS (SELECT *, actual - fitted AS residual, 1.0 / n + z * z / n AS leverage, sum((actual - fitted) ^ 2) OVER (PARTITION BY symbol, fold) / (n - 2) AS residual_mse FROM r),
h AS (SELECT *, residual / sqrt(residual_mse * (1 - leverage)) AS studentised_residual,
  residual * residual / (2 * residual_mse) * leverage / ((1 - leverage) * (1 - leverage)) AS cooks_distance FROM g)
SELECT symbol, fold, date, {rsql(_ic)}, 2::INTEGER AS design_rank, (n - 2)::BIGINT AS residual_df, 'defined' AS undefined_reason FROM h""",
)
def _(t: Tables):
    x = cv1(t, once=True).influence("sma_20")
    return rounded(x, ["symbol", "fold", "date", "design_rank", "residual_df", "undefined_reason"], _ic)


_gp = [(a, b) for i, a in enumerate(SINGLE) for b in SINGLE[i:]]
_gs = " UNION ALL ".join(
    [
        f"""SELECT a.symbol, a.fold, '{x}' AS a, '{y}' AS b, count(*) AS n, {R('sum(a.z * b.z)')} AS total FROM cv_z a JOIN cv_z b USING (symbol, fold, date)
 WHERE a.feature = '{x}' AND b.feature = '{y}' AND a.role = 'train' GROUP BY ALL"""
        for x, y in _gp
    ]
    + [f"SELECT symbol, fold, feature, 'y', count(*), {R('sum(z * y)')} FROM cv_z WHERE role = 'train' GROUP BY ALL"]
    + [f"SELECT symbol, fold, feature, '1', count(*), {R('sum(z)')} FROM cv_z WHERE role = 'train' GROUP BY ALL"]
)


@query("normal_equations", "A37", f"SELECT * FROM ({_gs})")
def _(t: Tables):
    return rounded(stab.gramian(cv1(t).train_z, SINGLE), ["symbol", "fold", "a", "b", "n"], ("total",))


_tc = " UNION ALL ".join(
    f"SELECT a.symbol, a.fold, {corr('a.z', 'b.z')} AS r FROM cv_z a JOIN cv_z b USING (symbol, fold, date) WHERE a.feature = '{x}' AND b.feature = '{y}' AND a.role = 'train' GROUP BY ALL"
    for x, y in _gp
    if x != y
)


@query(
    "training_collinearity",
    "M9 A9",
    f"""SELECT symbol, fold, {R('max(abs(r))')} AS max_abs_pairwise_correlation, count_if(abs(r) >= 0.95)::BIGINT AS high_correlation_pairs,
 count_if(r IS NULL)::BIGINT AS undefined_pairs FROM ({_tc}) GROUP BY ALL""",
)
def _(t: Tables):
    c = mod.training_correlations(cv1(t).train_z, SINGLE)
    return rounded(c, ["symbol", "fold", "high_correlation_pairs", "undefined_pairs"], ("max_abs_pairwise_correlation",))


# ---- metrics ---------------------------------------------------------------------------------------
def metric_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, avg(abs(actual - prediction)) AS MAE, sqrt(avg((actual - prediction) ^ 2)) AS RMSE,
 CASE WHEN count(*) >= 2 AND min(actual) < max(actual) THEN 1 - sum((actual - prediction) ^ 2) / (var_pop(actual) * count(*)) END AS R2,
 {corr('actual', 'prediction')} AS Pearson, {corr('ra', 'rp')} AS Spearman, avg((sign(actual) = sign(prediction))::INTEGER) AS directional_accuracy
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY actual) + (count(*) OVER (PARTITION BY {keys}, actual) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY {keys} ORDER BY prediction) + (count(*) OVER (PARTITION BY {keys}, prediction) - 1) / 2.0 AS rp FROM {src}) GROUP BY ALL"""


_scoped = "(SELECT *, fold::VARCHAR AS scope FROM cv_oof UNION ALL SELECT *, 'pooled' FROM cv_oof)"


@query(
    "regression_metrics",
    "A17 A19 U1 W6",
    f"SELECT symbol, scope, model, n, {rsql(met.METRICS)} FROM ({metric_sql(_scoped, 'symbol, scope, model')})",
)
def _(t: Tables):
    m = met.regression_metrics(met.with_scopes(cv1(t, once=True).oof), ["symbol", "scope", "model"])
    return rounded(m, ["symbol", "scope", "model", "n"], met.METRICS)


_mm = ", ".join(f"avg({m}) AS mean_fold_{m}" for m in met.METRICS)
_pm = ", ".join(f"{m} AS pooled_oof_{m}" for m in met.METRICS)
_sc = [*[f"mean_fold_{m}" for m in met.METRICS], "std_fold_MAE", *[f"pooled_oof_{m}" for m in met.METRICS]]


@query(
    "cv_summary",
    "A18",
    f"""SELECT symbol, model, folds, {rsql(_sc)}, rank() OVER (PARTITION BY symbol ORDER BY mean_fold_MAE)::INTEGER AS rank_by_mean_fold_MAE
FROM (SELECT symbol, model, count(*) AS folds, {_mm}, stddev_samp(MAE) AS std_fold_MAE FROM ({metric_sql('cv_oof', 'symbol, model, fold')}) GROUP BY ALL)
JOIN (SELECT symbol, model, {_pm} FROM ({metric_sql('cv_oof', 'symbol, model')})) USING (symbol, model)""",
)
def _(t: Tables):
    return rounded(met.cv_summary(cv1(t, once=True).oof), ["symbol", "model", "folds", "rank_by_mean_fold_MAE"], _sc)


PAIRS = [*[(m, r) for m in NAMES1 for r in ("zero_return", "historical_mean")], ("close_to_sma_20_ols", "sma_20_ols"), ("close_to_sma_20_ridge", "sma_20_ridge")]
_pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
cte("wf_mae", "SELECT symbol, fold, model, count(*) AS rows, avg(abs(actual - prediction)) AS MAE, avg(prediction - actual) AS bias FROM wf_oof GROUP BY ALL")
cte(
    "paired_v",
    f"""SELECT symbol, model, reference, count(*) AS fold_count, avg(d) AS mean_delta_MAE, median(d) AS median_delta_MAE,
 count_if(d < 0)::BIGINT AS wins, count_if(d > 0)::BIGINT AS losses, count_if(d = 0)::BIGINT AS ties, avg((d < 0)::INTEGER) AS win_rate
FROM (SELECT a.symbol, a.model, b.model AS reference, CASE WHEN abs(a.MAE - b.MAE) <= {TIE_TOL} THEN 0.0::DOUBLE ELSE a.MAE - b.MAE END AS d FROM wf_mae a JOIN wf_mae b USING (symbol, fold)
      JOIN (VALUES {_pairs}) p(m, r) ON p.m = a.model AND p.r = b.model) GROUP BY ALL""",
)
_pd = ("mean_delta_MAE", "median_delta_MAE", "win_rate")


@query(
    "paired_comparison",
    "A26 M8 J8",
    f"SELECT symbol, model, reference, fold_count, wins, losses, ties, {rsql(_pd)} FROM paired_v",
)
def _(t: Tables):
    p = met.paired_comparison(met.fold_mae(walk1(t, once=True).oof), PAIRS)
    return rounded(p, ["symbol", "model", "reference", "fold_count", "wins", "losses", "ties"], _pd)


@query(
    "yearly_diagnostics",
    "A27",
    f"""SELECT a.symbol, a.year, a.model, a.rows, {R('a.MAE')} AS MAE, {R('a.MAE - z.MAE')} AS delta_vs_zero_return, {R('a.MAE - h.MAE')} AS delta_vs_historical_mean
FROM (SELECT symbol, year(date)::INTEGER AS year, model, count(*) AS rows, avg(abs(actual - prediction)) AS MAE FROM wf_oof GROUP BY ALL) a
JOIN (SELECT symbol, year(date) AS year, avg(abs(actual - prediction)) AS MAE FROM wf_oof WHERE model = 'zero_return' GROUP BY ALL) z USING (symbol, year)
JOIN (SELECT symbol, year(date) AS year, avg(abs(actual - prediction)) AS MAE FROM wf_oof WHERE model = 'historical_mean' GROUP BY ALL) h USING (symbol, year)""",
)
def _(t: Tables):
    y = met.yearly(walk1(t, once=True).oof)
    return rounded(y, ["symbol", "year", "model", "rows"], ("MAE", "delta_vs_zero_return", "delta_vs_historical_mean"))


_ms = ("mean_fold_MAE", "median_fold_MAE", "pooled_MAE")


@query(
    "model_summary",
    "A26",
    f"""SELECT symbol, model, count(*) AS fold_count, sum(rows)::BIGINT AS oof_rows, {R('avg(MAE)')} AS mean_fold_MAE, {R('median(MAE)')} AS median_fold_MAE,
 {R('sum(MAE * rows) / sum(rows)')} AS pooled_MAE FROM wf_mae GROUP BY ALL""",
)
def _(t: Tables):
    return rounded(met.model_summary(walk1(t, once=True).oof), ["symbol", "model", "fold_count", "oof_rows"], _ms)


_cal = ("mean_actual", "mean_prediction", "mean_bias", "median_error", "median_absolute_error")
SLOPE = "CASE WHEN min(prediction) < max(prediction) THEN covar_pop(prediction, actual) / var_pop(prediction) END"


@query(
    "calibration",
    "A21 A19",
    f"""SELECT symbol, scope, model, count(*) AS n, {R('avg(actual)')} AS mean_actual, {R('avg(prediction)')} AS mean_prediction,
 {R('avg(prediction - actual)')} AS mean_bias, {R('median(prediction - actual)')} AS median_error, {R('median(abs(prediction - actual))')} AS median_absolute_error,
 {R(SLOPE, 4)} AS calibration_slope, {R(f'avg(actual) - ({SLOPE}) * avg(prediction)', 4)} AS calibration_intercept,
 CASE WHEN min(prediction) = max(prediction) THEN 'constant_prediction' ELSE 'defined' END AS calibration_undefined_reason FROM {_scoped} GROUP BY ALL""",
)
def _(t: Tables):
    from pitline.functions.numeric import rnd

    c = met.calibration(met.with_scopes(cv1(t, once=True).oof), ["symbol", "scope", "model"])
    return c.select(
        "symbol", "scope", "model", "n", "calibration_undefined_reason", *[rnd(x).alias(x) for x in _cal],
        rnd("calibration_slope", 4).alias("calibration_slope"), rnd("calibration_intercept", 4).alias("calibration_intercept"),
    )


@query(
    "dispersion",
    "A22",
    f"""SELECT symbol, fold, model, dispersion_undefined_reason, {rsql(('std_actual', 'std_prediction', 'actual_min', 'actual_max', 'dispersion_ratio'))} FROM (
SELECT *, CASE WHEN std_actual > 0 THEN std_prediction / std_actual END AS dispersion_ratio, CASE WHEN std_actual > 0 THEN 'defined' ELSE 'constant_actual' END AS dispersion_undefined_reason
FROM (SELECT symbol, fold, model, stddev_samp(actual) AS std_actual, CASE WHEN min(prediction) = max(prediction) THEN 0.0 ELSE stddev_samp(prediction) END AS std_prediction,
 min(actual) AS actual_min, max(actual) AS actual_max FROM cv_oof GROUP BY ALL))""",
)
def _(t: Tables):
    d = met.dispersion(cv1(t, once=True).oof, ["symbol", "fold", "model"])
    return rounded(d, ["symbol", "fold", "model", "dispersion_undefined_reason"], ("std_actual", "std_prediction", "actual_min", "actual_max", "dispersion_ratio"))


@query(
    "baseline_advantage",
    "A20 J9",
    f"""SELECT symbol, fold, model, anchor, count(*) AS n, {R('avg(d)')} AS mean_delta_AE, {R('median(d)')} AS median_delta_AE,
 count_if(d < -1e-15)::BIGINT AS model_beats, count_if(d > 1e-15)::BIGINT AS anchor_beats, count_if(abs(d) <= 1e-15)::BIGINT AS ties
FROM (SELECT m.symbol, m.fold, m.model, b.model AS anchor, abs(m.actual - m.prediction) - abs(b.actual - b.prediction) AS d
 FROM cv_oof m JOIN cv_oof b USING (symbol, fold, date) WHERE b.model IN ('zero_return', 'historical_mean') AND m.model NOT IN ('zero_return', 'historical_mean')) GROUP BY ALL""",
)
def _(t: Tables):
    a = met.baseline_advantage(cv1(t, once=True).oof, ("zero_return", "historical_mean"), ["symbol", "fold"])
    return rounded(a, ["symbol", "fold", "model", "anchor", "n", "model_beats", "anchor_beats", "ties"], ("mean_delta_AE", "median_delta_AE"))


_ps = ["prediction_mean", "prediction_std", "prediction_median", "prediction_min", "prediction_max", "mean_abs_prediction", "median_abs_prediction", "max_abs_prediction"]
_psq = ", ".join(
    f"count_if(abs(prediction) > 0.{k}0)::BIGINT AS count_abs_gt_0_{k}0, {R(f'avg((abs(prediction) > 0.{k}0)::INTEGER)')} AS fraction_abs_gt_0_{k}0" for k in (1, 2, 3)
)


@query(
    "prediction_summary",
    "A23",
    f"""SELECT symbol, fold, model, {R('avg(prediction)')} AS prediction_mean, {R('CASE WHEN min(prediction) = max(prediction) THEN 0 ELSE stddev_samp(prediction) END')} AS prediction_std,
 {R('median(prediction)')} AS prediction_median, {R('min(prediction)')} AS prediction_min, {R('max(prediction)')} AS prediction_max, {R('avg(abs(prediction))')} AS mean_abs_prediction,
 {R('median(abs(prediction))')} AS median_abs_prediction, {R('max(abs(prediction))')} AS max_abs_prediction, {_psq} FROM cv_oof GROUP BY ALL""",
)
def _(t: Tables):
    p = met.prediction_summary(cv1(t, once=True).oof, ["symbol", "fold", "model"])
    frac = [f"fraction_abs_gt_0_{k}0" for k in (1, 2, 3)]
    return rounded(p, ["symbol", "fold", "model", *[f"count_abs_gt_0_{k}0" for k in (1, 2, 3)]], (*_ps, *frac))


cte(
    "errors_v",
    """SELECT *, actual - prediction AS residual, abs(actual - prediction) AS ae, rank() OVER (PARTITION BY symbol, fold, model ORDER BY abs(actual - prediction) DESC) AS error_rank,
 row_number() OVER (PARTITION BY symbol, fold, model ORDER BY abs(actual - prediction) DESC, date) AS pos FROM cv_oof""",
)


@query(
    "error_table",
    "M12 W6",
    f"SELECT symbol, fold, date, model, error_rank::INTEGER AS error_rank, {R('residual')} AS residual, {R('ae')} AS absolute_error, {R('ae * ae')} AS squared_error FROM errors_v",
)
def _(t: Tables):
    e = met.error_table(cv1(t, once=True).oof)
    return rounded(e, ["symbol", "fold", "date", "model", "error_rank"], ("residual", "absolute_error", "squared_error"))


@query(
    "largest_errors",
    "K3",
    f"SELECT symbol, fold, model, date, pos::INTEGER AS position, {R('ae')} AS absolute_error FROM errors_v WHERE pos <= 5",
)
def _(t: Tables):
    return rounded(met.top_errors(cv1(t, once=True).oof), ["symbol", "fold", "model", "date", "position"], ("absolute_error",))


_ec = ("largest_absolute_error", "absolute_error_mean", "absolute_error_median", "top_3_share", "top_5_share")


@query(
    "error_concentration",
    "A38",
    f"""SELECT symbol, fold, model, {R('max(ae)')} AS largest_absolute_error, any_value(date) FILTER (pos = 1) AS largest_error_date, {R('avg(ae)')} AS absolute_error_mean,
 {R('median(ae)')} AS absolute_error_median, {R('sum(ae) FILTER (pos <= 3) / sum(ae)')} AS top_3_share, {R('sum(ae) FILTER (pos <= 5) / sum(ae)')} AS top_5_share,
 count_if(ae > 0.10)::BIGINT AS count_gt_0_10, count_if(ae > 0.20)::BIGINT AS count_gt_0_20 FROM errors_v GROUP BY ALL""",
)
def _(t: Tables):
    c = met.error_concentration(cv1(t, once=True).oof)
    return rounded(c, ["symbol", "fold", "model", "largest_error_date", "count_gt_0_10", "count_gt_0_20"], _ec)


@query(
    "control_reproduction",
    "C7",
    "SELECT symbol, model, count(*) AS rows_checked, 0::BIGINT AS identity_violations, 0::BIGINT AS actual_violations, 0.0::DOUBLE AS max_absolute_difference, 0::BIGINT AS tolerance_violations FROM cv_oof GROUP BY ALL",
)
def _(t: Tables):
    # the stored run comes from the same rows in a different order
    stored = Study.cv(with_relative(t.market_labelled_shared.repartition("date")), SINGLE, ARMS1).oof
    r = met.control_reproduction(cv1(t).oof, stored)
    return rounded(r, [c for c in r.columns if c != "max_absolute_difference"], ("max_absolute_difference",))


# ---- stability -------------------------------------------------------------------------------------
@query(
    "range_drift",
    "A24",
    f"""SELECT symbol, fold, feature, count(raw) AS validation_non_null_count, count_if(raw < train_min)::BIGINT AS below_training_min, count_if(raw > train_max)::BIGINT AS above_training_max,
 count_if(raw < train_min OR raw > train_max)::BIGINT AS outside_training_range, {R('count_if(raw < train_min OR raw > train_max)::DOUBLE / nullif(count(raw), 0)')} AS outside_fraction
FROM wf_z WHERE role = 'validation' GROUP BY ALL""",
)
def _(t: Tables):
    d = stab.range_drift(walk1(t).z)
    return rounded(d, d.columns[:-1], ("outside_fraction",))


_zs = ("max_abs_z", "median_abs_z", "p95_abs_z", "fraction_gt_3", "fraction_gt_5")


@query(
    "zscore_summary",
    "A25",
    f"""SELECT symbol, fold, count(z) AS value_count, count_if(abs(z) > 3)::BIGINT AS count_gt_3, count_if(abs(z) > 5)::BIGINT AS count_gt_5, {R('max(abs(z))')} AS max_abs_z,
 {R('median(abs(z))')} AS median_abs_z, {R('quantile_cont(abs(z), 0.95)')} AS p95_abs_z, {R('avg((abs(z) > 3)::INTEGER)')} AS fraction_gt_3, {R('avg((abs(z) > 5)::INTEGER)')} AS fraction_gt_5
FROM wf_z WHERE role = 'validation' GROUP BY ALL""",
)
def _(t: Tables):
    return rounded(stab.z_summary(walk1(t).z, ["symbol", "fold"]), ["symbol", "fold", "value_count", "count_gt_3", "count_gt_5"], _zs)


@query(
    "validation_zscores",
    "M13 M11",
    f"SELECT symbol, fold, date, feature, raw IS NULL AS was_missing, {rsql(('raw', 'imputed', 'median', 'mean'))}, {R('std')} AS scale, {R('z')} AS z, {R('abs(z)')} AS abs_z FROM cv_z WHERE role = 'validation'",
)
def _(t: Tables):
    return rounded(cv1(t).z, ["symbol", "fold", "date", "feature", "was_missing"], ("raw", "imputed", "median", "mean", "scale", "z", "abs_z"))


# one coefficient vector per fold: the single-feature arms side by side
def panel(s: Study):
    return s.table.withColumn("arm", F.lit("panel"))


cte(
    "contrib_v",
    """SELECT z.symbol, z.fold, z.date, t.family, z.feature, t.coefficient * z.z AS c FROM cv_z z JOIN cv_table t USING (symbol, fold, feature) WHERE role = 'validation'""",
)


@query(
    "contributions",
    "W13",
    f"""SELECT symbol, fold, date, family, feature, {R('c')} AS contribution, rank() OVER (PARTITION BY symbol, fold, date, family ORDER BY abs(c) DESC)::INTEGER AS abs_rank,
 CASE WHEN c > 0 THEN rank() OVER (PARTITION BY symbol, fold, date, family ORDER BY c DESC) END::INTEGER AS positive_rank,
 CASE WHEN c < 0 THEN rank() OVER (PARTITION BY symbol, fold, date, family ORDER BY c) END::INTEGER AS negative_rank FROM contrib_v""",
)
def _(t: Tables):
    s = cv1(t)
    c = stab.contributions(s.z, panel(s))
    return rounded(c, ["symbol", "fold", "date", "family", "feature", "abs_rank", "positive_rank", "negative_rank"], ("contribution",))


@query(
    "top_drivers",
    "K4",
    f"""SELECT symbol, fold, date, family, feature, direction, driver::INTEGER AS driver, {R('c')} AS contribution FROM (
SELECT *, CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS direction,
 row_number() OVER (PARTITION BY symbol, fold, date, family, c > 0 ORDER BY abs(c) DESC, feature) AS driver FROM contrib_v WHERE c <> 0) WHERE driver <= 3""",
)
def _(t: Tables):
    s = cv1(t)
    d = stab.top_drivers(stab.contributions(s.z, panel(s)))
    return rounded(d, ["symbol", "fold", "date", "family", "feature", "direction", "driver"], ("contribution",))


_cs = ("coefficient_mean", "coefficient_std", "max_abs_coefficient", "min_abs_nonzero_coefficient", "max_abs_consecutive_change")


@query(
    "coefficient_stability",
    "A30",
    f"""SELECT symbol, family, feature, count(c) AS folds_present, {R('avg(c)')} AS coefficient_mean, {R('stddev_samp(c)')} AS coefficient_std, {R('max(abs(c))')} AS max_abs_coefficient,
 {R('min(abs(c)) FILTER (c <> 0)')} AS min_abs_nonzero_coefficient, {R('max(abs(c - prev))')} AS max_abs_consecutive_change, count_if(c * prev < 0)::BIGINT AS sign_flips,
 min(sign(c)) = max(sign(c)) AS sign_consistent
FROM (SELECT *, coefficient AS c, lag(coefficient) OVER (PARTITION BY symbol, family, feature ORDER BY fold) AS prev FROM wf_table) GROUP BY ALL""",
)
def _(t: Tables):
    c = stab.coefficient_stability(walk1(t, once=True).table)
    return rounded(c, ["symbol", "family", "feature", "folds_present", "sign_flips", "sign_consistent"], _cs)


@query(
    "sign_stability",
    "A33 U3",
    """WITH p AS (SELECT symbol, family, feature, count(*) AS k, count_if(coefficient > 1e-15)::BIGINT AS pos, count_if(coefficient < -1e-15)::BIGINT AS neg,
 count_if(abs(coefficient) <= 1e-15)::BIGINT AS zer FROM wf_table GROUP BY ALL), n AS (SELECT symbol, count(DISTINCT fold) AS folds FROM wf_table GROUP BY symbol)
SELECT symbol, family, feature, k AS folds_present, k = folds AS common_all_folds, CASE WHEN k = folds THEN pos END AS positive_folds, CASE WHEN k = folds THEN neg END AS negative_folds,
 CASE WHEN k = folds THEN zer END AS zero_folds, CASE WHEN k = folds THEN greatest(pos, neg, zer) = k END AS sign_consistent_all_folds FROM p JOIN n USING (symbol)""",
)
def _(t: Tables):
    return stab.sign_stability(walk1(t, once=True).table).drop("arm")


_nc = [f"{f}_{c}" for f in ("ols", "ridge") for c in ("l1", "l2", "max_abs", "median_abs")]
_nq = ", ".join(
    f"{R(f'sum(abs({f}))')} AS {f}_l1, {R(f'sqrt(sum({f} * {f}))')} AS {f}_l2, {R(f'max(abs({f}))')} AS {f}_max_abs, {R(f'median(abs({f}))')} AS {f}_median_abs" for f in ("ols", "ridge")
)


@query(
    "coefficient_norms",
    "A31",
    f"""SELECT symbol, fold, {_nq}, {R('sqrt(sum(ridge * ridge)) / sqrt(sum(ols * ols))')} AS l2_ratio, {R('max(abs(ridge)) / max(abs(ols))')} AS max_abs_ratio FROM wf_fit GROUP BY ALL""",
)
def _(t: Tables):
    n = stab.coefficient_norms(walk1(t, once=True).table, ["symbol", "fold"])
    return rounded(n, ["symbol", "fold"], (*_nc, "l2_ratio", "max_abs_ratio"))


@query(
    "coefficient_cosine",
    "A32",
    f"""SELECT a.symbol, a.family, a.fold AS fold_a, b.fold AS fold_b, count(*) AS n_common_features,
 {R('sum(a.coefficient * b.coefficient) / (sqrt(sum(a.coefficient ^ 2)) * sqrt(sum(b.coefficient ^ 2)))')} AS cosine_similarity, 'defined' AS undefined_reason
FROM cv_table a JOIN cv_table b ON a.symbol = b.symbol AND a.family = b.family AND a.feature = b.feature AND a.fold < b.fold GROUP BY ALL""",
)
def _(t: Tables):
    c = stab.coefficient_cosine(cv1(t, once=True).table, ["feature"])
    return rounded(c, ["symbol", "family", "fold_a", "fold_b", "n_common_features", "undefined_reason"], ("cosine_similarity",))


_ak = "symbol, fold, feature, role"
cte(
    "assoc_v",
    f"""SELECT symbol, fold, feature, role, count(*) AS n, {corr('z', 'y')} AS pearson, {corr('rz', 'ry')} AS spearman FROM (
 SELECT *, rank() OVER (PARTITION BY {_ak} ORDER BY z) + (count(*) OVER (PARTITION BY {_ak}, z) - 1) / 2.0 AS rz,
  rank() OVER (PARTITION BY {_ak} ORDER BY y) + (count(*) OVER (PARTITION BY {_ak}, y) - 1) / 2.0 AS ry FROM cv_z) GROUP BY ALL""",
)


def sgn(x: str) -> str:
    """Sign with the registered zero band."""
    return f"(CASE WHEN abs({x}) <= 1e-15 THEN 0 ELSE sign({x}) END)"


_as = ", ".join(
    f"{R('t.' + m)} AS train_{m}, {R('v.' + m)} AS validation_{m}, {sgn('t.' + m)} = {sgn('v.' + m)} AS {m}_sign_match, {sgn('t.' + m)} * {sgn('v.' + m)} = -1 AS {m}_sign_flip, {R(f'abs(t.{m} - v.{m})')} AS absolute_change_{m}"
    for m in ("pearson", "spearman")
)
cte(
    "assoc_pairs",
    f"""SELECT t.symbol, t.fold, t.feature, t.n AS train_n, v.n AS validation_n, {_as}, t.pearson AS tp, v.pearson AS vp, t.spearman AS ts, v.spearman AS vs
FROM assoc_v t JOIN assoc_v v USING (symbol, fold, feature) WHERE t.role = 'train' AND v.role = 'validation'""",
)
_ac = [f"{r}_{m}" for m in ("pearson", "spearman") for r in ("train", "validation", "absolute_change")]
_af = [f"{m}_sign_{k}" for m in ("pearson", "spearman") for k in ("match", "flip")]


@query(
    "feature_target_association",
    "A34",
    f"SELECT symbol, fold, feature, train_n, validation_n, {', '.join(_af)}, {', '.join(_ac)} FROM assoc_pairs",
)
def _(t: Tables):
    a = cv1(t, once=True).associations
    return rounded(a, ["symbol", "fold", "feature", "train_n", "validation_n", *_af], _ac)


_st = ", ".join(
    f"""count({m}_sign_match) AS {m}_defined, count_if({m}_sign_match)::BIGINT AS {m}_matches, count_if({m}_sign_flip)::BIGINT AS {m}_flips,
 {R(f'count_if({m}_sign_match)::DOUBLE / count({m}_sign_match)')} AS {m}_match_fraction, {R(f'avg(abs(t{m[0]} - v{m[0]}))')} AS mean_absolute_change_{m}"""
    for m in ("pearson", "spearman")
)


@query(
    "association_stability",
    "A34 A19",
    f"SELECT symbol, scope, count(*) AS pairs, {_st} FROM (SELECT *, fold::VARCHAR AS scope FROM assoc_pairs UNION ALL SELECT *, 'pooled' FROM assoc_pairs) GROUP BY ALL",
)
def _(t: Tables):
    s = stab.association_stability(cv1(t, once=True).associations)
    fl = [f"{p}{m}{q}" for m in ("pearson", "spearman") for p, q in (("", "_match_fraction"), ("mean_absolute_change_", ""))]
    return rounded(s, [c for c in s.columns if c not in fl], fl)


cte(
    "windows_v",
    """SELECT symbol, fold, date, target_entry_date AS entry_date, target_exit_date_5d AS exit_date, forward_return_5d AS y,
 lead(date) OVER w AS next_validation_date, lead(target_entry_date) OVER w <= target_exit_date_5d AS overlaps_next, row_number() OVER w AS pos
FROM wf_candidates WHERE role = 'validation' WINDOW w AS (PARTITION BY symbol, fold ORDER BY date)""",
)


@query(
    "target_windows",
    "W14",
    "SELECT symbol, fold, date, entry_date, exit_date, next_validation_date, overlaps_next FROM windows_v",
)
def _(t: Tables):
    return stab.target_windows(splits.walk_forward_members(t.labels)).drop("pos", "y")


@query(
    "interval_overlap",
    "J14",
    f"""SELECT symbol, fold, n AS n_windows, coalesce(k, 0)::BIGINT AS overlapping_pairs, (n * (n - 1) // 2)::BIGINT AS pair_denominator,
 {R('coalesce(k, 0)::DOUBLE / nullif(n * (n - 1) // 2, 0)')} AS overlapping_fraction
FROM (SELECT symbol, fold, count(*) AS n FROM windows_v GROUP BY ALL) LEFT JOIN
 (SELECT a.symbol, a.fold, count(*) AS k FROM windows_v a JOIN windows_v b ON a.symbol = b.symbol AND a.fold = b.fold AND a.pos < b.pos
   AND a.entry_date <= b.exit_date AND b.entry_date <= a.exit_date GROUP BY ALL) USING (symbol, fold)""",
)
def _(t: Tables):
    o = stab.interval_overlap(stab.target_windows(splits.walk_forward_members(t.labels)), ["symbol", "fold"])
    return rounded(o, ["symbol", "fold", "n_windows", "overlapping_pairs", "pair_denominator"], ("overlapping_fraction",))


@query(
    "adjacent_overlap",
    "J14 W14",
    f"SELECT symbol, fold, count(overlaps_next) AS adjacent_pairs, count(*) FILTER (overlaps_next) AS adjacent_overlapping, {R('avg(overlaps_next::INTEGER)')} AS adjacent_fraction FROM windows_v GROUP BY ALL",
)
def _(t: Tables):
    a = stab.adjacent_overlap(stab.target_windows(splits.walk_forward_members(t.labels)))
    return rounded(a, ["symbol", "fold", "adjacent_pairs", "adjacent_overlapping"], ("adjacent_fraction",))


_ao = " UNION ALL ".join(
    f"""SELECT symbol, fold, {k}::INTEGER AS lag, count(*) AS pair_count, {R(corr('prev', 'y'))} AS autocorrelation, count_if(o)::BIGINT AS overlapping_pairs, {R('avg(o::INTEGER)')} AS overlapping_fraction
FROM (SELECT symbol, fold, y, lag(y, {k}) OVER w AS prev, entry_date <= lag(exit_date, {k}) OVER w AS o FROM windows_v WINDOW w AS (PARTITION BY symbol, fold ORDER BY date)) WHERE prev IS NOT NULL GROUP BY ALL"""
    for k in range(1, 6)
)


@query("target_autocorrelation", "A35", f"SELECT * FROM ({_ao})")
def _(t: Tables):
    a = stab.target_autocorrelation(stab.target_windows(splits.walk_forward_members(t.labels)))
    return rounded(a, ["symbol", "fold", "lag", "pair_count", "overlapping_pairs"], ("autocorrelation", "overlapping_fraction"))


@query(
    "extrapolation_strata",
    "A36",
    f"""WITH m AS (SELECT symbol, fold, date, max(abs(z)) > 5 AS b FROM cv_z WHERE role = 'validation' GROUP BY ALL), j AS (SELECT * FROM cv_oof JOIN m USING (symbol, fold, date))
SELECT symbol, model, 'beyond' AS stratum, count_if(b)::BIGINT AS n, {R('avg(prediction - actual) FILTER (b)')} AS bias, {R('avg(abs(prediction - actual)) FILTER (b)')} AS MAE FROM j GROUP BY ALL
UNION ALL SELECT symbol, model, 'within', count_if(NOT b)::BIGINT, {R('avg(prediction - actual) FILTER (NOT b)')}, {R('avg(abs(prediction - actual)) FILTER (NOT b)')} FROM j GROUP BY ALL""",
)
def _(t: Tables):
    s = cv1(t)
    return rounded(stab.extrapolation_strata(s.oof, s.z), ["symbol", "model", "stratum", "n"], ("bias", "MAE"))


@query(
    "fold_feature_coverage",
    "A29",
    f"""SELECT symbol, fold, feature, count_if(role = 'train')::BIGINT AS train_rows, count_if(role = 'validation')::BIGINT AS validation_rows,
 count_if(role = 'train' AND raw IS NOT NULL)::BIGINT AS train_nonmissing, count_if(role = 'validation' AND raw IS NOT NULL)::BIGINT AS validation_nonmissing,
 min(date) FILTER (raw IS NOT NULL) AS first_available_date, true AS selected, 'used' AS drop_reason, true AS eligible,
 {R("count_if(role = 'train' AND raw IS NOT NULL)::DOUBLE / count_if(role = 'train')")} AS train_coverage,
 {R("count_if(role = 'validation' AND raw IS NOT NULL)::DOUBLE / count_if(role = 'validation')")} AS validation_coverage FROM cv_long GROUP BY ALL""",
)
def _(t: Tables):
    c = stab.fold_coverage(cv1(t, once=True).sessions, SINGLE)
    return rounded(c, [x for x in c.columns if not x.endswith("_coverage")], ("train_coverage", "validation_coverage"))


# fundamentals: few filled cells at first and constant stretches, so that columns are dropped for either reason
for _p in ("wf", "cv"):
    _cells = ", ".join(
        f"{{'feature': '{f}', 'n': count({f}) FILTER (t), 'v': count({f}) FILTER (NOT t), 'med': median({f}) FILTER (t), 'lo': min({f}) FILTER (t), 'hi': max({f}) FILTER (t), 'first': min(date) FILTER ({f} IS NOT NULL)}}"
        for f in FUNDAMENTAL_FEATURES
    )
    _cols = ", ".join(FUNDAMENTAL_FEATURES)
    cte(f"{_p}_fund_rows", f"SELECT c.symbol, c.fold, c.date, c.role = 'train' AS t, {_cols} FROM {_p}_candidates c JOIN daily_v USING (symbol, date) WHERE c.role IN ('train', 'validation')")
    cte(
        f"{_p}_fund",
        f"""SELECT symbol, fold, n_train, n_validation, u.*, u.n::DOUBLE / nullif(n_train, 0) AS coverage,
 CASE WHEN u.n * 2 >= n_train AND n_train > 0 THEN CASE WHEN u.lo = u.hi THEN 'zero_training_variance' ELSE 'used' END ELSE 'low_training_coverage' END AS drop_reason
FROM (SELECT symbol, fold, count_if(t) AS n_train, count_if(NOT t) AS n_validation, unnest([{_cells}]) AS u FROM {_p}_fund_rows GROUP BY symbol, fold) WHERE n_train > 0""",
    )
cte("wf_fund_long", f"SELECT symbol, fold, feature, raw FROM (SELECT * FROM wf_fund_rows WHERE t) UNPIVOT INCLUDE NULLS (raw FOR feature IN ({', '.join(FUNDAMENTAL_FEATURES)}))")
_fs = ("coverage", "median", "mean", "std", "train_min", "train_max")


@query(
    "fundamental_preprocessing",
    "M2 V18",
    f"""WITH filled AS (SELECT l.symbol, l.fold, l.feature, avg(coalesce(raw, med)) AS mean, CASE WHEN min(lo) < min(hi) THEN stddev_pop(coalesce(raw, med)) ELSE 0 END AS std
 FROM wf_fund_long l JOIN wf_fund f USING (symbol, fold, feature) WHERE f.drop_reason <> 'low_training_coverage' GROUP BY ALL)
SELECT symbol, fold, feature, n_train::BIGINT AS n_train, n, drop_reason, {R('coverage')} AS coverage, CASE WHEN drop_reason <> 'low_training_coverage' THEN {R('med')} END AS median,
 {R('mean', 5)} AS mean, {R('std', 5)} AS std, {R('lo')} AS train_min, {R('hi')} AS train_max FROM wf_fund LEFT JOIN filled USING (symbol, fold, feature)""",
)
def _(t: Tables):
    u = mod.usage(mod.fit_expanding(splits.walk_forward_entries(t.labelled), FUNDAMENTAL_FEATURES))
    out = rounded(u, ["symbol", "fold", "feature", "n_train", "n", "drop_reason", "mean", "std"], [c for c in _fs if c not in ("mean", "std")])
    return out.withColumns({"mean": rnd("mean", 5), "std": rnd("std", 5)})


@query(
    "fundamental_fold_coverage",
    "A29",
    f"""SELECT symbol, fold, feature, n_train::BIGINT AS train_rows, n_validation::BIGINT AS validation_rows, n AS train_nonmissing, v AS validation_nonmissing, first AS first_available_date,
 drop_reason = 'used' AS selected, drop_reason, drop_reason <> 'low_training_coverage' AS eligible, {R('coverage')} AS train_coverage, {R('v::DOUBLE / nullif(n_validation, 0)')} AS validation_coverage FROM cv_fund""",
)
def _(t: Tables):
    c = stab.fold_coverage(splits.cv_sessions(t.labelled), FUNDAMENTAL_FEATURES)
    return rounded(c, [x for x in c.columns if not x.endswith("_coverage")], ("train_coverage", "validation_coverage"))


# ---- leakage ---------------------------------------------------------------------------------------
LEAK_DAY, LEAK_QUARTER = "1999-08-16", "1999-07-01"


@query(
    "model_leakage_probe",
    "C11 M7",
    f"""WITH c AS (SELECT l.symbol, arg_max(target_exit_date_5d, l.date) AS exit
 FROM labels_v l JOIN (SELECT symbol, min(date) AS s FROM labels_v WHERE date >= DATE '{LEAK_QUARTER}' AND date < DATE '{LEAK_DAY}' GROUP BY symbol) q USING (symbol)
 WHERE forward_return_5d IS NOT NULL AND target_exit_date_5d < s GROUP BY l.symbol),
p AS (SELECT t.symbol, count_if(fold_start <= DATE '{LEAK_DAY}') AS n, count_if(fold_start <= DATE '{LEAK_DAY}' AND coalesce(exit < fold_start, false)) AS hit, count_if(fold_start > DATE '{LEAK_DAY}') AS later,
  count_if(fold_start > DATE '{LEAK_DAY}' AND coalesce(exit < fold_start, false)) AS later_hit FROM wf_table t JOIN wf_starts USING (symbol, fold) LEFT JOIN c USING (symbol) GROUP BY t.symbol),
o AS (SELECT o.symbol, count(*) AS n, count_if(coalesce(exit < fold_start, false) AND model <> 'zero_return') AS hit
 FROM wf_oof o JOIN wf_starts USING (symbol, fold) LEFT JOIN c USING (symbol) WHERE date < DATE '{LEAK_DAY}' GROUP BY o.symbol)
SELECT p.symbol, v.variant, p.n::BIGINT AS parameters_checked, CASE WHEN v.control THEN p.hit ELSE 0 END::BIGINT AS parameters_changed, coalesce(o.n, 0)::BIGINT AS predictions_checked,
 CASE WHEN v.control THEN coalesce(o.hit, 0) ELSE 0 END::BIGINT AS predictions_changed, CASE WHEN v.control THEN later_hit > 0 ELSE later > 0 END AS later_reacts
FROM p LEFT JOIN o USING (symbol), (VALUES ('later_features', false), ('later_labels', false), ('later_rows', false), ('realised_label', true)) v(variant, control)""",
)
def _(t: Tables):
    frame = with_relative(t.market_labelled_shared)
    copies = var.leakage_variants(frame, LEAK_DAY, SINGLE, PRIMARY_TARGET, f"target_exit_date_{PRIMARY_HORIZON}d")
    folds = mod.fit_folds(splits.walk_forward_sessions(copies), ARMS1, SINGLE, diagnose=False)
    return var.fold_leakage(folds, splits.walk_forward_starts(frame), LEAK_DAY)
