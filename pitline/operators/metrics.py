"""Out-of-fold metrics, comparisons and calibration over long prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import SIGN_TOL, TIE_TOL
from pitline.functions.numeric import calibration_slope, pearson, sample_std
from pitline.functions.windows import average_rank

METRICS = ("MAE", "RMSE", "R2", "Pearson", "Spearman", "directional_accuracy")


def with_scopes(oof: DataFrame) -> DataFrame:
    """Each prediction once for its fold and once for the pool (a grouping set spelled as two rows, since ranks differ)."""
    return oof.withColumn("scope", F.explode(F.array(F.col("fold").cast("string"), F.lit("pooled"))))


def regression_metrics(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Six metrics per group. Groups are one symbol's validation rows, so the rank windows are bounded."""
    r = oof.withColumns({"_ra": average_rank("actual", keys), "_rp": average_rank("prediction", keys)})
    err = F.col("actual") - F.col("prediction")
    sq = err * err
    n = F.count(F.lit(1)).cast("double")
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("MAE"),
        F.sqrt(F.avg(sq)).alias("RMSE"),
        F.when((F.count(F.lit(1)) >= 2) & (F.min("actual") < F.max("actual")), 1 - F.try_divide(F.sum(sq), F.var_pop("actual") * n)).alias("R2"),
        pearson("actual", "prediction").alias("Pearson"),
        pearson("_ra", "_rp").alias("Spearman"),
        F.avg((F.signum("actual") == F.signum("prediction")).cast("double")).alias("directional_accuracy"),
    )


def cv_summary(oof: DataFrame) -> DataFrame:
    """Equal-weight fold means, fold deviation of MAE, pooled metrics and rank by mean fold MAE, per symbol and model."""
    fold = regression_metrics(oof, ["symbol", "model", "fold"])
    means = fold.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(f"mean_fold_{m}") for m in METRICS], F.stddev_samp("MAE").alias("std_fold_MAE")
    )
    pooled = regression_metrics(oof, ["symbol", "model"]).select("symbol", "model", *[F.col(m).alias(f"pooled_oof_{m}") for m in METRICS])
    j = means.join(pooled, ["symbol", "model"])
    return j.withColumn("rank_by_mean_fold_MAE", F.rank().over(W.partitionBy("symbol").orderBy("mean_fold_MAE")))


def fold_mae(oof: DataFrame) -> DataFrame:
    return oof.groupBy("symbol", "fold", "model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("MAE"),
        F.avg(F.col("prediction") - F.col("actual")).alias("bias"),
    )


def paired_comparison(mae: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Fold-wise MAE differences (model minus reference) summarised per pair: mean, median, wins, losses, ties.

    The two sides are columns of one fold row, so no self-join is needed. Differences of at most TIE_TOL are zero.
    """

    def difference(a: str, b: str) -> Column:
        d = F.col(a) - F.col(b)
        return F.when(F.abs(d) <= TIE_TOL, 0.0).otherwise(d)

    names = sorted({m for p in pairs for m in p})
    wide = mae.groupBy("symbol", "fold").agg(*[F.max(F.when(F.col("model") == m, F.col("MAE"))).alias(m) for m in names])
    items = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("reference"), difference(a, b).alias("delta")) for a, b in pairs])
    long = wide.select("symbol", "fold", F.inline(items)).filter(F.col("delta").isNotNull())
    d = F.col("delta")
    return long.groupBy("symbol", "model", "reference").agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg(d).alias("mean_delta_MAE"),
        F.median(d).alias("median_delta_MAE"),
        F.count_if(d < 0).alias("wins"),
        F.count_if(d > 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
        F.avg((d < 0).cast("double")).alias("win_rate"),
    )


def yearly(oof: DataFrame, references: tuple[str, ...] = ("zero_return", "historical_mean")) -> DataFrame:
    """MAE per calendar year and model, with differences to the reference models of that year."""
    y = oof.groupBy("symbol", F.year("date").alias("year"), "model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("MAE")
    )
    w = W.partitionBy("symbol", "year")
    return y.withColumns({f"delta_vs_{r}": F.col("MAE") - F.max(F.when(F.col("model") == r, F.col("MAE"))).over(w) for r in references})


def model_summary(oof: DataFrame) -> DataFrame:
    """Mean, median and pooled MAE of each model over its folds."""
    per = fold_mae(oof).groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("fold_count"), F.sum("rows").alias("oof_rows"), F.avg("MAE").alias("mean_fold_MAE"),
        F.median("MAE").alias("median_fold_MAE"), F.try_divide(F.sum(F.col("MAE") * F.col("rows")), F.sum("rows")).alias("pooled_MAE"),
    )
    return per


def calibration(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Bias, median errors, calibration line and its undefined reason, per group."""
    e = F.col("prediction") - F.col("actual")
    slope = calibration_slope("actual", "prediction")
    reason = (
        F.when(F.count(F.lit(1)) < 2, "too_few_rows").when(F.min("prediction") == F.max("prediction"), "constant_prediction").otherwise("defined")
    )
    return oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("actual").alias("mean_actual"),
        F.avg("prediction").alias("mean_prediction"),
        F.avg(e).alias("mean_bias"),
        F.median(e).alias("median_error"),
        F.median(F.abs(e)).alias("median_absolute_error"),
        slope.alias("calibration_slope"),
        (F.avg("actual") - slope * F.avg("prediction")).alias("calibration_intercept"),
        reason.alias("calibration_undefined_reason"),
    )


def dispersion(oof: DataFrame, keys: list[str]) -> DataFrame:
    sa, sp = sample_std("actual"), sample_std("prediction")
    d = oof.groupBy(*keys).agg(sa.alias("std_actual"), sp.alias("std_prediction"), F.min("actual").alias("actual_min"), F.max("actual").alias("actual_max"))
    return d.withColumns(
        {
            "dispersion_ratio": F.when(F.col("std_actual") > 0, F.try_divide("std_prediction", "std_actual")),
            "dispersion_undefined_reason": F.when(F.col("std_actual") > 0, "defined").when(F.col("std_actual") == 0, "constant_actual").otherwise("too_few_rows"),
        }
    )


def baseline_advantage(oof: DataFrame, anchors: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Absolute-error differences of each model to an anchor on the same rows: mean, median, wins, losses, ties."""
    w = W.partitionBy("symbol", "fold", "date")
    ae = F.abs(F.col("actual") - F.col("prediction"))
    df = oof.withColumn("ae", ae)
    df = df.withColumns({f"_{a}": F.max(F.when(F.col("model") == a, F.col("ae"))).over(w) for a in anchors}).filter(~F.col("model").isin(*anchors))
    long = df.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("anchor"), (F.col("ae") - F.col(f"_{a}")).alias("delta")) for a in anchors])))
    d = F.col("delta")
    return long.groupBy(*keys, "model", "anchor").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta_AE"), F.median(d).alias("median_delta_AE"),
        F.count_if(d < -SIGN_TOL).alias("model_beats"), F.count_if(d > SIGN_TOL).alias("anchor_beats"), F.count_if(F.abs(d) <= SIGN_TOL).alias("ties"),
    )


def prediction_summary(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Moments and magnitude counts of the predictions."""
    p = F.col("prediction")
    a = F.abs(p)
    aggs: list[Column] = [
        F.avg(p).alias("prediction_mean"), sample_std(p).alias("prediction_std"), F.median(p).alias("prediction_median"),
        F.min(p).alias("prediction_min"), F.max(p).alias("prediction_max"), F.avg(a).alias("mean_abs_prediction"),
        F.median(a).alias("median_abs_prediction"), F.max(a).alias("max_abs_prediction"),
    ]
    for t, tag in ((0.10, "0_10"), (0.20, "0_20"), (0.30, "0_30")):
        aggs += [F.count_if(a > t).alias(f"count_abs_gt_{tag}"), F.avg((a > t).cast("double")).alias(f"fraction_abs_gt_{tag}")]
    return oof.groupBy(*keys).agg(*aggs)


def error_table(oof: DataFrame) -> DataFrame:
    """Residual (actual minus prediction), absolute and squared error, and descending error rank within fold and model."""
    r = F.col("actual") - F.col("prediction")
    w = W.partitionBy("symbol", "fold", "model").orderBy(F.col("absolute_error").desc())
    df = oof.withColumns({"residual": r, "absolute_error": F.abs(r), "squared_error": r * r})
    return df.withColumn("error_rank", F.rank().over(w))


def top_errors(oof: DataFrame, n: int = 5) -> DataFrame:
    """The n largest errors per fold and model, ties by date."""
    w = W.partitionBy("symbol", "fold", "model").orderBy(F.col("absolute_error").desc(), "date")
    return error_table(oof).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def error_concentration(oof: DataFrame) -> DataFrame:
    """Share of total absolute error held by the three and five largest, and counts of large errors."""
    w = W.partitionBy("symbol", "fold", "model").orderBy(F.col("absolute_error").desc(), "date")
    e = error_table(oof).withColumn("position", F.row_number().over(w))
    ae = F.col("absolute_error")
    total = F.sum(ae)
    return e.groupBy("symbol", "fold", "model").agg(
        F.max(ae).alias("largest_absolute_error"),
        F.min_by("date", "position").alias("largest_error_date"),
        F.avg(ae).alias("absolute_error_mean"),
        F.median(ae).alias("absolute_error_median"),
        F.when(total > 0, F.try_divide(F.sum(F.when(F.col("position") <= 3, ae)), total)).alias("top_3_share"),
        F.when(total > 0, F.try_divide(F.sum(F.when(F.col("position") <= 5, ae)), total)).alias("top_5_share"),
        F.count_if(ae > 0.10).alias("count_gt_0_10"),
        F.count_if(ae > 0.20).alias("count_gt_0_20"),
    )


def control_reproduction(replay: DataFrame, stored: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Replayed against stored predictions: identity, largest difference and tolerance violations per model."""
    from pitline.functions.numeric import is_close

    key = ["symbol", "fold", "date", "model"]
    old = stored.select(*key, F.col("actual").alias("_a"), F.col("prediction").alias("_p"), F.lit(True).alias("_in"))
    j = replay.withColumn("_out", F.lit(True)).join(old, key, "full_outer")
    both = F.col("_in") & F.col("_out")
    return j.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col("_in").isNull() | F.col("_out").isNull()).alias("identity_violations"),
        F.count_if(both & ~F.col("actual").eqNullSafe(F.col("_a"))).alias("actual_violations"),
        F.max(F.abs(F.col("prediction") - F.col("_p"))).alias("max_absolute_difference"),
        F.count_if(both & ~is_close("prediction", "_p", rtol, atol)).alias("tolerance_violations"),
    )
