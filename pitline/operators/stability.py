"""Drift, contributions, coefficient stability, association and label-overlap diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import COVERAGE_MIN
from pitline.functions.numeric import finite, pearson, sdiv, signed
from pitline.functions.windows import average_rank
from pitline.operators.models import selection
from pitline.operators.moments import pair_moments

KEY = ["symbol", "fold"]


def range_drift(z: DataFrame) -> DataFrame:
    """Observed validation values strictly outside the training range, per fold and feature."""
    raw = F.col("raw")
    below, above = raw < F.col("train_min"), raw > F.col("train_max")
    return z.groupBy(*KEY, "feature").agg(
        F.count(raw).alias("validation_non_null_count"),
        F.count_if(below).alias("below_training_min"),
        F.count_if(above).alias("above_training_max"),
        F.count_if(below | above).alias("outside_training_range"),
        F.try_divide(F.count_if(below | above), F.count(raw)).alias("outside_fraction"),
    )


def z_summary(z: DataFrame, keys: list[str]) -> DataFrame:
    a = F.col("abs_z")
    return z.groupBy(*keys).agg(
        F.count(a).alias("value_count"),
        F.max(a).alias("max_abs_z"),
        F.median(a).alias("median_abs_z"),
        F.percentile(a, F.lit(0.95)).alias("p95_abs_z"),
        F.count_if(a > 3).alias("count_gt_3"),
        F.count_if(a > 5).alias("count_gt_5"),
        F.avg((a > 3).cast("double")).alias("fraction_gt_3"),
        F.avg((a > 5).cast("double")).alias("fraction_gt_5"),
    )


def contributions(z: DataFrame, parameters: DataFrame) -> DataFrame:
    """coefficient * z of every validation cell with its rank by size and by sign within the prediction."""
    df = z.select(*KEY, "date", "feature", "z").join(parameters, [*KEY, "feature"])
    df = df.withColumn("contribution", F.col("coefficient") * F.col("z"))
    cell = [*KEY, "date", "arm", "family"]
    c = F.col("contribution")

    def rank(value: Column, when: Column) -> Column:
        w = W.partitionBy(*cell, when).orderBy(value)
        return F.when(when, F.rank().over(w))

    return df.withColumns(
        {
            "abs_rank": F.rank().over(W.partitionBy(*cell).orderBy(F.abs(c).desc())),
            "positive_rank": rank(c.desc(), c > 0),
            "negative_rank": rank(c.asc(), c < 0),
        }
    )


def top_drivers(contrib: DataFrame, n: int = 3) -> DataFrame:
    """The n leading positive and negative drivers of each prediction, ties by feature name."""
    cell = [*KEY, "date", "arm", "family"]
    c = F.col("contribution")
    signed_rows = contrib.filter(c != 0).withColumn("direction", F.when(c > 0, "positive").otherwise("negative"))
    w = W.partitionBy(*cell, "direction").orderBy(F.abs(c).desc(), "feature")
    return signed_rows.withColumn("driver", F.row_number().over(w)).filter(F.col("driver") <= n)


def coefficient_stability(parameters: DataFrame) -> DataFrame:
    """Coefficient path over the available folds: moments, extremes, largest step, sign flips and consistency."""
    ident = ["symbol", "arm", "family", "feature"]
    c = F.col("coefficient")
    w = W.partitionBy(*ident).orderBy("fold")
    df = parameters.withColumns({"_prev": F.lag("coefficient").over(w), "_s": F.signum(c)})
    return df.groupBy(*ident).agg(
        F.count(c).alias("folds_present"),
        F.avg(c).alias("coefficient_mean"),
        F.stddev_samp(c).alias("coefficient_std"),
        F.max(F.abs(c)).alias("max_abs_coefficient"),
        F.min(F.when(c != 0, F.abs(c))).alias("min_abs_nonzero_coefficient"),
        F.max(F.abs(c - F.col("_prev"))).alias("max_abs_consecutive_change"),
        F.count_if(c * F.col("_prev") < 0).alias("sign_flips"),
        (F.min("_s") == F.max("_s")).alias("sign_consistent"),
    )


def sign_stability(parameters: DataFrame, n_folds: Column | None = None) -> DataFrame:
    """Folds with a positive, negative and zero coefficient for features present in every fold of the symbol."""
    ident = ["symbol", "arm", "family", "feature"]
    s = signed("coefficient")
    total = parameters.groupBy("symbol").agg(F.count_distinct("fold").alias("_folds"))
    per = parameters.groupBy(*ident).agg(
        F.count_distinct("fold").alias("folds_present"),
        F.count_if(s == 1).alias("positive_folds"),
        F.count_if(s == -1).alias("negative_folds"),
        F.count_if(s == 0).alias("zero_folds"),
    )
    j = per.join(total, "symbol")
    common = F.col("folds_present") == F.col("_folds")
    same = F.greatest("positive_folds", "negative_folds", "zero_folds") == F.col("folds_present")
    return j.select(
        *ident, "folds_present", common.alias("common_all_folds"),
        *[F.when(common, F.col(f"{k}_folds")).alias(f"{k}_folds") for k in ("positive", "negative", "zero")],
        F.when(common, same).alias("sign_consistent_all_folds"),
    )


def coefficient_norms(parameters: DataFrame, group: list[str]) -> DataFrame:
    """Norms of a coefficient vector, ridge beside OLS, with their shrinkage ratios."""
    a = F.abs("coefficient")
    n = parameters.groupBy(*group, "family").agg(
        F.sum(a).alias("l1"), F.sqrt(F.sum(a * a)).alias("l2"), F.max(a).alias("max_abs"), F.median(a).alias("median_abs")
    )
    wide = n.groupBy(*group).agg(
        *[F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}_{c}") for f in ("ols", "ridge") for c in ("l1", "l2", "max_abs", "median_abs")]
    )
    return wide.withColumns({"l2_ratio": sdiv("ridge_l2", "ols_l2"), "max_abs_ratio": sdiv("ridge_max_abs", "ols_max_abs")})


def coefficient_cosine(parameters: DataFrame, vector: list[str]) -> DataFrame:
    """Cosine of the coefficient vectors of consecutive and all other fold pairs, on common features.

    ``vector`` names the columns that identify one coordinate. Fold pairs come from each coordinate's own
    short fold list, sorted, so the fan-out is the number of folds of one model.
    """
    ident = ["symbol", "family"]
    per = parameters.groupBy(*ident, *vector).agg(F.array_sort(F.collect_list(F.struct("fold", "coefficient"))).alias("path"))
    left = per.select(*ident, *vector, "path", F.posexplode("path").alias("i", "a"))
    pairs = left.select(*ident, *vector, "a", F.explode(F.slice("path", F.col("i") + 2, F.size("path"))).alias("b"))
    x, y = F.col("a.coefficient"), F.col("b.coefficient")
    g = pairs.groupBy(*ident, F.col("a.fold").alias("fold_a"), F.col("b.fold").alias("fold_b")).agg(
        F.count(F.lit(1)).alias("n_common_features"), F.sum(x * y).alias("xy"), F.sqrt(F.sum(x * x)).alias("nx"), F.sqrt(F.sum(y * y)).alias("ny")
    )
    ok = (F.col("nx") > 0) & (F.col("ny") > 0)
    return g.select(
        *ident, "fold_a", "fold_b", "n_common_features",
        F.when(ok, F.try_divide(F.col("xy"), F.col("nx") * F.col("ny"))).alias("cosine_similarity"),
        F.when(ok, "defined").otherwise("zero_norm_or_no_common_features").alias("undefined_reason"),
    )


def associations(z: DataFrame) -> DataFrame:
    """Pearson and Spearman of frozen features with the label, training against validation."""
    keys = [*KEY, "feature", "role"]
    r = z.withColumns({"_rz": average_rank("z", keys), "_ry": average_rank("y", keys)})
    reason = (
        F.when(F.count(F.lit(1)) < 2, "too_few_pairs").when(F.min("z") == F.max("z"), "constant_feature")
        .when(F.min("y") == F.max("y"), "constant_target").otherwise("defined")
    )
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson("z", "y").alias("pearson"), pearson("_rz", "_ry").alias("spearman"), reason.alias("reason")
    )
    cols = ("n", "pearson", "spearman", "reason")
    wide = s.groupBy(*KEY, "feature").agg(
        *[F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}") for role in ("train", "validation") for c in cols]
    )
    return sign_changes(wide)


def sign_changes(wide: DataFrame) -> DataFrame:
    """Whether the signs of training and validation association agree or flip, and how far the association moved."""
    out = {}
    for m in ("pearson", "spearman"):
        a, b = signed(F.col(f"train_{m}")), signed(F.col(f"validation_{m}"))
        out[f"{m}_sign_match"] = a == b
        out[f"{m}_sign_flip"] = a * b == -1
        out[f"absolute_change_{m}"] = F.abs(F.col(f"train_{m}") - F.col(f"validation_{m}"))
    return wide.withColumns(out)


def association_stability(assoc: DataFrame) -> DataFrame:
    """Sign agreement per fold and pooled, from one grouping-set style scan of the association table."""
    scoped = assoc.withColumn("scope", F.explode(F.array(F.col("fold").cast("string"), F.lit("pooled"))))
    aggs = [F.count(F.lit(1)).alias("pairs")]
    for m in ("pearson", "spearman"):
        match = F.col(f"{m}_sign_match")
        aggs += [
            F.count(match).alias(f"{m}_defined"),
            F.count_if(match).alias(f"{m}_matches"),
            F.count_if(F.col(f"{m}_sign_flip")).alias(f"{m}_flips"),
            F.try_divide(F.count_if(match), F.count(match)).alias(f"{m}_match_fraction"),
            F.avg(f"absolute_change_{m}").alias(f"mean_absolute_change_{m}"),
        ]
    return scoped.groupBy("symbol", "scope").agg(*aggs)


def target_windows(members: DataFrame) -> DataFrame:
    """Label interval of each validation row and whether it meets the next row's interval."""
    v = members.filter(F.col("role") == "validation")
    w = W.partitionBy(*KEY).orderBy("date")
    nxt = F.lead("target_entry_date").over(w)
    return v.select(
        *KEY, "date", F.col("target_entry_date").alias("entry_date"), F.col("target_exit_date_5d").alias("exit_date"),
        F.lead("date").over(w).alias("next_validation_date"),
        F.when(nxt.isNotNull(), nxt <= F.col("target_exit_date_5d")).alias("overlaps_next"),
        F.row_number().over(w).alias("pos"),
        F.col("forward_return_5d").alias("y"),
    )


def interval_overlap(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping unordered pairs of closed intervals by counting, without forming pairs.

    Sweep each group's starts and ends in date order: an interval overlaps every one already open when it
    starts. Starts sort before ends of the same day because the intervals are closed.
    """
    edges = windows.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("entry_date").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
                F.struct(F.col("exit_date").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")),
            )
        ),
    )
    per_day = edges.groupBy(*keys, "at", "kind").agg(F.sum("step").alias("step"), F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*keys).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("step").over(w), F.lit(0))
    within = F.col("m") * (F.col("m") - 1) / 2
    return (
        per_day.withColumn("pairs", F.when(F.col("kind") == 0, F.col("m") * opened + within).otherwise(0))
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("kind") == 0, F.col("m"))).alias("n_windows"), F.sum("pairs").cast("bigint").alias("overlapping_pairs"))
        .withColumn("pair_denominator", (F.col("n_windows") * (F.col("n_windows") - 1) / 2).cast("bigint"))
        .withColumn("overlapping_fraction", F.try_divide("overlapping_pairs", "pair_denominator"))
    )


def adjacent_overlap(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEY).agg(
        F.count("overlaps_next").alias("adjacent_pairs"),
        F.count_if("overlaps_next").alias("adjacent_overlapping"),
        F.avg(F.col("overlaps_next").cast("double")).alias("adjacent_fraction"),
    )


def target_autocorrelation(windows: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Label autocorrelation and overlapping share at short lags within each fold; one row fans out to the fixed lags."""
    w = W.partitionBy(*KEY).orderBy("date")
    items = F.array(
        *[
            F.struct(
                F.lit(k).alias("lag"), F.lag("y", k).over(w).alias("prev"),
                (F.col("entry_date") <= F.lag("exit_date", k).over(w)).alias("overlaps"),
            )
            for k in lags
        ]
    )
    x = windows.withColumn("_l", items).select(*KEY, "y", F.inline("_l")).filter(F.col("prev").isNotNull())
    return x.groupBy(*KEY, "lag").agg(
        F.count(F.lit(1)).alias("pair_count"), pearson("prev", "y").alias("autocorrelation"),
        F.count_if("overlaps").alias("overlapping_pairs"), F.avg(F.col("overlaps").cast("double")).alias("overlapping_fraction"),
    )


def extrapolation_strata(oof: DataFrame, z: DataFrame, cut: float = 5.0) -> DataFrame:
    """Errors of rows whose largest |z| exceeds the cut against the rest; empty strata keep a zero count."""
    worst = z.groupBy(*KEY, "date").agg(F.max("abs_z").alias("row_max_z"))
    e = oof.join(worst, [*KEY, "date"]).withColumn("stratum", F.when(F.col("row_max_z") > cut, "beyond").otherwise("within"))
    err = F.col("prediction") - F.col("actual")
    structs = []
    for s in ("beyond", "within"):
        x = F.when(F.col("stratum") == s, err)
        structs.append(
            F.struct(F.lit(s).alias("stratum"), F.count(x).alias("n"), F.avg(x).alias("bias"), F.avg(F.abs(x)).alias("MAE"))
        )
    return e.groupBy("symbol", "model").agg(F.array(*structs).alias("s")).select("symbol", "model", F.inline("s"))


def gramian(z: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Normal-equation sums of the standardised training rows: n, and per feature pair sum(zi*zj); per feature sum(z), sum(z*y)."""
    k = len(features)
    columns = {f: F.col("z")[i] for i, f in enumerate(features)} | {"y": F.col("y")}
    names = F.array(*[F.lit(c) for c in columns])
    m = pair_moments(z, KEY, columns).filter(F.col("i") < k)  # rows where both have a value; z always has one
    total = F.col("cross") + F.col("n") * F.col("mean_i") * F.col("mean_j")
    sums = m.select(*KEY, F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n", total.alias("total"))
    ones = m.filter("i = j").select(*KEY, F.get(names, F.col("i")).alias("a"), F.lit("1").alias("b"), "n", (F.col("n") * F.col("mean_i")).alias("total"))
    return sums.unionByName(ones)


def fold_coverage(sessions: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Per fold and feature: observed training and validation cells, eligibility and selection, of sessions with `entry`, `valid` and `folds`.

    Sessions are counted once by the first fold that they train and the fold that they validate; these few counts make up those of each fold.
    """

    def cells(f: str) -> Column:
        x, here = finite(F.col(f).cast("double")), F.col(f).isNotNull()
        return F.struct(
            F.count(F.when(here, 1)).alias("filled"), F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.min(F.when(here, F.col("date"))).alias("first")
        )

    counted = sessions.groupBy("symbol", "entry", "valid", "folds").agg(F.count(F.lit(1)).alias("rows"), *[cells(f).alias(f) for f in features])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features])
    long = counted.select("symbol", "entry", "valid", "rows", F.explode("folds").alias("fold"), each.alias("each")).select(
        *KEY, "rows", (F.coalesce(F.col("entry") <= F.col("fold"), F.lit(False))).alias("train"), F.coalesce(F.col("valid") == F.col("fold"), F.lit(False)).alias("valid"), F.inline("each")
    )
    train, valid = F.col("train"), F.col("valid") & ~F.col("train")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    per = long.filter("train OR valid").groupBy(*KEY, "feature").agg(
        total("rows", train).alias("train_rows"), total("rows", valid).alias("validation_rows"), total("c.filled", train).alias("train_nonmissing"),
        total("c.filled", valid).alias("validation_nonmissing"), F.min("c.first").alias("first_available_date"),
        F.try_divide(total("c.n", train), total("rows", train)).alias("_coverage"), F.min(F.when(train, F.col("c.low"))).alias("_low"), F.max(F.when(train, F.col("c.high"))).alias("_high"),
    )
    _, _, used, reason = selection(F.col("_coverage"), F.col("_low"), F.col("_high"))
    return per.filter("train_rows > 0").select(
        *KEY, "train_rows", "validation_rows", "feature", "train_nonmissing", "validation_nonmissing", "first_available_date", used.alias("selected"),
        reason.alias("drop_reason"), (F.coalesce("_coverage", F.lit(0.0)) >= COVERAGE_MIN).alias("eligible"),
        F.try_divide("train_nonmissing", "train_rows").alias("train_coverage"), F.try_divide("validation_nonmissing", "validation_rows").alias("validation_coverage"),
    )
