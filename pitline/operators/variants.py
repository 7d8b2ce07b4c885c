"""Counterfactual copies of a table as one more dimension: all changes run in one plan beside the unchanged rows.

A copy's name travels in front of the symbol, so whatever works by symbol works by copy and symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.functions.numeric import is_close

BASE = "base"
SEP = "\u001f"


def with_variants(frame: DataFrame, changes: dict[str, dict[str, Column]], without: dict[str, Column] | None = None) -> DataFrame:
    """The rows once unchanged and once for each change: columns replaced by expressions, or rows left out where a condition holds."""
    without = without or {}
    names = [BASE, *changes, *[n for n in without if n not in changes]]
    if len(set(names)) != len(names) or any(SEP in n for n in names):
        raise ValueError(f"unusable variant names: {names}")
    copies = frame.withColumn("_variant", F.explode(F.array(*[F.lit(n) for n in names])))
    for name, drop in without.items():
        copies = copies.filter((F.col("_variant") != name) | ~F.coalesce(drop, F.lit(False)))
    touched = {c for change in changes.values() for c in change}
    cells = {}
    for c in touched:
        # each change reads the original values
        cell = F.col(c)
        for name, change in changes.items():
            if c in change:
                cell = F.when(F.col("_variant") == name, change[c]).otherwise(cell)
        cells[c] = cell
    return copies.withColumns(cells | {"symbol": F.concat(F.col("_variant"), F.lit(SEP), F.col("symbol"))}).drop("_variant")


def split_variants(frame: DataFrame) -> DataFrame:
    """`variant` and the plain symbol back as columns."""
    parts = F.split("symbol", SEP, 2)
    return frame.withColumns({"variant": parts[0], "symbol": parts[1]})


def against_base(frame: DataFrame, key: list[str], values: list[str], names: list[str]) -> DataFrame:
    """(key, variant, base, changed): each row's values beside the unchanged ones; a missing side is null. One shuffle, no join."""
    cells = F.struct("variant", F.struct(*values).alias("v"))
    sides = frame.groupBy(*key).agg(F.collect_list(cells).alias("sides"))  # one entry for each variant
    of = lambda name: F.get(F.filter("sides", lambda s: s["variant"] == name), F.lit(0))["v"]
    each = F.array(*[F.struct(F.lit(n).alias("variant"), of(n).alias("changed")) for n in names])
    return sides.select(*key, of(BASE).alias("base"), F.inline(each))


# ---- fits and predictions --------------------------------------------------------------------------
def leakage_variants(frame: DataFrame, day: str, features: tuple[str, ...], target: str, exit_date: str, factor: float = 17.0) -> DataFrame:
    """Copies of a model frame in which something that is unknown on a day differs, and one where something known does.

    later_features, later_rows: sessions from the day on. later_labels: labels whose exit is on or after the day, those of earlier
    sessions too, which only a purge keeps out of the folds that start before. realised_label, the control: the last label that is
    realised before the first session of the day's quarter.
    """
    of_symbol = lambda agg: F.expr(f"{agg} OVER (PARTITION BY symbol)")
    df = frame.withColumn("_start", of_symbol(f"min(CASE WHEN date >= trunc(DATE '{day}', 'quarter') AND date < DATE '{day}' THEN date END)"))
    df = df.withColumn("_known", of_symbol(f"max(CASE WHEN `{target}` IS NOT NULL AND `{exit_date}` < _start THEN date END)"))
    later = F.col("date") >= F.lit(day).cast("date")
    y = F.col(target)
    changes = {
        "later_features": {f: F.when(later, F.col(f) * factor).otherwise(F.col(f)) for f in features},
        "later_labels": {target: F.when(F.col(exit_date) >= F.lit(day).cast("date"), y + 1).otherwise(y)},
        "realised_label": {target: F.when(F.col("date") == F.col("_known"), y + 1).otherwise(y)},
    }
    return with_variants(df, changes, {"later_rows": later}).drop("_start", "_known")


LEAKAGE_VARIANTS = ("later_features", "later_labels", "later_rows", "realised_label")


def model_leakage(parameters: DataFrame, predictions: DataFrame, starts: DataFrame, day: str, names: tuple[str, ...] = LEAKAGE_VARIANTS) -> DataFrame:
    """Per symbol and variant: parameters of folds that start by the day and predictions before it, how many of them moved, and
    whether parameters of later folds did.

    parameters (symbol, fold, arm, family, feature, intercept, coefficient) and predictions (symbol, fold, date, model, prediction)
    come from frames with variants; starts (symbol, fold, fold_start) from the unchanged one.
    """
    limit = F.lit(day).cast("date")

    def moved(*values: str) -> Column:
        far = F.lit(False)
        for v in values:
            far = far | ~is_close(F.col("base")[v], F.col("changed")[v], 1e-9)
        return F.col("changed").isNull() | far

    p = against_base(split_variants(parameters), ["symbol", "fold", "arm", "family", "feature"], ["intercept", "coefficient"], list(names))
    known = F.col("fold_start") <= limit
    p = p.join(starts, ["symbol", "fold"]).groupBy("symbol", "variant").agg(
        F.count_if(known).alias("parameters_checked"), F.count_if(known & moved("intercept", "coefficient")).alias("parameters_changed"),
        F.count_if(~known & moved("intercept", "coefficient")).alias("later"),
    )
    early = split_variants(predictions).filter(F.col("date") < limit)
    o = against_base(early, ["symbol", "fold", "date", "model"], ["prediction"], list(names)).groupBy("symbol", "variant").agg(
        F.count(F.lit(1)).alias("predictions_checked"), F.count_if(moved("prediction")).alias("predictions_changed")
    )
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(o, ["symbol", "variant"], "left").select(
        "symbol", "variant", "parameters_checked", "parameters_changed", none("predictions_checked"), none("predictions_changed"), (F.col("later") > 0).alias("later_reacts")
    )


def fold_leakage(folds: DataFrame, starts: DataFrame, day: str, names: tuple[str, ...] = LEAKAGE_VARIANTS) -> DataFrame:
    """The counts of `model_leakage` from rows of `fit_folds` over a frame with variants.

    A fold's fits and predictions meet those of its copies as one row each, and are compared inside it; no prediction is a row of its own.
    Where both sides have the same days their scores are compared side by side, and day by day only where they differ.
    """
    limit = F.lit(day).cast("date")
    near = lambda a, b: is_close(a, b, 1e-9)
    total = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda a, b: a + b)
    early = F.filter("date", lambda d: d < limit)
    sides = split_variants(folds.select("symbol", "fold", "fits", early.alias("days"), F.col("date").alias("all_days"), "scores"))
    each = against_base(sides, ["symbol", "fold"], ["fits", "days", "all_days", "scores"], list(names)).join(starts, ["symbol", "fold"])
    b, c = F.col("base"), F.col("changed")
    some = F.when(b.isNotNull(), b).otherwise(c)

    def moved_fit(x: Column, y: Column) -> Column:
        same = F.transform(F.arrays_zip(x["coef"].alias("p"), y["coef"].alias("q")), lambda v: (~near(v["p"], v["q"])).cast("bigint"))
        return F.when(near(x["intercept"], y["intercept"]), total(same)).otherwise(F.size(x["coef"]).cast("bigint"))

    fits = F.transform(F.arrays_zip(b["fits"].alias("x"), c["fits"].alias("y")), lambda v: moved_fit(v["x"], v["y"]))
    n_fits = total(F.transform(some["fits"], lambda f: F.size(f["coef"]).cast("bigint")))
    both = b.isNotNull() & c.isNotNull()

    def moved_day(d: Column) -> Column:
        i, j = F.array_position(b["all_days"], d).cast("int") - 1, F.array_position(c["all_days"], d).cast("int") - 1
        far = F.transform(
            F.arrays_zip(b["scores"].alias("x"), c["scores"].alias("y")), lambda v: (~near(F.get(v["x"], i), F.get(v["y"], j))).cast("bigint")
        )
        return F.when((i >= 0) & (j >= 0), total(far)).otherwise(F.size(some["scores"]).cast("bigint"))

    pairs = F.arrays_zip(b["scores"].alias("x"), c["scores"].alias("y"))
    by_model = F.transform(pairs, lambda m: total(F.transform(F.arrays_zip(m["x"].alias("p"), m["y"].alias("q"), b["all_days"].alias("d")), lambda v: ((v["d"] < limit) & ~near(v["p"], v["q"])).cast("bigint"))))

    empty = F.array().cast("array<date>")
    days = F.array_union(F.coalesce(b["days"], empty), F.coalesce(c["days"], empty))
    n_scores = (F.size(days) * F.size(some["scores"])).cast("bigint")
    counted = each.select(
        "symbol", "variant", (F.col("fold_start") <= limit).alias("known"), n_fits.alias("fits"), F.when(both, total(fits)).otherwise(n_fits).alias("fits_moved"),
        n_scores.alias("scores"), F.when(both & (b["all_days"] == c["all_days"]), total(by_model)).when(both, total(F.transform(days, moved_day))).otherwise(n_scores).alias("scores_moved"),
    )
    known = lambda c, flag: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).alias
    out = counted.groupBy("symbol", "variant").agg(
        known("fits", F.col("known"))("parameters_checked"), known("fits_moved", F.col("known"))("parameters_changed"),
        F.sum("scores").alias("predictions_checked"), F.sum("scores_moved").alias("predictions_changed"), known("fits_moved", ~F.col("known"))("later"),
    )
    return out.withColumn("later_reacts", F.col("later") > 0).drop("later")
