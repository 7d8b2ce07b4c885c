import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import MARKET_FEATURES, WalkForwardConfig
from pitline.operators import audits as aud
from pitline.operators import models as mod
from pitline.operators import splits, variants
from pitline.operators.compare import exact_diff
from pitline.operators.labels import append_labels
from pitline.operators.rolling import build_features
from test_market import make_bars

CFG = WalkForwardConfig(first_year=2024, first_quarter=3)
FEATURES = ("daily_range", "simple_return")
ARMS = {"a": FEATURES}
DAY = "2024-11-15"


def test_copies_read_the_original_values(spark):
    df = spark.createDataFrame([("A", 1, 10), ("A", 2, 20)], "symbol string, x int, y int")
    got = variants.split_variants(variants.with_variants(df, {"swap": {"x": F.col("y"), "y": F.col("x")}}, {"short": F.col("x") == 2})).collect()
    rows = {(r.variant, r.symbol, r.x, r.y) for r in got}
    assert rows == {("base", "A", 1, 10), ("base", "A", 2, 20), ("swap", "A", 10, 1), ("swap", "A", 20, 2), ("short", "A", 1, 10)} and len(got) == 5
    with pytest.raises(ValueError, match="variant"):
        variants.with_variants(df, {"base": {}})


def test_dependencies_equal_those_of_whole_rebuilds(spark):
    """The restricted range misses no cell that a rebuild of the whole history moves."""
    bars, _ = make_bars(spark, 200)
    day = "2024-05-15"
    changes = {"close": lambda c: c * 1.01, "open": lambda c: c * 1.02, "volume": lambda c: c + 5}
    got = {(r.field, r.output): r.changed_cells for r in aud.dependency_probe(bars, day, changes).collect()}
    base = aud.outputs(bars)
    for field, change in changes.items():
        probe = F.min(F.when(F.col("date") >= day, F.col("date"))).over(W.partitionBy("symbol"))
        other = aud.outputs(bars.withColumn("p", probe).withColumn(field, F.when(F.col("date") == F.col("p"), change(F.col(field))).otherwise(F.col(field))).drop("p"))
        for r in exact_diff(base, other, ["symbol", "date"]).filter("column <> '__rows__'").collect():
            assert got[field, r.column] == r.changed_cells, (field, r.column)
    assert got["close", "sma_60"] == 120 and got["volume", "sma_60"] == 0
    assert all(n == 0 for n in (r.changed_cells for r in aud.dependency_probe(bars, "2030-01-01", changes).collect()))


def fitted(frame):
    members = splits.walk_forward_members(frame, CFG)
    params = mod.fit_preprocessing(members, FEATURES)
    fits = mod.fit_linear(mod.training_rows(members, params, FEATURES), ARMS, FEATURES).persist()
    return mod.parameters(fits, ARMS), mod.predict(members, params, fits, ARMS, FEATURES)


def test_model_leakage(spark):
    bars, _ = make_bars(spark, 320)
    frame = append_labels(build_features(bars)).select("symbol", "date", *MARKET_FEATURES, "forward_return_5d", "target_exit_date_5d").persist()
    starts = splits.walk_forward_members(frame, CFG).select("symbol", "fold", "fold_start").distinct()
    copies = variants.leakage_variants(frame, DAY, FEATURES, "forward_return_5d", "target_exit_date_5d")
    parameters, predictions = fitted(copies)
    got = {(r.symbol, r.variant): r for r in variants.model_leakage(parameters, predictions, starts, DAY).collect()}
    assert len(got) == 8
    for (_, variant), r in got.items():
        # two folds start by the day; the control moves the fold of its quarter alone
        assert r.parameters_checked == 8 and r.later_reacts
        assert r.parameters_changed == (4 if variant == "realised_label" else 0)
        assert (r.predictions_changed > 0) == (variant == "realised_label") and r.predictions_changed < r.predictions_checked
    # a fit that sees labels before they are realised is caught
    unpurged = copies.withColumn("target_exit_date_5d", F.col("date"))
    r = {r.variant: r for r in variants.model_leakage(*fitted(unpurged), starts, DAY).collect()}
    assert r["later_features"].parameters_changed == 0
    early = variants.leakage_variants(frame, "2024-10-03", FEATURES, "forward_return_5d", "target_exit_date_5d").withColumn("target_exit_date_5d", F.col("date"))
    r = {r.variant: r for r in variants.model_leakage(*fitted(early), starts, "2024-10-03").collect()}
    assert r["later_labels"].parameters_changed == 4 and r["later_features"].parameters_changed == 0


def test_leakage_inside_folds_equals_that_of_rows(spark):
    """Folds compared as one row each give the counts of predictions and parameters compared row by row."""
    bars, _ = make_bars(spark, 320)
    frame = append_labels(build_features(bars)).select("symbol", "date", *MARKET_FEATURES, "forward_return_5d", "target_exit_date_5d").persist()
    starts = splits.walk_forward_members(frame, CFG).select("symbol", "fold", "fold_start").distinct()
    assert starts.exceptAll(splits.walk_forward_starts(frame, CFG)).isEmpty()
    copies = variants.leakage_variants(frame, DAY, FEATURES, "forward_return_5d", "target_exit_date_5d")
    for rows in (copies, copies.withColumn("target_exit_date_5d", F.col("date"))):
        want = variants.model_leakage(*fitted(rows), starts, DAY)
        folds = mod.fit_folds(splits.walk_forward_sessions(rows, CFG), ARMS, FEATURES, diagnose=False)
        got = variants.fold_leakage(folds, splits.walk_forward_starts(frame, CFG), DAY)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "prediction#" not in plan  # no row for each prediction
