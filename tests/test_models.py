import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitline.config import MARKET_FEATURES, RELATIVE_FEATURES, SplitConfig, WalkForwardConfig
from pitline.operators import metrics as met
from pitline.operators import models as mod
from pitline.operators import splits
from pitline.operators import stability as stab
from pitline.operators.labels import append_labels, label_columns
from pitline.operators.rolling import build_features, with_relative
from test_market import make_bars

EXTRA = ("sparse", "gappy", "flat", "twin")
FEATURES = (*MARKET_FEATURES, *[c for c in RELATIVE_FEATURES if c not in MARKET_FEATURES], *EXTRA)
ARMS = {"control": MARKET_FEATURES, "treatment": RELATIVE_FEATURES, "odd": ("simple_return", "twin", "gappy", "flat", "sparse")}
CFG = WalkForwardConfig(first_year=2024, first_quarter=3, n_folds=3)


@pytest.fixture(scope="module")
def study(spark):
    mp = pytest.MonkeyPatch()
    mp.setattr(mod, "QR_BLOCK_ROWS", 64)
    bars, _ = make_bars(spark, 320)
    x = with_relative(append_labels(build_features(bars)))
    x = x.withColumns(
        {
            "twin": F.col("simple_return"),
            "flat": F.lit(3.0),
            "gappy": F.when(F.dayofmonth("date") % 3 > 0, F.col("daily_range")),
            "sparse": F.when(F.dayofmonth("date") == 1, F.col("close")),
        }
    ).persist()
    members = splits.walk_forward_members(x, CFG).persist()
    params = mod.fit_preprocessing(members, FEATURES).persist()
    z = mod.training_rows(members, params, FEATURES)
    fits = mod.fit_linear(z, ARMS, FEATURES, whiten=True).persist()
    yield {"x": x, "members": members, "params": params, "z": z, "fits": fits, "pdf": members.toPandas()}
    mp.undo()


def test_expanding_statistics_equal_those_of_copied_rows(study):
    """Values sorted once per symbol give each fold what a sort of its own training rows gives; drops for both reasons occur."""
    got = mod.usage(mod.fit_expanding(splits.walk_forward_entries(study["x"], CFG), FEATURES)).toPandas()
    want = mod.usage(study["params"]).toPandas()
    keys = ["symbol", "fold", "feature"]
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert set(got.drop_reason) == {"used", "low_training_coverage", "zero_training_variance"}
    for c in (*keys, "n_train", "n", "used", "drop_reason", "position"):
        assert (got[c] == want[c]).all(), c
    for c in ("y_mean", "coverage", "median", "mean", "std", "scale", "train_min", "train_max"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_cv_entries_name_the_first_training_fold(study):
    cfg = SplitConfig(test_size=20, validation_size=15, folds=3, min_train=60)
    members = splits.cv_members(study["x"], cfg).filter("role = 'train'").groupBy("symbol", "date").agg(F.min("fold").alias("entry"), F.count("*").alias("n"))
    entries = splits.cv_entries(study["x"], cfg).select("symbol", "date", "entry", (F.size("folds") - F.col("entry") + 1).cast("long").alias("n"))
    assert members.exceptAll(entries).count() == 0 == entries.exceptAll(members).count() and entries.count() > 0


def expected(pdf, symbol, fold, arm):
    g = pdf[(pdf.symbol == symbol) & (pdf.fold == fold)]
    tr, va = g[g.role == "train"], g[g.role == "validation"].sort_values("date")
    ztr, zva, used = [], [], []
    for f in ARMS[arm]:
        v = tr[f].astype(float)
        if v.notna().mean() < 0.5:
            continue
        m = v.median()
        filled = v.fillna(m)
        if (filled == filled.iloc[0]).all():
            continue
        mean, sd = filled.mean(), filled.std(ddof=0)
        used.append(f)
        ztr.append((filled - mean) / sd)
        zva.append((va[f].astype(float).fillna(m) - mean) / sd)
    a, b = np.column_stack(ztr), np.column_stack(zva)
    y = tr.forward_return_5d.to_numpy(float)
    ac = a - a.mean(axis=0)
    ols = np.linalg.lstsq(ac, y - y.mean(), rcond=None)[0]
    ridge = np.linalg.solve(ac.T @ ac + np.eye(ac.shape[1]), ac.T @ (y - y.mean()))
    return used, a, y, {"ols": ols, "ridge": ridge}, va, b


def test_fits_and_predictions_equal_numpy(study):
    oof = mod.predict(study["members"], study["params"], study["fits"], ARMS, FEATURES).toPandas()
    table = mod.parameters(study["fits"], ARMS).toPandas()
    for symbol in ("AAA", "BBB"):
        for fold in (0, 2):
            for arm in ARMS:
                used, a, y, coef, va, b = expected(study["pdf"], symbol, fold, arm)
                for fam, beta in coef.items():
                    pred = y.mean() + b @ beta
                    got = oof[(oof.symbol == symbol) & (oof.fold == fold) & (oof.model == f"{arm}_{fam}")].sort_values("date")
                    np.testing.assert_allclose(got.prediction, pred, rtol=1e-6, atol=1e-8)
                    t = table[(table.symbol == symbol) & (table.fold == fold) & (table.arm == arm) & (table.family == fam)].set_index("feature").coefficient
                    np.testing.assert_allclose(t.loc[used], beta, rtol=1e-5, atol=1e-7)
                    assert (t.drop(used) == 0).all()
    zero = oof[oof.model == "zero_return"]
    assert len(zero) and (zero.prediction == 0).all()


def test_preprocessing_reasons(study):
    u = mod.usage(study["params"]).toPandas()
    assert set(u[u.feature == "flat"].drop_reason) == {"zero_training_variance"}
    assert set(u[u.feature == "sparse"].drop_reason) == {"low_training_coverage"}
    assert u[u.feature == "gappy"].used.all()


def test_folds_of_whole_symbols_equal_copied_rows(study):
    """Fits and predictions of sessions held once are those of rows copied to folds, and the plan copies no row to a fold."""
    folds = mod.fit_folds(splits.walk_forward_sessions(study["x"], CFG), ARMS, FEATURES, whiten=True)
    stored = mod.predict(study["members"], study["params"], study["fits"], ARMS, FEATURES)
    r = met.control_reproduction(mod.predictions_of(folds, ARMS), stored, rtol=1e-7, atol=1e-9).toPandas()
    assert len(r) == 2 * (2 + 2 * len(ARMS)) and r.rows_checked.min() > 50
    assert r[["identity_violations", "actual_violations", "tolerance_violations"]].to_numpy().sum() == 0
    keys = ["symbol", "fold", "arm", "family"]
    got, want = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (mod.fits_of(folds), study["fits"]))
    for c in (*keys, "n_rows", "n_features", "rank", "design_rank"):
        assert (got[c] == want[c]).all(), c
    np.testing.assert_allclose(np.concatenate(got.coef), np.concatenate(want.coef), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(got.sv_max, want.sv_max, rtol=1e-9)
    assert "Generate" not in folds._jdf.queryExecution().optimizedPlan().toString()


def test_cv_sessions_have_the_roles_of_copied_rows(study):
    cfg = SplitConfig(test_size=20, validation_size=15, folds=3, min_train=60)
    members = splits.cv_members(study["x"], cfg).select("symbol", "date", "fold", "role")
    once = splits.cv_sessions(study["x"], cfg)
    train = once.select("symbol", "date", F.explode("folds").alias("fold"), "entry").filter("fold >= entry").select("symbol", "date", "fold", F.lit("train").alias("role"))
    both = train.unionByName(once.filter("valid IS NOT NULL").select("symbol", "date", F.col("valid").alias("fold"), F.lit("validation").alias("role")))
    assert members.exceptAll(both).isEmpty() and both.exceptAll(members).isEmpty() and both.count() > 200


def test_influence_and_associations_of_whole_symbols_equal_copied_rows(study):
    """What rows copied to folds and joined with their parameters give, from sessions held once; no row is generated before the fit."""
    once = splits.walk_forward_sessions(study["x"], CFG)
    keys = ["symbol", "fold", "date"]
    got = mod.fold_influence(once, "treatment", ARMS, FEATURES).toPandas().sort_values(keys).reset_index(drop=True)
    want = mod.influence(study["members"], study["params"], study["fits"], "treatment", ARMS, FEATURES).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(got) > 300 and (got[[*keys, "design_rank", "residual_df", "undefined_reason"]] == want[[*keys, "design_rank", "residual_df", "undefined_reason"]]).all(axis=None)
    for c in ("actual", "fitted", "residual", "leverage", "residual_mse", "studentised_residual", "cooks_distance"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-6, atol=1e-9, err_msg=c)
    keys = ["symbol", "fold", "feature"]
    a = stab.sign_changes(mod.fold_associations(once, FEATURES)).toPandas().sort_values(keys).reset_index(drop=True)
    b = stab.associations(mod.train_validation_z(study["members"], study["params"], FEATURES)).toPandas().sort_values(keys).reset_index(drop=True)
    assert list(a.columns) == list(b.columns) and len(a) > 50
    for c in a.columns:
        if a[c].dtype == float and c not in ("train_n", "validation_n"):
            np.testing.assert_allclose(a[c], b[c], rtol=1e-7, atol=1e-9, err_msg=c)
        else:
            assert (a[c].isna() == b[c].isna()).all() and (a[c].dropna() == b[c].dropna()).all(), c


def test_blocks_really_split(study):
    assert study["z"].select("block").distinct().count() > 1


def test_scores_rebuilt_from_table(study):
    table = mod.parameters(study["fits"], {"treatment": RELATIVE_FEATURES, **{k: v for k, v in ARMS.items() if k != "treatment"}})
    stored = mod.predict(study["members"], study["params"], study["fits"], ARMS, FEATURES, baselines=False)
    again = mod.score_from_table(study["members"], study["params"], table, FEATURES)
    r = met.control_reproduction(again, stored, rtol=1e-8, atol=1e-10).toPandas()
    assert r[["identity_violations", "actual_violations", "tolerance_violations"]].to_numpy().sum() == 0


def test_conditioning_and_influence(study):
    c = mod.conditioning(study["fits"]).toPandas()
    odd = c[(c.symbol == "AAA") & (c.fold == 1) & (c.arm == "odd")].iloc[0]
    assert odd.rank_deficient and odd.matrix_rank == odd.used_features - 1 and pd.isna(odd.condition_number)
    used, a, y, coef, _, _ = expected(study["pdf"], "AAA", 1, "treatment")
    row = c[(c.symbol == "AAA") & (c.fold == 1) & (c.arm == "treatment")].iloc[0]
    sv = np.linalg.svd(a, compute_uv=False)
    np.testing.assert_allclose([row.largest_singular_value, row.smallest_singular_value], [sv[0], sv[-1]], rtol=1e-8)
    inf = mod.influence(study["members"], study["params"], study["fits"], "treatment", ARMS, FEATURES).toPandas()
    inf = inf[(inf.symbol == "AAA") & (inf.fold == 1)].sort_values("date")
    g = study["pdf"]
    tr = g[(g.symbol == "AAA") & (g.fold == 1) & (g.role == "train")]
    order = np.argsort(tr.date.to_numpy())
    d = np.column_stack([np.ones(len(a)), a])[order]
    q, _ = np.linalg.qr(d)
    np.testing.assert_allclose(inf.leverage, (q**2).sum(axis=1), rtol=1e-6, atol=1e-9)
    res = y[order] - (y.mean() + a[order] @ coef["ols"])
    mse = res @ res / (len(res) - d.shape[1])
    np.testing.assert_allclose(inf.studentised_residual, res / np.sqrt(mse * (1 - (q**2).sum(axis=1))), rtol=1e-4, atol=1e-6)


def test_metrics_on_known_values(spark):
    rows = [("A", 1, f"2024-01-0{i}", "m", a, p) for i, (a, p) in enumerate([(1.0, 2.0), (2.0, 2.0), (-1.0, 0.0), (4.0, 3.0)], 1)]
    rows += [("A", 2, f"2024-02-0{i}", "m", 1.0, float(i)) for i in range(1, 4)]
    oof = spark.createDataFrame(rows, "symbol string, fold int, date string, model string, actual double, prediction double")
    m = met.regression_metrics(oof, ["symbol", "fold"]).orderBy("fold").collect()
    a, p = np.array([1, 2, -1, 4.0]), np.array([2, 2, 0, 3.0])
    assert m[0].MAE == pytest.approx(0.75) and m[0].R2 == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert m[0].Pearson == pytest.approx(np.corrcoef(a, p)[0, 1])
    assert m[0].Spearman == pytest.approx(np.corrcoef(pd.Series(a).rank(), pd.Series(p).rank())[0, 1])
    assert m[0].directional_accuracy == 0.75
    assert (m[1].R2, m[1].Pearson, m[1].Spearman) == (None, None, None)
    c = met.error_concentration(oof).filter("fold = 1").first()
    assert c.top_3_share == pytest.approx(1.0) and str(c.largest_error_date) == "2024-01-01"


def test_interval_overlap_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    start = rng.integers(0, 60, 80)
    pdf = pd.DataFrame({"g": "x", "s": start, "e": start + rng.integers(0, 9, 80)})
    day = F.to_date(F.lit("2024-01-01"))
    w = spark.createDataFrame(pdf).select("g", F.date_add(day, F.col("s").cast("int")).alias("entry_date"), F.date_add(day, F.col("e").cast("int")).alias("exit_date"))
    got = stab.interval_overlap(w, ["g"]).first()
    iv = list(zip(pdf.s, pdf.e))
    want = sum(max(a[0], b[0]) <= min(a[1], b[1]) for i, a in enumerate(iv) for b in iv[i + 1 :])
    assert (got.n_windows, got.overlapping_pairs) == (80, want)


def test_manifest_audit_neither_sorts_nor_shuffles_the_manifest(spark):
    """Twelve rows a session pass the audit in one stream; odd rows are counted, and an unknown session keeps its symbol's windows."""
    cfg = SplitConfig(test_size=20, validation_size=15, folds=3, min_train=60)
    labels = append_labels(make_bars(spark, 220)[0]).select("symbol", "date", *label_columns())
    m = splits.build_manifest(labels, cfg)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        audit = splits.manifest_audit(m, labels, cfg)
        plan = audit._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate")]
        assert "SortMergeJoin" not in plan and "Sort " not in above and "Exchange" not in above
        assert plan.count("explode(") == 2, "the manifest is made once"
        sound = {r.symbol: r for r in audit.collect()}
        cell = F.struct("symbol", "target_name", "fold")
        one = m.filter("fold = 'cv_2' AND target_name = 'forward_return_5d' AND role = 'train'").groupBy(cell.alias("c")).agg(F.min_by(F.struct(*m.columns), "date").alias("r")).select("r.*")
        odd = one.withColumn("fold", F.lit(None).cast("string")).unionByName(one.withColumn("target_name", F.lit("other"))).unionByName(one.withColumn("date", F.lit("1900-01-01").cast("date")))
        got = {r.symbol: r for r in splits.manifest_audit(m.unionByName(odd), labels, cfg).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(got) == len(sound) == one.count() > 0
    for symbol, r in got.items():
        assert r.rows_checked == sound[symbol].rows_checked + 3 and not any(sound[symbol][2:])
        assert r.unknown_session_violations == 2  # another target, another date
        assert r.boundary_violations == 1  # the row without a fold alone


def test_manifest_roles(spark):
    bars, _ = make_bars(spark, 220, ("AAA",))
    labels = append_labels(build_features(bars))
    cfg = SplitConfig(test_size=30, validation_size=15, folds=3, min_train=60)
    m = splits.build_manifest(labels, cfg)
    audit = splits.manifest_audit(m, labels, cfg).first()
    assert all(audit[c] == 0 for c in audit.asDict() if c.endswith("violations"))
    assert splits.fold_overlap(m).first().validation_overlaps == 0
    p = m.filter("target_name = 'forward_return_5d'").toPandas()
    final = p[p.fold == "final"].sort_values("date")
    assert (final.role == "final_test").sum() == 30 and (final.role == "purged").sum() == 5
    assert (p[(p.fold == "cv_3")].role == "validation").sum() == 15
    bad = m.withColumn("role", F.when((F.col("role") == "purged"), "train").otherwise(F.col("role")))
    assert splits.manifest_audit(bad, labels, cfg).first().leakage_violations > 0
    short = append_labels(build_features(make_bars(spark, 100, ("AAA",))[0]))
    assert splits.build_manifest(short).count() == 0 and not splits.readiness(splits.layout(short)).first().sufficient


def test_open_calendar_ends_with_the_last_labelled_session(study):
    x = study["x"]
    members = splits.walk_forward_members(x, WalkForwardConfig(first_year=2024, first_quarter=3))
    got = members.filter("role = 'validation'").groupBy("symbol").agg(F.max("date").alias("last"), F.min("date").alias("first"))
    want = x.filter("forward_return_5d IS NOT NULL").groupBy("symbol").agg(F.max("date").alias("last"))
    assert got.select("symbol", "last").exceptAll(want).isEmpty() and got.count() == want.count()
    assert got.filter("first < '2024-07-01'").isEmpty()
    later = x.filter("forward_return_5d IS NOT NULL AND date >= '2024-07-01'").count()
    assert members.filter("role = 'validation'").count() == later


def test_declared_fold_without_sessions_raises(study):
    with pytest.raises(Exception, match="a declared fold has no labelled session"):
        splits.walk_forward_members(study["x"], WalkForwardConfig(first_year=2024, first_quarter=3, n_folds=40)).count()


def test_locked_window_is_not_seen(study):
    lock = study["pdf"].query("fold == 1 and role == 'validation'").date.max().isoformat()
    members = splits.walk_forward_members(study["x"], WalkForwardConfig(first_year=2024, first_quarter=3, locked_from=lock))
    audit = splits.lock_audit(members, lock)
    assert members.filter("role = 'validation' AND fold = 1").count() > 0
    names = [c for c in audit.columns if c != "symbol"]
    assert all(r[c] == 0 for r in audit.collect() for c in names)
    open_end = splits.lock_audit(splits.walk_forward_members(study["x"], CFG), lock).agg(F.sum("labels_reaching_lock")).first()[0]
    assert open_end > 0


def test_fold_coverage_counts_each_session_once(spark):
    """no kept copy of the matrix, no row copied to folds, and the verdicts of the preprocessing table."""
    import datetime as dt

    from pitline.operators import stability as stab
    from pitline.plans import load_all
    from pitline.plans.registry import REGISTRY

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    # sessions 0 to 3 train folds 1 and 2, 4 trains fold 2 alone; 4 and 5 validate fold 1, 6 fold 2
    rows = [("X", day(i), 1 if i < 4 else 2 if i == 4 else None, 1 if i in (4, 5) else 2 if i == 6 else None, [1, 2], float(i % 2), None if i < 3 else 1.0, 2.0) for i in range(7)]
    s = spark.createDataFrame(rows, "symbol string, date date, entry int, valid int, folds array<int>, a double, b double, c double")
    got = {(r.fold, r.feature): r for r in stab.fold_coverage(s, ("a", "b", "c")).collect()}
    assert len(got) == 6
    assert [(got[1, f].train_rows, got[1, f].validation_rows, got[1, f].train_nonmissing, got[1, f].validation_nonmissing, got[1, f].drop_reason) for f in "abc"] == [
        (4, 2, 4, 2, "used"), (4, 2, 1, 2, "low_training_coverage"), (4, 2, 4, 2, "zero_training_variance")
    ]
    assert [(got[2, f].train_rows, got[2, f].validation_rows, got[2, f].train_nonmissing, got[2, f].eligible) for f in "ab"] == [(5, 1, 5, True), (5, 1, 2, False)]
    assert got[1, "b"].first_available_date == day(3)
    load_all()
    plan = REGISTRY["fundamental_fold_coverage"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Arrow" not in plan


def test_folds_are_solved_together():
    """F1, F8: the stacked solution of all folds and arms is that of each by itself, rank-deficient and empty arms included."""
    from pitline.operators import models as mod

    rng = np.random.default_rng(7)
    factors, sizes = [], []
    for n in (30, 60, 90):
        z = rng.normal(size=(n, 4))
        z[:, 3] = z[:, 0] if n == 60 else 0.0
        factors.append(mod._factor(z, rng.normal(size=n)))
        sizes.append(n)
    subsets = [[0], [3], [0, 1, 3], [], [1, 2, 3]]
    intercepts, coefs = mod._lines(np.stack(factors), np.array(sizes), subsets, 1.0)
    want = [x for r, n in zip(factors, sizes) for cols in subsets if cols for x in mod._solve(r, n, cols, 1.0, False)]
    got = [(i, c) for i, c in zip(intercepts, coefs) if len(c)]
    assert len(intercepts) == 3 * 5 * 2 and len(got) == len(want)
    for (i, c), x in zip(got, want):
        assert np.allclose(i, x["intercept"], atol=1e-12) and np.allclose(c, x["coef"], atol=1e-12)


def test_replayed_predictions_are_unpivoted_where_their_fold_lies(spark):
    """what is kept are slim sessions, and no row of a feature or model is shuffled before it is counted."""
    from pitline.plans import load_all
    from pitline.plans.registry import REGISTRY

    load_all()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of any size
    try:
        plan = REGISTRY["prediction_audit_faults"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = [line.split("hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    dealt = [keys for keys in dealt if "fold#" in keys]
    assert dealt and not any(name in keys for keys in dealt for name in ("date#", "feature#", "model#"))
    assert "rolling_volatility_60#" not in "".join(line for line in plan.splitlines() if "InMemoryTableScan" in line)
