import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitline.config import MARKET_FEATURES
from pitline.operators import audits as aud
from pitline.operators import compare as cmp
from pitline.operators import moments, runs
from pitline.operators import profile as prof
from pitline.operators.rolling import build_features
from pitline.plans import load_all
from pitline.plans.registry import REGISTRY
from pitline.sources import charts
from test_market import make_bars


def long_frame(spark, values):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), "f", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, feature string, value double")


def wide_frame(spark, values):
    return long_frame(spark, values).select("symbol", "date", F.col("value").alias("f"))


def test_runs_and_inventory(spark):
    v = [None, None, 1.0, 1.0, None, 2.0, 2.0, 2.0, None, None, None, 3.0]
    r = prof.inventory(wide_frame(spark, v), ("f",)).first()
    assert (r.non_null_count, r.unique_count, r.longest_missing_run, r.missing_blocks, r.value_changes) == (6, 3, 3, 3, 0)
    assert runs.run_summaries(wide_frame(spark, v), ("f",)).first().longest_constant_run == 3
    assert prof.inventory(wide_frame(spark, [None] * 3), ("f",)).first().coverage_label == "all_missing"
    assert prof.inventory(wide_frame(spark, []), ("f",)).count() == 0


def plain_runs(values):
    """(valid, longest gap, gaps, longest equal run, transitions, changes, leading gap) of a list, value by value."""
    groups = [(k, len(list(g))) for k, g in itertools.groupby(values)]
    gaps = [n for k, n in groups if k is None]
    changes = sum(a is not None and b is not None and a != b for a, b in zip(values, values[1:]))
    leading = groups[0][1] if groups[0][0] is None else 0
    return (sum(v is not None for v in values), max(gaps, default=0), len(gaps), max((n for k, n in groups if k is not None), default=0), len(groups) - 1, changes, leading)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_run_summaries_join_over_blocks(block):
    rng = np.random.default_rng(block)
    for n in (1, 2, 7, 40):
        x = rng.choice([1.0, 2.0, np.nan], size=(n, 30), p=[0.45, 0.2, 0.35])
        x[:, 0], x[:, 1] = np.nan, 1.0
        r = runs.summary(x, np.arange(n), block)
        for c in range(x.shape[1]):
            want = plain_runs([None if np.isnan(v) else v for v in x[:, c]])
            assert (r.valid[c], r.longest_missing[c], r.missing_blocks[c], r.longest_equal[c], r.transitions[c], r.changes[c], r.head_missing[c]) == want
            assert list(r.values[c]) == sorted({v for v in x[:, c] if not np.isnan(v)})


def test_pair_moments_merge_as_one_block(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, size=(90, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 4]), np.nan, 7.0)  # constant
    names = rng.integers(0, 6, 90)
    state = np.ma.MaskedArray(names, names == 0)
    whole = moments.PairMoments.of(x, {0: state, 1: state})
    parts = moments.PairMoments(5)
    for rows in np.array_split(np.arange(90), [1, 1, 20, 77]):
        parts.merge(moments.PairMoments.unpacked(moments.PairMoments.of(x[rows], {0: state[rows], 1: state[rows]}).packed(), 5))
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            for m in (whole, parts):
                assert m.n[i, j] == both.sum() and m.mean[i, j] == pytest.approx(a.mean(), rel=1e-12)
                assert m.square[i, j] == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-9, abs=1e-9)
                assert m.cross[i, j] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), rel=1e-7, abs=1e-9)
                assert (m.low[i, j], m.high[i, j]) == (a.min(), a.max())
            assert whole.seen.get((i, j), set()) == parts.seen.get((i, j), set()) == (set(names[both & (names > 0)].tolist()) if i < 2 else set())
    frame = spark.createDataFrame([(int(r % 3), *[None if np.isnan(v) else float(v) for v in row]) for r, row in enumerate(x)], "k int, a double, b double, c double, d double, e double").repartition(7)
    got = moments.pair_moments(frame, ["k"], {c: F.col(c) for c in "abcde"}).select("*", moments.correlation().alias("r")).collect()
    assert len(got) == 3 * 15
    for row in got:
        rows = np.arange(90) % 3 == row.k
        a, b = x[rows, row.i], x[rows, row.j]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert row.n == both.sum()
        assert row.r is None if 4 in (row.i, row.j) else row.r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)


def test_distribution_equals_pandas(spark):
    rng = np.random.default_rng(1)
    v = [*map(float, rng.normal(size=60)), 50.0, float("inf")]
    d = prof.distribution(long_frame(spark, v), ["symbol", "feature"]).first()
    s = pd.Series(v[:-1])
    assert (d.n, d.non_finite_count, d.outlier_count) == (61, 1, 1)
    for name, want in (("std", s.std()), ("p01", s.quantile(0.01)), ("p95", s.quantile(0.95)), ("skewness", s.skew()), ("excess_kurtosis", s.kurt())):
        assert d[name] == pytest.approx(want, rel=1e-9)
    flat = prof.distribution(long_frame(spark, [2.0] * 10), ["symbol", "feature"]).first()
    assert (flat.skewness, flat.excess_kurtosis, flat.outlier_status) == (0.0, 0.0, "zero_iqr_not_assessed")
    assert prof.distribution(long_frame(spark, [2.0] * 3), ["symbol", "feature"]).first().outlier_status == "insufficient_observations"


def test_near_constant(spark):
    keys = ["symbol", "feature"]
    assert prof.near_constant(long_frame(spark, [1.0] * 99 + [2.0]), keys).first().near_constant
    assert not prof.near_constant(long_frame(spark, [1.0] * 9 + [2.0]), keys).first().near_constant
    assert prof.near_constant(long_frame(spark, [1.0, 1.0]), keys).first().near_constant


def test_pairs_equal_pandas(spark):
    bars, _ = make_bars(spark, 90)
    f = build_features(bars)
    got = prof.pairwise_correlation(f, ["symbol"], MARKET_FEATURES).toPandas()
    assert len(got) == 2 * 36
    pdf = f.toPandas()
    for s, g in pdf.groupby("symbol"):
        want = g[list(MARKET_FEATURES)].astype(float).corr(min_periods=20)
        for r in got[got.symbol == s].itertuples():
            assert r.correlation == pytest.approx(want.loc[r.feature_a, r.feature_b], abs=1e-9)


def test_exact_diff_sees_one_ulp_and_rows(spark):
    bars, _ = make_bars(spark, 20, ("A",))
    one = bars.withColumn("close", F.when(F.col("date") == dt.date(2024, 1, 3), F.col("close") * (1 + 2.3e-16)).otherwise(F.col("close")))
    d = {r["column"]: r.changed_cells for r in cmp.exact_diff(bars, one, ["symbol", "date"]).collect()}
    assert d["close"] == 1 and d["open"] == 0 and d["__rows__"] == 0
    d = {r["column"]: r.changed_cells for r in cmp.exact_diff(bars, bars.limit(15), ["symbol", "date"]).collect()}
    assert d["__rows__"] == 5
    assert cmp.exact_diff(bars, bars.drop("open"), ["symbol", "date"]).first()["column"] == "__schema__"


def test_fingerprint_ignores_order_not_content(spark):
    bars, _ = make_bars(spark, 20)
    a = cmp.fingerprint(bars, bars.columns).first()
    assert a == cmp.fingerprint(bars.orderBy(F.desc("close")).repartition(5), bars.columns).first()
    assert a.digest != cmp.fingerprint(bars.withColumn("volume", F.col("volume") + 1), bars.columns).first().digest


def test_vintage_gate(spark):
    now = spark.createDataFrame([("a", 3, 7), ("b", 3, 8), ("c", 3, 7), ("d", 3, 7), ("e", 3, 7)], "vintage string, row_count long, digest long")
    reg = spark.createDataFrame(
        [("a", True, ["x", "y"], ["t"], 3, 7), ("b", True, ["x", "y"], ["t"], 3, 7), ("c", False, ["x", "y"], ["t"], 3, 7), ("d", True, ["x"], ["t"], 3, 7)],
        "vintage string, approved boolean, features array<string>, targets array<string>, row_count long, digest long",
    )
    got = {r.vintage: r.decision for r in cmp.vintage_gate(now, reg, ("x", "y"), "t").collect()}
    assert got == {"a": "accepted", "b": "fingerprint_mismatch", "c": "not_approved", "d": "out_of_scope", "e": "unknown_vintage"}


def test_first_divergence_needs_earlier_evidence(spark):
    rows = [("k", s, layer, v, v is not None) for s, vs in (("legacy", [None, 5, 6]), ("expanded", [5, 5, 5])) for layer, v in zip("abc", vs)]
    t = spark.createDataFrame(rows, "key string, side string, layer string, value long, available boolean")
    r = cmp.first_divergence(t, ["a", "b", "c"], ["key"]).first()
    assert (r.first_observed_divergence_layer, r.missing_earlier_layers, r.cause_identified) == ("c", 1, False)
    assert r.first_divergence_layer == "NOT_IDENTIFIABLE_WITH_AVAILABLE_EVIDENCE"
    p = {x.side: x.propagation_violations for x in cmp.propagation(t, ["a", "b", "c"], ["key"]).collect()}
    assert p == {"legacy": 1, "expanded": 0}


def test_closures(spark):
    days = ["2024-03-29", "2021-04-02", "2022-06-20", "2021-07-05", "2022-12-26", "2023-01-02", "2025-01-09", "2024-11-28", "2024-07-05", "2021-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "s string").select(F.col("s").cast("date").alias("d"))
    assert [r[0] for r in df.select(aud.is_closure(F.col("d"))).collect()] == [True] * 8 + [False] * 2
    cal = spark.createDataFrame([("A", dt.date(2024, 3, 27)), ("A", dt.date(2024, 3, 30)), ("A", dt.date(2024, 4, 1))], "symbol string, date date")
    r = aud.calendar_audit(cal).first()
    assert (r.expected_sessions, r.missing_expected_sessions, r.unexpected_sessions) == (3, 1, 1)


def test_calendar_is_made_once_for_all_symbols(spark):
    """No calendar is copied to symbols: the only rows that are generated are the days between the first and the last date of all."""
    rows = [("A", dt.date(2024, 3, 27)), ("A", dt.date(2024, 3, 30)), ("A", dt.date(2024, 3, 30)), ("A", None), ("B", dt.date(2023, 12, 29)), ("B", dt.date(2024, 1, 3)), ("C", None)]
    audit = aud.calendar_audit(spark.createDataFrame(rows, "symbol string, date date"))
    got = {r[0]: tuple(r)[1:] for r in audit.collect()}
    assert got == {"A": (2, 3, 1, 2), "B": (3, 2, 1, 0), "C": (0, 1, 0, 1)}
    generated = [x for x in audit._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert generated and not any("symbol" in x for x in generated)


def test_probes(spark):
    bars, _ = make_bars(spark, 90, ("A",))
    f = aud.future_bars_probe(bars, "2024-03-28").first()
    assert f.past_cells_changed == 0 and f.future_reacts
    p = aud.prefix_probe(bars, ["2024-03-28"]).first()
    assert (p.rows_checked, p.violations) == (1, 0)
    d = aud.dependency_probe(bars, "2024-03-28", {"volume": lambda c: c * 10, "high": lambda c: c * 1.1}).toPandas()
    assert d[d.field == "volume"].changed_cells.sum() == 0
    assert set(d[(d.field == "high") & (d.changed_cells > 0)].output) == {"daily_range"}


def test_chart_arrays_must_match(spark):
    body = '{"meta": {"symbol": "A"}, "timestamp": [1735828200, 1735914600], "indicators": {"quote": [{"close": [1.0, 2.0], "volume": [10, 11]}]}}'
    good = spark.createDataFrame([(body,)], "body string")
    assert [(r.date.isoformat(), r.volume) for r in charts.chart_rows(good).orderBy("date").collect()] == [("2025-01-02", 10), ("2025-01-03", 11)]
    bad = spark.createDataFrame([(body.replace("[10, 11]", "[10]"),)], "body string")
    with pytest.raises(Exception, match="differ in length"):
        charts.chart_rows(bad).collect()


def test_assessment_rules(spark):
    rows = [("A", "m", r, -0.1, -0.1, 0.6) for r in ("zero_return", "historical_mean")] + [("B", "m", r, 0.1, -0.1, 0.6) for r in ("zero_return", "historical_mean")]
    rows += [("C", "m", r, -0.1, 0.1, 0.6) for r in ("zero_return", "historical_mean")]
    p = spark.createDataFrame(rows, "symbol string, model string, reference string, mean_delta_MAE double, median_delta_MAE double, win_rate double")
    got = {r.symbol: r.classification for r in aud.predictive_assessment(p, ("m",)).collect()}
    assert got == {"A": "ROBUST_MULTI_YEAR_SIGNAL", "B": "NO_ROBUST_MULTI_YEAR_SIGNAL", "C": "MIXED_OR_REGIME_DEPENDENT_SIGNAL"}


def test_catalog(spark):
    assert prof.classify("q_gross_margin") == "quarterly" and prof.classify("q_accession") == "metadata" and prof.classify("x") == "unclassified"
    gaps = {(r.feature, r.gap) for r in prof.catalog_gaps(spark, [*MARKET_FEATURES[1:], "mystery"]).collect()}
    assert ("simple_return", "missing_feature") in gaps and ("mystery", "unclassified_column") in gaps


def test_every_survey_row_has_a_query_or_test():
    load_all()
    have = {c for q in REGISTRY.values() for c in q.covers}
    tested_only = {"S14"}  # report writing has no result table
    sizes = {"S": 15, "P": 15, "V": 18, "J": 16, "A": 41, "W": 15, "K": 7, "U": 5, "M": 13, "C": 20}
    missing = [f"{p}{i}" for p, n in sizes.items() for i in range(1, n + 1) if f"{p}{i}" not in have | tested_only]
    assert not missing


def test_model_matrix_holds_the_declared_columns_alone(spark):
    from pitline.operators.profile import matrix_check

    window, features = ("2024-01-01", "2024-12-31"), ("a", "b")
    df = spark.sql("SELECT 'A' AS symbol, DATE '2024-01-02' + CAST(id / 2 AS INT) AS date, CAST(id AS DOUBLE) AS a, CAST('Infinity' AS DOUBLE) AS b FROM range(3)")
    r = matrix_check(df, window, features).first()
    assert (r.rows, r.duplicate_rows, r.rows_outside_window, r.infinite_cells) == (3, 1, 0, 3)
    for bad, why in ((df.drop("a"), "lacks"), (df.withColumn("x", F.lit(1)), "undeclared"), (df.select("symbol", "date", "b", "a"), "order"), (df.withColumn("a", F.lit("1")), "doubles")):
        with pytest.raises(ValueError, match=why):
            matrix_check(bad, window, features)


def test_distribution_of_wide_rows(spark):
    """Wide rows give the measures of unpivoted ones, and no row is expanded to a feature."""
    rng = np.random.default_rng(3)
    rows = [("A", float(x), None if i % 3 else float(x), 2.0, float("nan") if i < 2 else float(i)) for i, x in enumerate([*rng.normal(size=30), 40.0])] + [("B", 1.0, None, 2.0, float("inf"))]
    names = ("a", "b", "c", "d")
    wide = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double")
    want = prof.distribution(wide.unpivot(["symbol"], list(names), "feature", "value"), ["symbol", "feature"]).toPandas()
    frame = prof.wide_distribution(wide, names)
    assert "Expand" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = frame.toPandas()
    got, want = (d[sorted(want.columns)].sort_values(["symbol", "feature"]).reset_index(drop=True) for d in (got, want))
    assert sorted(frame.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    assert got.outlier_count.max() > 0


def test_distinct_states_come_from_counted_sessions(spark):
    """the pairs of `pairwise_correlation` with states, from sessions that are counted by filled cells and states first, without moments."""
    nan, inf = float("nan"), float("inf")
    rows = [("X", 1.0, 2.0, 3.0, 10, 20), ("X", 1.0, None, 3.0, 10, 20), ("X", 2.0, 5.0, nan, 11, 20), ("X", 2.0, 5.0, 4.0, 11, 21),
            ("X", inf, 5.0, 4.0, 12, 21), ("X", 3.0, 6.0, 4.0, None, 22), ("Y", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, s bigint, t bigint")
    states = {"a": "s", "b": "s", "c": "t"}
    cols = ["symbol", "feature_a", "feature_b", "pairwise_count", "distinct_states_a", "distinct_states_b"]
    got = prof.distinct_states(df, ("a", "b", "c"), states)
    want = prof.pairwise_correlation(df, ["symbol"], ("a", "b", "c"), states=states).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == cols
    assert ("X", "a", "c", 4, 2, 3) in set(map(tuple, got.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("HashAggregate")


def test_quality_flags_read_the_matrix_once(spark):
    """no kept copy, no row copied to a feature; the measures are those of the operators on long rows."""
    from pitline.config import RESEARCH_FEATURES, STREAM_FEATURES
    from pitline.plans import load_all
    from pitline.plans.registry import Tables

    load_all()
    t = Tables(spark, "/root/testdata/sf0.001")
    flags = prof.quality_flags(t.daily)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and plan.count("FlatMapGroupsInArrow") == 1 and "Expand" not in plan and "unpivot" not in plan.lower()
    daily = t.daily.persist()
    diag = prof.long_features(daily).filter(F.col("feature").isin(*prof.WARMUP)).select("symbol", "feature", "value")
    for group, p in prof.GROUP_STREAM.items():
        cols = list(STREAM_FEATURES[p])
        diag = diag.unionByName(prof.state_frame(daily, group).select("symbol", *cols).unpivot(["symbol"], cols, "feature", "value"))
    high = prof.pairwise_correlation(daily, ["symbol"], RESEARCH_FEATURES).filter("highly_correlated")
    high = {(r.symbol, f) for r in high.collect() for f in (r.feature_a, r.feature_b)}
    want = prof.distribution(diag, prof.ID).select(*prof.ID, "n", "outlier_count").join(prof.near_constant(diag, prof.ID), prof.ID)
    want = {(r.symbol, r.feature): (r.n, r.outlier_count, r.distinct_values, r.near_constant, (r.symbol, r.feature) in high) for r in want.collect()}
    got = prof.temporal_summaries(daily, diagnose=True).collect()
    for r in got:
        mine = (r.diagnostic_count, r.outlier_count, r.distinct_values, r.near_constant, r.redundant)
        assert mine == want.get((r.symbol, r.feature), (0, 0, 0, False, False)), (r.symbol, r.feature)
    daily.unpersist()
    assert len(got) == len(RESEARCH_FEATURES) * t.bars.select("symbol").distinct().count() and {r.redundant for r in got} == {True, False}
