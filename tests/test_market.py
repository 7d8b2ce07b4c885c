import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitline.config import HORIZONS, MARKET_FEATURES, SplitConfig
from pitline.functions.dates import date_columns, strict_date
from pitline.functions.numeric import finite, is_close, is_integral_count, sdiv
from pitline.operators import bars as ops
from pitline.operators import labels as lab
from pitline.functions.keys import packed_key
from pitline.operators.profile import coverage_label
from pitline.operators.rolling import build_features, feature_quality, oracle_features, representation
from pitline.sources import bars as src


def make_bars(spark, n=75, symbols=("AAA", "BBB"), seed=3):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2024-01-02", periods=n)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.005, n))
        parts.append(
            pd.DataFrame({"symbol": s, "date": days.date, "open": open_, "high": np.maximum(open_, close) * 1.01,
                          "low": np.minimum(open_, close) * 0.99, "close": close, "volume": rng.integers(1, 1000, n)})
        )
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def test_features_equal_pandas(spark):
    bars, pdf = make_bars(spark)
    got = build_features(bars.repartition(3, "date")).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for s, g in pdf.groupby("symbol"):
        mine = got[got.symbol == s].reset_index(drop=True)
        c = g.close.reset_index(drop=True)
        ret = c.pct_change()
        want = {
            "simple_return": ret, "log_return": np.log(c / c.shift()), "intraday_return": c / g.open.reset_index(drop=True) - 1,
            **{f"sma_{k}": c.rolling(k).mean() for k in (5, 20, 60)}, **{f"rolling_volatility_{k}": ret.rolling(k).std() for k in (20, 60)},
        }
        for name, w in want.items():
            np.testing.assert_allclose(mine[name], w, rtol=1e-9, atol=1e-12)
    q = feature_quality(build_features(bars)).toPandas()
    assert (q.unexpected_null + q.missing_warmup_null + q.infinite_values).sum() == 0
    assert q[(q.feature == "rolling_volatility_60")].expected_warmup_null.tolist() == [60, 60]


def test_second_formulation_agrees(spark):
    bars, _ = make_bars(spark)
    a = build_features(bars).select("symbol", "date", *MARKET_FEATURES)
    b = oracle_features(bars).select("symbol", "date", *[F.col(c).alias(f"o_{c}") for c in MARKET_FEATURES])
    j = a.join(b, ["symbol", "date"])
    bad = j.agg(*[F.count_if(~is_close(c, f"o_{c}", atol=1e-9)).alias(c) for c in MARKET_FEATURES]).first()
    assert sum(bad) == 0 and j.count() == 150


def test_standardise_last_row_wins_and_bad_rows_drop(spark):
    rows = [
        ("A", "2024-01-03", "2", "3", "1", "2", "10", 1),
        ("A", "2024-01-02", "1", "3", "1", "2", "10", 2),
        ("A", "2024-01-02", "9", "9", "9", "9", "20", 3),
        ("A", "2024-01-04", "n/a", "3", "1", "2", "10", 4),
    ]
    raw = spark.createDataFrame(rows, ["symbol", "Date", "Open", "High", "Low", "Close", "Volume", "n"])
    got = ops.standardise_bars(raw, F.col("n")).orderBy("date").collect()
    assert [(r.date.isoformat(), r.open, r.volume) for r in got] == [("2024-01-02", 9.0, 20.0), ("2024-01-03", 2.0, 10.0)]
    with pytest.raises(ValueError, match="missing required columns"):
        ops.standardise_bars(raw.drop("Open"), F.col("n"))


def test_header_levels():
    two = [("Open", "X"), ("High", "X"), ("Low", "X"), ("Close", "X"), ("Volume", "X")]
    assert ops.flatten_header(two) == ["Open", "High", "Low", "Close", "Volume"]
    assert ops.flatten_header([("a", "b"), ("c", "")]) == ["a_b", "c"]


def test_invalid_bars_are_counted_and_rejected(spark):
    bars, _ = make_bars(spark, 10, ("A",))
    bad = bars.withColumn("open", F.when(F.col("date") == dt.date(2024, 1, 3), -1.0).otherwise(F.col("open"))).union(bars.limit(1))
    v = ops.bar_violations(bad).first()
    assert (v.nonpositive, v.duplicate_dates) == (1, 1)
    with pytest.raises(Exception, match="invalid bars"):
        ops.require_valid_bars(bad).count()
    assert ops.require_valid_bars(bars).count() == 10


def test_labels_positions_and_tail(spark):
    bars, pdf = make_bars(spark, 30, ("A",))
    pdf = pdf.sort_values("date").reset_index(drop=True)
    got = lab.build_labels(bars).toPandas().sort_values("date").reset_index(drop=True)
    for h in HORIZONS:
        for i in range(30):
            r = got.loc[i, f"forward_return_{h}d"]
            if i + h >= 30:
                assert pd.isna(r) and got.loc[i, f"target_exit_date_{h}d"] is None
            else:
                assert math.isclose(r, pdf.close[i + h] / pdf.open[i + 1] - 1, abs_tol=1e-12)
    v = lab.validate_labels(lab.build_labels(bars), bars).toPandas()
    assert v[["position_violations", "price_violations", "formula_violations"]].to_numpy().sum() == 0
    moved = lab.build_labels(bars).withColumn("target_entry_open", F.col("target_entry_open") + 1e-9)
    assert lab.validate_labels(moved, bars).agg(F.sum("price_violations")).first()[0] > 0


def test_append_equals_build(spark):
    bars, _ = make_bars(spark, 40)
    a = lab.append_labels(build_features(bars)).select("symbol", "date", *lab.label_columns())
    assert a.exceptAll(lab.build_labels(bars)).count() == 0


def test_representation_has_nine_columns(spark):
    bars, _ = make_bars(spark, 70, ("A",))
    r = representation(build_features(bars), "treatment")
    assert r.columns[2:] == ["simple_return", "log_return", "intraday_return", "daily_range", "close_to_sma_5", "close_to_sma_20",
                             "close_to_sma_60", "rolling_volatility_20", "rolling_volatility_60"]
    with pytest.raises(ValueError):
        representation(build_features(bars), "other")


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (3.0, 2.0), (1e308, 1e-308), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(sdiv("a", "b")).collect()]
    assert got == [None, None, 1.5, None, None, None]
    assert [r[0] for r in df.select(sdiv("a", "b", growth=True)).collect()][2] == 0.5
    assert [r[0] for r in df.select(finite("a").isNull()).collect()] == [False, False, False, False, True, True]
    t = spark.createDataFrame([("2024-02-29",), ("20240229",), ("2023-02-29",), ("2024-1-3",), ("2024-01-03T00",)], "s string")
    assert [r[0] for r in t.select(strict_date("s")).collect()] == [dt.date(2024, 2, 29)] * 2 + [None] * 3
    c = spark.createDataFrame([(1.0,), (1.5,), (-1.0,), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in c.select(is_integral_count("v")).collect()] == [True, False, False, False, False]
    assert date_columns(["date", "q_filing_date", "q_days_since_filing", "close"]) == ["date", "q_filing_date"]


def test_config_guards():
    with pytest.raises(ValueError):
        coverage_label(F.lit(0.5), sparse=0.99)
    for bad in ({"embargo": 1}, {"folds": 2.5}, {"min_train": 0}):
        with pytest.raises(ValueError):
            SplitConfig(**bad)


def test_files_round_trip(spark, tmp_path):
    bars, _ = make_bars(spark, 70)
    src.write_history(bars, str(tmp_path / "h"))
    back = src.read_selected(spark, str(tmp_path / "h"), ["symbol", "date", "close"], start=dt.date(2024, 2, 1), end=dt.date(2024, 3, 1))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "volume" not in plan.split("ReadSchema")[1]
    src.process_pool(bars, str(tmp_path / "f"))
    assert src.read_features(spark, str(tmp_path / "f")).count() == 140
    src.write_history_by_symbol(bars, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 140
    rep = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, k string")
    src.write_report(rep, str(tmp_path / "r"))
    assert {(r.k, r.x) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("a", 1.0), ("b", None)}


def test_vendor_csv(spark, tmp_path):
    (tmp_path / "abc.csv").write_text(
        "Date,Open,High,Low,Close,Volume,Adj Close\n2024-01-03,2,3,1,2,10,2\n2024-01-02,1,3,1,2,10,2\n2024-01-02,1.5,3,1,2,11,2\n"
    )
    got = src.read_history(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.symbol, r.date.isoformat(), r.open) for r in got] == [("ABC", "2024-01-02", 1.5), ("ABC", "2024-01-03", 2.0)]


def test_packed_keys_order_as_their_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), int(c), i) for i, (a, b, c) in enumerate(zip(rng.integers(0, 5, 300) * 10**12, rng.integers(0, 100, 300), rng.integers(0, 10**11, 300)))]
    df = spark.createDataFrame([*rows, (0, 0, 0, 300), (99_999_999_999_999, 99, 99_999_999_999, 301)], "a long, b long, c long, i long")
    for parts in ([("a", 14), ("b", 2)], [("a", 14), ("b", 2), ("c", 11)], [("b", 2)]):
        key = packed_key([(F.col(c), w) for c, w in parts])
        got = [r.i for r in df.orderBy(key, "i").select("i").collect()]
        assert got == [r.i for r in df.orderBy(*[c for c, _ in parts], "i").select("i").collect()]
        plan = df.groupBy("b").agg(F.max_by("a", key).alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
    for bad in ("-1", "100", "CAST(NULL AS BIGINT)"):
        with pytest.raises(Exception, match="not a part of 2 digits"):
            spark.range(1).select(packed_key([(F.expr(bad), 2)])).collect()
    with pytest.raises(ValueError):
        packed_key([(F.col("a"), 30), (F.col("b"), 9)])


def test_checked_write_publishes_only_what_holds(spark, tmp_path):
    bars, _ = make_bars(spark, 70)
    features, path = build_features(bars), str(tmp_path / "f")
    assert src.write_features(features, path) == {"rows": 140, "unexpected_null": 0, "missing_warmup_null": 0, "infinite_values": 0}
    faults = {
        "unexpected_null": F.when(F.col("date") == dt.date(2024, 3, 1), None).otherwise(F.col("daily_range")),
        "infinite_values": F.when(F.col("date") == dt.date(2024, 3, 1), float("inf")).otherwise(F.col("daily_range")),
    }
    for name, cell in faults.items():
        with pytest.raises(ValueError, match=f"'{name}': 2"):
            src.write_features(features.withColumn("daily_range", cell), path)
        assert src.read_features(spark, path).filter("daily_range = double('infinity') OR daily_range IS NULL").count() == 0  # the old table stays
    with pytest.raises(ValueError, match="missing_warmup_null"):
        src.write_features(features.withColumn("sma_60", F.lit(1.0)), path)
    assert [p.name for p in tmp_path.iterdir()] == ["f"]  # nothing staged is left


def test_filing_date_read_skips_files(spark, tmp_path):
    """Bounds on the filing date reach the scan, and each file covers its own range of dates."""
    rows = [(f"S{i % 7}", f"a{i}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 900), float(i)) for i in range(3_000)]
    filings = spark.createDataFrame(rows, "symbol string, accession string, filing_date date, revenue double")
    path, merge = str(tmp_path / "filings"), "spark.sql.adaptive.coalescePartitions.enabled"  # tables this small would become one file
    spark.conf.set(merge, "false")
    src.write_filings(filings, path)
    spark.conf.set(merge, "true")
    back = src.read_selected(spark, path, ["accession", "filing_date"], start=dt.date(2020, 2, 1), end=dt.date(2020, 3, 1), on="filing_date")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(filing_date" in plan and "LessThan(filing_date" in plan and "revenue" not in plan.split("ReadSchema")[1]
    assert back.count() == sum(dt.date(2020, 2, 1) <= r[2] < dt.date(2020, 3, 1) for r in rows)
    ranges = [(s.min, s.max) for f in (tmp_path / "filings").glob("part-*") for s in [pq.ParquetFile(f).metadata.row_group(0).column(2).statistics]]
    inside = [r for r in ranges if r[0] < dt.date(2020, 3, 1) and r[1] >= dt.date(2020, 2, 1)]
    assert len(ranges) > 1 and len(inside) < len(ranges)
    with pytest.raises(ValueError, match="without_date"):
        src.write_filings(filings.withColumn("filing_date", F.when(F.col("symbol") != "S1", F.col("filing_date"))), path)
