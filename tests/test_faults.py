import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from pitline.operators import labels as lab
from pitline.operators.faults import DIGITS, EVERY, plant, planted
from test_market import make_bars


def rule(name, *key):
    text = "|".join([name, *["" if k is None else str(k) for k in key]])
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) % EVERY == 0


def test_faults_stand_where_the_hash_says(spark):
    rows = [(f"S{i % 7}" if i % 11 else None, datetime.date(2024, 1, 1) + datetime.timedelta(i), i, float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "symbol string, date date, x int, y double")
    key = ["symbol", "date"]
    got = plant(df, key, {"a": ("x", F.lit(-1)), "b": ("y", F.col("x") + 0.5)}, "gone").collect()
    want = [(s, d, -1 if rule("a", s, d) else x, x + 0.5 if rule("b", s, d) else y) for s, d, x, y in rows if not rule("gone", s, d)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert 0 < sum(r[2] == -1 for r in want) < 60 and 0 < 600 - len(want) < 60
    assert df.filter(planted("a", key, 1)).count() == 600
    for bad in ({"a": ("x", F.lit(1)), "b": ("x", F.lit(2))}, {"a": ("date", F.lit(None))}):
        with pytest.raises(ValueError, match="fault"):
            plant(df, key, bad)


def test_label_audit_counts_each_fault_once(spark):
    bars, pdf = make_bars(spark, 300)
    key = ["symbol", "date"]
    bad = plant(lab.build_labels(bars), key, {"return": ("forward_return_20d", F.col("forward_return_20d") + 0.01)})
    got = {(r.symbol, r.horizon): r for r in lab.validate_labels(bad, bars).collect()}
    for s, days in pdf.groupby("symbol").date:
        n = sum(rule("return", s, d) for d in sorted(days)[:-20])
        assert n > 0 and got[s, 20].formula_violations == n and got[s, 5].formula_violations == got[s, 20].price_violations == 0
