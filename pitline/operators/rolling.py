"""Causal market features: one window specification, one sort per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.config import BAR_COLUMNS, MARKET_FEATURES, RELATIVE_NAMES, SMA_WINDOWS, VOL_WINDOWS, WARMUP
from pitline.functions.windows import by_session, ordinal, trailing


def build_features(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nine trailing features per symbol and session; warm-up rows stay NULL. Columns `keep` come along."""
    w = by_session()
    prev = F.lag("close").over(w)
    out = bars.select("symbol", *BAR_COLUMNS, *keep).withColumns(
        {
            "simple_return": F.col("close") / prev - 1,
            "log_return": F.log(F.col("close") / prev),
            "intraday_return": F.col("close") / F.col("open") - 1,
            "daily_range": (F.col("high") - F.col("low")) / F.col("close"),
        }
    )

    def full(agg, c: str, k: int):
        return F.when(F.count(c).over(trailing(k)) == k, agg(c).over(trailing(k)))

    return out.withColumns(
        {
            **{f"sma_{k}": full(F.avg, "close", k) for k in SMA_WINDOWS},
            **{f"rolling_volatility_{k}": full(F.stddev_samp, "simple_return", k) for k in VOL_WINDOWS},
        }
    ).select("symbol", *BAR_COLUMNS, *MARKET_FEATURES, *keep)


def with_relative(df: DataFrame) -> DataFrame:
    """Add close/sma - 1 beside every moving average."""
    return df.withColumns({new: F.col("close") / F.col(old) - 1 for old, new in RELATIVE_NAMES.items()})


def representation(df: DataFrame, arm: str, keep: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Exactly nine predictors: the market features, or their close-relative form."""
    if arm not in ("control", "treatment"):
        raise ValueError(f"unknown arm {arm}")
    if arm == "control":
        return df.select(*keep, *MARKET_FEATURES)
    return with_relative(df).select(*keep, *[RELATIVE_NAMES.get(c, c) for c in MARKET_FEATURES])


def representation_violations(df: DataFrame) -> DataFrame:
    """Counts that must be zero before the relative form is meaningful."""
    sma = [F.count_if(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in RELATIVE_NAMES]
    return df.groupBy("symbol").agg(F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("nonpositive_close"), *sma)


def feature_quality(features: DataFrame) -> DataFrame:
    """Per symbol and feature: warm-up NULLs expected and found, NULLs elsewhere, infinite cells."""
    pos = features.withColumn("_pos", ordinal())
    structs = []
    for name, k in WARMUP.items():
        c = F.col(name)
        structs.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(F.col("_pos") < k).alias("expected_warmup_null"),
                F.count_if(c.isNull()).alias("actual_null"),
                F.count_if(c.isNull() & (F.col("_pos") >= k)).alias("unexpected_null"),
                F.count_if(c.isNotNull() & (F.col("_pos") < k)).alias("missing_warmup_null"),
                F.count_if(F.abs(c) == float("inf")).alias("infinite_values"),
            )
        )
    return pos.groupBy("symbol").agg(F.array(*structs).alias("r")).select("symbol", F.inline("r"))


def oracle_features(bars: DataFrame) -> DataFrame:
    """The same nine features from position self-joins instead of window frames.

    Each session is replicated to the sixty positions that look back on it: a fixed fan-out.
    """
    p = bars.select("symbol", "date", "open", "high", "low", "close").withColumn("pos", ordinal())
    reach = max(VOL_WINDOWS)
    prev = p.select("symbol", (F.col("pos") + 1).alias("pos"), F.col("close").alias("prev_close"))
    r = p.join(prev, ["symbol", "pos"], "left").withColumn("ret", F.col("close") / F.col("prev_close") - 1)
    seen = r.select("symbol", F.col("pos").alias("src"), F.col("close").alias("c"), "ret").select(
        "symbol", "src", "c", "ret", F.explode(F.sequence("src", F.col("src") + reach - 1)).alias("pos")
    )
    lagged = F.col("pos") - F.col("src")
    aggs = [
        F.when(F.count(F.when(lagged < k, F.col("c"))) == k, F.avg(F.when(lagged < k, F.col("c")))).alias(f"sma_{k}")
        for k in SMA_WINDOWS
    ] + [
        F.when(F.count(F.when(lagged < k, F.col("ret"))) == k, F.stddev_samp(F.when(lagged < k, F.col("ret")))).alias(
            f"rolling_volatility_{k}"
        )
        for k in VOL_WINDOWS
    ]
    rolled = seen.groupBy("symbol", "pos").agg(*aggs)
    return (
        r.join(rolled, ["symbol", "pos"])
        .withColumns(
            {
                "simple_return": F.col("ret"),
                "log_return": F.log(F.col("close") / F.col("prev_close")),
                "intraday_return": F.col("close") / F.col("open") - 1,
                "daily_range": (F.col("high") - F.col("low")) / F.col("close"),
            }
        )
        .select("symbol", "date", *MARKET_FEATURES)
    )
