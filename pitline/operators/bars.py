"""Bar standardisation, validation and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import BAR_COLUMNS, PRICE_COLUMNS
from pitline.functions.numeric import is_integral_count
from pitline.functions.text import snake
from pitline.functions.windows import by_session

OHLCV = {"open", "high", "low", "close", "volume"}


def flatten_header(names: list[tuple[str, ...]]) -> list[str]:
    """Plain names for a multi-level header: the level that carries OHLCV, else the parts joined."""
    for level in range(len(names[0])):
        if OHLCV <= {snake(n[level]) for n in names}:
            return [n[level] for n in names]
    return ["_".join(p for p in n if p) for n in names]


def standardise_bars(raw: DataFrame, order_by: Column, symbol: str = "symbol") -> DataFrame:
    """Vendor rows to clean bars: names, types, complete rows, last row per day by an explicit order.

    The last row is taken with max_by, which combines before the shuffle, so a day repeated many
    times never gathers in one task. Each column is taken by itself: with an order of fixed width (see ``packed_key``) that is a hash
    aggregate, and all columns see the same rows in the same order, so they come from one row also where orders tie.
    """
    renamed = raw.select(*[F.col(f"`{c}`").alias(snake(c)) for c in raw.columns], order_by.alias("_seq"))
    names = set(renamed.columns)
    for old in ("datetime", "index"):
        if "date" not in names and old in names:
            renamed, names = renamed.withColumnRenamed(old, "date"), {*names, "date"}
    missing = set(BAR_COLUMNS) - names
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    typed = renamed.select(
        symbol,
        F.col("date").try_cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in BAR_COLUMNS[1:]],
        "_seq",
    ).replace(float("nan"), None, subset=list(BAR_COLUMNS[1:]))
    clean = typed.na.drop(subset=[symbol, *BAR_COLUMNS])
    return clean.groupBy(symbol, "date").agg(*[F.max_by(c, "_seq").alias(c) for c in BAR_COLUMNS[1:]])


def bar_violations(bars: DataFrame) -> DataFrame:
    """One row per symbol of counts that must all be zero."""
    num = [F.col(c) for c in BAR_COLUMNS[1:]]

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == float("inf"))

    nonfinite = bad(num[0])
    for c in num[1:]:
        nonfinite = nonfinite | bad(c)
    nonpositive = F.least(*[F.col(c) for c in PRICE_COLUMNS]) <= 0
    per_day = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(nonfinite).alias("nonfinite"),
        F.count_if(nonpositive).alias("nonpositive"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(~is_integral_count("volume")).alias("non_integral_volume"),
    )
    return per_day.groupBy("symbol").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicate_dates"),
        F.count_if(F.col("date").isNull()).alias("missing_dates"),
        *[F.sum(c).alias(c) for c in ("nonfinite", "nonpositive", "negative_volume", "non_integral_volume")],
    )


def require_valid_bars(bars: DataFrame) -> DataFrame:
    """The bars unchanged; the job fails on the first symbol with a violation."""
    v = bar_violations(bars)
    total = sum((F.col(c) for c in v.columns if c not in ("symbol", "rows")), F.lit(0))
    ok = v.select("symbol", F.when(total > 0, F.raise_error(F.concat(F.lit("invalid bars: "), "symbol"))).otherwise(F.lit(True)).alias("_ok"))
    return bars.join(ok, "symbol").filter("_ok").drop("_ok")


def history_profile(bars: DataFrame) -> DataFrame:
    """Rows, missing cells, duplicate dates and date range per symbol (counts only, map-side combined)."""
    per_day = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in BAR_COLUMNS[1:]]
    )
    return per_day.groupBy("symbol").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.col("n") - 1).alias("duplicate_dates"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in BAR_COLUMNS[1:]],
    )


def arrival_order_profile(rows: DataFrame, sequence: Column) -> DataFrame:
    """Whether each symbol's dates arrive in ascending order.

    Rows first shrink to the first and last arrival of every day; only those day summaries meet in a
    window, so a symbol with very many rows stays spread out.
    """
    days = rows.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), F.min(sequence).alias("first"), F.max(sequence).alias("last")
    )
    earlier = F.max("last").over(by_session().rowsBetween(W.unboundedPreceding, -1))
    late = F.coalesce(earlier > F.col("first"), F.lit(False))
    return (
        days.withColumn("_late", late)
        .groupBy("symbol")
        .agg(
            F.sum("n").alias("row_count"),
            F.count_if("_late").alias("days_arriving_late"),
            (F.count_if("_late") == 0).alias("date_monotonic_increasing"),
        )
    )


def ohlc_bounds(bars: DataFrame) -> DataFrame:
    """Per symbol: bars outside low <= open,close <= high, and close-to-close ratios outside [0.5, 2]."""
    ratio = F.col("close") / F.lag("close").over(by_session())
    outside = (
        (F.col("low") > F.col("high"))
        | (F.col("low") > F.least("open", "close"))
        | (F.col("high") < F.greatest("open", "close"))
    )
    return (
        bars.withColumn("_ratio", ratio)
        .groupBy("symbol")
        .agg(
            F.count_if(outside).alias("bound_violations"),
            F.count_if(F.col("_ratio").isNotNull() & ~F.col("_ratio").between(0.5, 2.0)).alias("discontinuities"),
        )
    )


def sessions(bars: DataFrame) -> DataFrame:
    """Distinct observed sessions per symbol; never a guessed calendar."""
    return bars.select("symbol", "date").distinct()
