"""Bars, rolling features and forward labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.config import BAR_COLUMNS, HORIZONS, MARKET_FEATURES, RELATIVE_NAMES, SMA_WINDOWS, VOL_WINDOWS, WARMUP
from pitline.functions.numeric import is_close, rnd
from pitline.operators import bars as ops
from pitline.operators import labels as lab
from pitline.operators import rolling
from pitline.plans.registry import Tables, query
from pitline.plans.sql import R, cte
from pitline.session import stored_table
from pitline.sources import bars as sinks
from pitline.sources.bars import read_selected
from pitline.sources.derived import print_number


def rounded(df: DataFrame, keys: list[str], cols, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rnd(c, digits).alias(c) for c in cols])


# ---- SQL views -------------------------------------------------------------------------------------
_sma = ", ".join(
    f"CASE WHEN count(close) OVER w{k} = {k} THEN avg(close) OVER w{k} END AS sma_{k}" for k in SMA_WINDOWS
)
_vol = ", ".join(
    f"CASE WHEN count(simple_return) OVER w{k} = {k} THEN stddev_samp(simple_return) OVER w{k} END AS rolling_volatility_{k}"
    for k in VOL_WINDOWS
)
_wins = ", ".join(
    f"w{k} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (5, 20, 60)
)
cte(
    "features",
    f"""
SELECT symbol, date, open, high, low, close, volume, simple_return, log_return, intraday_return, daily_range, {_sma}, {_vol}
FROM (SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return,
        close / open - 1 AS intraday_return, (high - low) / close AS daily_range
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
WINDOW {_wins}""",
)
cte("positions", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM bars")
_lab = ", ".join(
    f"x{h}.date AS target_exit_date_{h}d, x{h}.close AS target_exit_close_{h}d, x{h}.close / e.open - 1 AS forward_return_{h}d"
    for h in HORIZONS
)
_labj = " ".join(f"LEFT JOIN positions x{h} ON x{h}.symbol = p.symbol AND x{h}.pos = p.pos + {h}" for h in HORIZONS)
cte(
    "labels_v",
    f"""
SELECT p.symbol, p.date, p.pos, e.date AS target_entry_date, e.open AS target_entry_open, {_lab}
FROM positions p LEFT JOIN positions e ON e.symbol = p.symbol AND e.pos = p.pos + 1 {_labj}""",
)
PCT = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


# ---- ingest and bars -------------------------------------------------------------------------------
@query("derived_bars", "S1", "SELECT symbol, date, open, high, low, close, volume FROM bars")
def _(t: Tables):
    return t.bars


def vendor_rows(t: Tables) -> DataFrame:
    """Every order line as one vendor text row under a two-level header flattened to plain names."""
    header = ops.flatten_header([(c, "ANY") for c in ("Date", "Open", "High", "Low", "Close", "Volume")])
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    cells = {
        "Date": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "Open": F.when(F.col("l_linenumber") == 7, "n/a").otherwise(price),
        "High": price,
        "Low": price,
        "Close": price,
        "Volume": F.col("l_quantity").cast("string"),
    }
    seq = print_number().alias("_arrival")
    return t.lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), *[cells[h].alias(h) for h in header], seq
    )


_last_print = "ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC"


@query(
    "standardised_bars",
    "S3 S4",
    f"""
SELECT symbol, date, price AS open, price AS high, price AS low, price AS close, l_quantity AS volume
FROM (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity,
        row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) {_last_print}) AS rn
      FROM lineitem WHERE l_linenumber <> 7)
WHERE rn = 1""",
)
def _(t: Tables):
    return ops.standardise_bars(vendor_rows(t), F.col("_arrival"))


@query(
    "bounded_print_read",
    "S9",
    """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_quantity, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'""",
)
def _(t: Tables):
    df = read_selected(
        t.spark,
        f"{t.dir}/lineitem.parquet",
        ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"],
        start=F.to_timestamp_ntz(F.lit("1996-01-01")),
        end=F.to_timestamp_ntz(F.lit("2000-01-01")),
        on="l_shipdate",
    )
    return df.select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice")


@query("observed_sessions", "S11 U5", "SELECT DISTINCT symbol, date FROM bars")
def _(t: Tables):
    prints = t.lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date")
    )
    return ops.sessions(prints)


@query(
    "bar_validation",
    "V1 V4 V13",
    """
SELECT symbol, count(*) AS rows, 0::BIGINT AS duplicate_dates, count_if(date IS NULL)::BIGINT AS missing_dates,
  count_if(NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close))::BIGINT AS nonfinite,
  count_if(least(open, high, low, close) <= 0)::BIGINT AS nonpositive, count_if(volume < 0)::BIGINT AS negative_volume,
  count_if(volume <> floor(volume))::BIGINT AS non_integral_volume
FROM bars GROUP BY symbol""",
)
def _(t: Tables):
    return ops.bar_violations(t.bars)


@query(
    "history_profile",
    "A1 S15",
    """
SELECT symbol, count(*) AS row_count, (count(*) - count(DISTINCT date))::BIGINT AS duplicate_dates,
  min(date) AS start_date, max(date) AS end_date,
  count_if(price IS NULL)::BIGINT AS null_open, count_if(price IS NULL)::BIGINT AS null_high,
  count_if(price IS NULL)::BIGINT AS null_low, count_if(price IS NULL)::BIGINT AS null_close,
  count_if(l_quantity IS NULL)::BIGINT AS null_volume
FROM (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity
      FROM lineitem) GROUP BY symbol""",
)
def _(t: Tables):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    raw = t.lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        *[price.alias(c) for c in BAR_COLUMNS[1:5]],
        F.col("l_quantity").alias("volume"),
    )
    return ops.history_profile(raw)


@query(
    "arrival_order",
    "A1",
    """
WITH raw AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS seq FROM lineitem),
days AS (SELECT symbol, date, count(*) AS n, min(seq) AS first, max(seq) AS last FROM raw GROUP BY symbol, date),
late AS (SELECT a.symbol, a.date, any_value(a.n) AS n, coalesce(bool_or(b.last > a.first), false) AS late
         FROM days a LEFT JOIN days b ON a.symbol = b.symbol AND b.date < a.date GROUP BY a.symbol, a.date)
SELECT symbol, sum(n)::BIGINT AS row_count, count_if(late)::BIGINT AS days_arriving_late,
       count_if(late) = 0 AS date_monotonic_increasing FROM late GROUP BY symbol""",
)
def _(t: Tables):
    raw = t.lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey"
    )
    return ops.arrival_order_profile(raw, F.col("l_orderkey"))


@query(
    "ohlc_bounds",
    "V12",
    """
SELECT symbol, count_if(low > high OR low > open OR low > close OR high < open OR high < close)::BIGINT AS bound_violations,
  count_if(ratio < 0.5 OR ratio > 2)::BIGINT AS discontinuities
FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS ratio FROM bars) GROUP BY symbol""",
)
def _(t: Tables):
    return ops.ohlc_bounds(t.bars)


# ---- rolling features ------------------------------------------------------------------------------
@query(
    "rolling_features",
    "W1 W2 W3 W4 S8",
    f"SELECT symbol, date, close, volume, {', '.join(f'{R(c)} AS {c}' for c in MARKET_FEATURES)} FROM features",
)
def _(t: Tables):
    return rounded(t.features, ["symbol", "date", "close", "volume"], MARKET_FEATURES)


@query(
    "relative_features",
    "P8 P9",
    f"SELECT symbol, date, {', '.join(R(f'close / {c} - 1' if c in RELATIVE_NAMES else c) + ' AS ' + RELATIVE_NAMES.get(c, c) for c in MARKET_FEATURES)} FROM features",
)
def _(t: Tables):
    rel = rolling.representation(t.features, "treatment")
    return rounded(rel, ["symbol", "date"], rel.columns[2:])


@query(
    "relative_feature_guard",
    "P8",
    f"SELECT symbol, count_if(close IS NULL OR close <= 0)::BIGINT AS nonpositive_close, {', '.join(f'count_if({c} <= 0)::BIGINT AS nonpositive_{c}' for c in RELATIVE_NAMES)} FROM features GROUP BY symbol",
)
def _(t: Tables):
    return rolling.representation_violations(t.features)


_fq = " UNION ALL ".join(
    f"""SELECT symbol, '{c}' AS feature, count_if(pos < {k})::BIGINT AS expected_warmup_null, count_if({c} IS NULL)::BIGINT AS actual_null,
    count_if({c} IS NULL AND pos >= {k})::BIGINT AS unexpected_null, count_if({c} IS NOT NULL AND pos < {k})::BIGINT AS missing_warmup_null,
    count_if(isinf({c}))::BIGINT AS infinite_values FROM fp GROUP BY symbol"""
    for c, k in WARMUP.items()
)


@query(
    "feature_quality",
    "V2",
    "SELECT * FROM (WITH fp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM features) " + _fq + ")",
)
def _(t: Tables):
    return rolling.feature_quality(t.features)


@query(
    "rolling_feature_rebuild",
    "C17",
    f"""
SELECT symbol, count(*) AS sessions_checked, {', '.join(f'0::BIGINT AS {c}_violations' for c in MARKET_FEATURES)}
FROM bars GROUP BY symbol""",
)
def _(t: Tables):
    want = rolling.oracle_features(t.bars).select("symbol", "date", *[F.col(c).alias(f"w_{c}") for c in MARKET_FEATURES])
    j = t.features.join(want, ["symbol", "date"], "full_outer")
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions_checked"),
        *[F.count_if(~is_close(c, f"w_{c}", rtol=1e-9, atol=1e-9)).alias(f"{c}_violations") for c in MARKET_FEATURES],
    )


# ---- labels ----------------------------------------------------------------------------------------
_lcols = ["target_entry_date", "target_entry_open", *[f"target_exit_{x}_{h}d" for h in HORIZONS for x in ("date", "close")]]


@query(
    "forward_labels",
    "W5",
    f"SELECT symbol, date, {', '.join(_lcols)}, {', '.join(R(f'forward_return_{h}d') + f' AS forward_return_{h}d' for h in HORIZONS)} FROM labels_v",
)
def _(t: Tables):
    return rounded(lab.build_labels(t.bars), ["symbol", "date", *_lcols], [f"forward_return_{h}d" for h in HORIZONS])


_lv = " UNION ALL ".join(
    f"""SELECT symbol, {h}::INTEGER AS horizon, count(*) AS rows_checked, 0::BIGINT AS position_violations, 0::BIGINT AS price_violations,
    0::BIGINT AS formula_violations, least({h}, count(*))::BIGINT AS tail_nulls FROM bars GROUP BY symbol"""
    for h in HORIZONS
)


@query("label_validation", "V7 C13 V8", f"SELECT * FROM ({_lv})")
def _(t: Tables):
    return lab.validate_labels(lab.build_labels(t.bars), t.bars)


@query(
    "price_contract",
    "V8",
    "SELECT symbol, count_if(NOT isfinite(open) OR NOT isfinite(close) OR open <= 0 OR close <= 0)::BIGINT AS invalid_price_rows FROM bars GROUP BY symbol",
)
def _(t: Tables):
    return lab.price_contract(t.bars)


def stat_sql(c: str, digits: int = 6) -> str:
    pct = ", ".join(f"{R(f'quantile_cont({c}, {p})', digits)} AS {n}" for n, p in PCT.items())
    return (
        f"{R(f'avg({c})', digits)} AS mean, {R(f'stddev_samp({c})', digits)} AS std, {R(f'min({c})', digits)} AS min, "
        f"{pct}, {R(f'max({c})', digits)} AS max"
    )


_ls = " UNION ALL ".join(
    f"""SELECT symbol, 'forward_return_{h}d' AS target_name, {h}::INTEGER AS horizon, {str(h == 5).lower()} AS primary_target,
    count(forward_return_{h}d) AS n, count_if(forward_return_{h}d IS NULL)::BIGINT AS missing, {stat_sql(f'forward_return_{h}d')}
    FROM labels_v GROUP BY symbol"""
    for h in HORIZONS
)


@query("label_summary", "A15", f"SELECT * FROM ({_ls})")
def _(t: Tables):
    s = lab.label_summary(lab.build_labels(t.bars))
    return rounded(s, ["symbol", "target_name", "horizon", "primary_target", "n", "missing"], s.columns[6:])


# ---- stored tables ---------------------------------------------------------------------------------
@query("stored_history", "S2 S9", "SELECT symbol, date, close, volume FROM bars WHERE date >= DATE '1995-06-01' AND date < DATE '1997-03-01'")
def _(t: Tables):
    path = stored_table(t.spark, "history")
    sinks.write_history(t.bars, path)
    return read_selected(t.spark, path, ["symbol", "date", "close", "volume"], start=dt.date(1995, 6, 1), end=dt.date(1997, 3, 1))


@query("stored_features", "S6 S7 S8", f"SELECT symbol, date, {', '.join(f'{R(c)} AS {c}' for c in MARKET_FEATURES)} FROM features")
def _(t: Tables):
    path = stored_table(t.spark, "features")
    sinks.process_pool(t.bars, path)
    return rounded(sinks.read_features(t.spark, path), ["symbol", "date"], MARKET_FEATURES)


@query("stored_report", "S14 S15", "SELECT symbol, count(*) AS rows, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date, max(high) AS highest FROM bars GROUP BY symbol")
def _(t: Tables):
    path = stored_table(t.spark, "report")
    summary = t.bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("high").alias("highest"))
    sinks.write_report(summary, path)
    return t.spark.read.schema("symbol string, rows bigint, first_date string, last_date string, highest double").json(path)


@query(
    "filing_date_read",
    "S10",
    "SELECT symbol, accession, form, filing_date, revenue FROM filings WHERE filing_date >= DATE '1996-01-01' AND filing_date < DATE '1998-01-01'",
)
def _(t: Tables):
    path = stored_table(t.spark, "filings")
    sinks.write_filings(t.filings, path)
    return read_selected(
        t.spark, path, ["symbol", "accession", "form", "filing_date", "revenue"], start=dt.date(1996, 1, 1), end=dt.date(1998, 1, 1), on="filing_date"
    )
