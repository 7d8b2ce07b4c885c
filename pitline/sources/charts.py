"""Vendor chart documents: parallel arrays of bars and a map of corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.functions.dates import new_york_date
from pitline.functions.numeric import is_integral_count

_NUM = T.ArrayType(T.DoubleType())
_EVENT = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("amount", "numerator", "denominator")] + [T.StructField("date", T.LongType())]
)
CHART = T.StructType(
    [
        T.StructField("meta", T.StructType([T.StructField("symbol", T.StringType())])),
        T.StructField("timestamp", T.ArrayType(T.LongType())),
        T.StructField(
            "indicators",
            T.StructType(
                [
                    T.StructField(
                        "quote",
                        T.ArrayType(T.StructType([T.StructField(c, _NUM) for c in ("open", "high", "low", "close", "volume")])),
                    )
                ]
            ),
        ),
        T.StructField("events", T.MapType(T.StringType(), T.MapType(T.StringType(), _EVENT))),
    ]
)


def parse_charts(docs: DataFrame, body: str = "body") -> DataFrame:
    window = [c for c in ("year",) if c in docs.columns]
    return docs.select(*window, F.from_json(body, CHART).alias("c")).select(*window, "c.*").withColumn("symbol", F.col("meta.symbol"))


def chart_rows(docs: DataFrame) -> DataFrame:
    """One row per bar. Unequal array lengths fail the job; bad volumes are flagged."""
    c = parse_charts(docs)
    q = F.col("indicators.quote")[0]
    same = (F.size(q["volume"]) == F.size("timestamp")) & (F.size(q["close"]) == F.size("timestamp"))
    checked = F.when(same, F.arrays_zip(F.col("timestamp").alias("epoch"), q["close"].alias("close"), q["volume"].alias("volume")))
    rows = c.select("symbol", F.explode(F.coalesce(checked, F.raise_error(F.lit("chart arrays differ in length")).cast(
        "array<struct<epoch:bigint,close:double,volume:double>>"))).alias("b"))
    return rows.select(
        "symbol",
        F.col("b.epoch").alias("epoch"),
        new_york_date("b.epoch").alias("date"),
        F.col("b.close").alias("close"),
        F.when(is_integral_count("b.volume"), F.col("b.volume").cast("bigint")).alias("volume"),
        is_integral_count("b.volume").alias("volume_legal"),
    )


def chart_session_counts(rows: DataFrame) -> DataFrame:
    """Bars per session; more than one makes the session ambiguous."""
    return rows.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("bars"), F.max("volume").alias("volume"), (F.count(F.lit(1)) > 1).alias("ambiguous")
    )


def corporate_actions(docs: DataFrame) -> DataFrame:
    """Splits and dividends of each symbol, from the longest response for each of its windows (column `year`, if there is one)."""
    c = parse_charts(docs)
    best = c.groupBy("symbol", *[w for w in ("year",) if w in c.columns]).agg(
        F.max_by(F.struct("events"), F.struct(F.size("timestamp").alias("n"), F.col("timestamp")[0].alias("from"))).alias("r")
    )
    kinds = best.select("symbol", F.explode("r.events").alias("event_type", "items"))
    items = kinds.select("symbol", "event_type", F.explode("items").alias("id", "e"))
    return items.select(
        "symbol",
        new_york_date("e.date").alias("date"),
        "event_type",
        F.try_divide("e.numerator", F.coalesce("e.denominator", F.lit(1.0))).alias("split_ratio"),
        F.col("e.amount").alias("dividend_amount"),
    )


def build_charts(bars: DataFrame) -> DataFrame:
    """Chart documents from bars, one per symbol and year (at most 366 sessions each)."""
    epoch = F.unix_timestamp(F.to_utc_timestamp(F.col("date").cast("timestamp") + F.expr("INTERVAL 570 MINUTES"), "America/New_York"))
    row = F.struct(epoch.alias("epoch"), "open", "high", "low", "close", "volume")
    year = bars.groupBy("symbol", F.year("date").alias("year")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.collect_list(
            F.when(
                F.col("volume") >= 90,
                F.struct(epoch.cast("string").alias("id"), F.struct(F.col("open").alias("amount"), epoch.alias("date")).alias("e")),
            )
        ).alias("dividends"),
        F.collect_list(
            F.when(
                F.col("high") >= F.col("low") * 2,
                F.struct(
                    epoch.cast("string").alias("id"),
                    F.struct(F.lit(2.0).alias("numerator"), F.lit(1.0).alias("denominator"), epoch.alias("date")).alias("e"),
                ),
            )
        ).alias("splits"),
    )

    def arr(c: str):
        return F.transform("rows", lambda r: r[c])

    quote = F.array(F.struct(*[arr(c).alias(c) for c in ("open", "high", "low", "close", "volume")]))
    events = F.struct(
        F.map_from_entries("dividends").alias("dividends"), F.map_from_entries("splits").alias("splits")
    )
    body = F.to_json(
        F.struct(
            F.struct("symbol").alias("meta"),
            arr("epoch").alias("timestamp"),
            F.struct(quote.alias("quote")).alias("indicators"),
            events.alias("events"),
        )
    )
    return year.select("symbol", "year", body.alias("body"))
