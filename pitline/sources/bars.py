"""Bar files: read, write, and bounded reads that push their filter and columns to the scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.config import BAR_COLUMNS, MARKET_FEATURES, WARMUP
from pitline.functions.windows import ordinal
from pitline.operators.bars import standardise_bars
from pitline.operators.rolling import build_features
from pitline.sources.checked import checked_write

VENDOR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Date", "Open", "High", "Low", "Close", "Volume", "Adj Close")]
)


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vendor CSV files (one per symbol, named after it), all cells as text, with their file position.

    A file's rows are numbered by file and byte order through the reader's own metadata, so a later
    row of the same day wins whatever task reads it.
    """
    df = spark.read.schema(VENDOR_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    arrival = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", F.upper(name).alias("symbol"), arrival.alias("_arrival"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return standardise_bars(read_vendor_csv(spark, path), F.col("_arrival"))


def write_history(bars: DataFrame, path: str) -> None:
    """Parquet, one directory per leading hash of symbol, sorted by (symbol, date) for range pruning."""
    bars.select("symbol", *BAR_COLUMNS).repartition("symbol").sortWithinPartitions("symbol", "date").write.mode(
        "overwrite"
    ).parquet(path)


def write_history_by_symbol(bars: DataFrame, path: str) -> None:
    """One directory per symbol, the layout of a small stock pool."""
    bars.select("symbol", *BAR_COLUMNS).repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_selected(spark: SparkSession, path: str, columns: list[str], start=None, end=None, on: str = "date") -> DataFrame:
    """Only these columns and dates; the bounds compare the stored column so Parquet can skip row groups."""
    df = spark.read.parquet(path)
    cond: Column | None = None
    if start is not None:
        cond = F.col(on) >= F.lit(start)
    if end is not None:
        upper = F.col(on) < F.lit(end)
        cond = upper if cond is None else cond & upper
    if cond is not None:
        df = df.filter(cond)
    return df.select(*columns)


def write_features(features: DataFrame, path: str) -> dict[str, int]:
    """Store features in fixed column order; warm-up and finiteness are checked on the rows as they are written, and invalid data stays unpublished."""
    at = {c: F.col("_pos") < k for c, k in WARMUP.items()}
    some = lambda conditions: reduce(or_, conditions)
    checks = {
        "unexpected_null": some(F.col(c).isNull() & ~warming for c, warming in at.items()),
        "missing_warmup_null": some(F.col(c).isNotNull() & warming for c, warming in at.items()),
        "infinite_values": some(F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) for c in at),
    }
    return checked_write(features.withColumn("_pos", ordinal()), path, checks, ["symbol", *BAR_COLUMNS, *MARKET_FEATURES], ["symbol"], ["symbol", "date"])


def write_filings(filings: DataFrame, path: str) -> dict[str, int]:
    """Store filings in the order of their filing dates, so that a read bounded by filing date skips files and row groups."""
    checks = {"without_date": F.col("filing_date").isNull(), "without_accession": F.col("accession").isNull()}
    return checked_write(filings, path, checks, filings.columns, ["filing_date"], ["filing_date", "symbol"], ranges=True)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = set(("symbol", *BAR_COLUMNS, *MARKET_FEATURES)) - set(df.columns)
    if missing:
        raise ValueError(f"missing feature columns: {sorted(missing)}")
    return df.select("symbol", *BAR_COLUMNS, *MARKET_FEATURES)


def process_pool(bars: DataFrame, path: str) -> None:
    """All symbols in one job: features for the whole pool, checked and written."""
    write_features(build_features(bars), path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON report; NaN and infinities are written as null."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [
        F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if c in numeric else F.col(c)
        for c in df.columns
    ]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
