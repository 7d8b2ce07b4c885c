"""Window specs. A symbol holds at most one row per calendar day, which bounds every partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_session(*keys: str, order: str = "date") -> WindowSpec:
    return W.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(k: int, *keys: str) -> WindowSpec:
    return by_session(*keys).rowsBetween(-(k - 1), 0)


def ordinal(*keys: str) -> Column:
    """Zero-based session position."""
    return F.row_number().over(by_session(*keys)) - 1


def changed(c: str, w: WindowSpec) -> Column:
    """Value differs from the previous row, NULLs compared as values; first row is false."""
    return (F.row_number().over(w) > 1) & ~F.col(c).eqNullSafe(F.lag(c).over(w))


def average_rank(value: Column | str, keys: list[str]) -> Column:
    """Rank with ties averaged, within bounded groups."""
    value = F.col(value) if isinstance(value, str) else value
    low = F.rank().over(W.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return low + (ties - 1) / F.lit(2.0)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, list(columns), name, value)
