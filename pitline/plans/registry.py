"""Registry of named queries: the Spark plan, the survey rows it covers, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from pitline.plans.sql import compose
from pitline.session import apply_job_settings, size_shuffles
from pitline.sources import derived


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[["Tables"], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_job_settings(spark)
        tables = Tables(spark, sf_dir)
        size_shuffles(spark, tables.lines.count())  # from the file's metadata
        return self.build(tables)


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, compose(sql) if sql else None)
        return fn

    return register


class Tables:
    """Lazy inputs of one run. Only the two shared frames are kept, and only by plans that scan them repeatedly."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return derived.read_table(self.spark, self.dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def bars(self) -> DataFrame:
        return derived.derive_bars(self.lines)

    @cached_property
    def filings(self) -> DataFrame:
        return derived.derive_filings(self.lines)

    @cached_property
    def facts(self) -> DataFrame:
        return derived.derive_facts(self.filings)

    @cached_property
    def daily_shared(self) -> DataFrame:
        """The daily matrix kept for plans that read it several times; lost blocks are recomputed from lineage."""
        return self.daily.persist(StorageLevel.MEMORY_AND_DISK)

    def daily_kept(self, *columns: str) -> DataFrame:
        """These columns of the daily matrix, with its keys, kept like daily_shared; no other column is stored."""
        return self.daily.select("symbol", "date", *columns).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def market_labelled_shared(self) -> DataFrame:
        return self.market_labelled.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def features(self) -> DataFrame:
        from pitline.operators.rolling import build_features

        return build_features(self.bars)
