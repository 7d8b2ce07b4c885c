"""Writes that are checked by the rows they write, in the same pass, and published only when every check holds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def checked_write(
    df: DataFrame, path: str, checks: dict[str, Column], keep: list[str], by: list[str], within: list[str], ranges: bool = False
) -> dict[str, int]:
    """Write the columns `keep` as Parquet, partitioned by `by` and sorted by `within`; returns the rows and, for each check, the rows that break it.

    The counts are observed on the rows on their way to the files, so no check computes them again. With `ranges` each file covers a range
    of `by`, for which Spark samples the rows once before. Files go to a folder beside the
    target, which takes the target's place if all counts are zero; otherwise it is deleted, the old table stays and a ValueError names the counts.
    """
    spark, metrics = df.sparkSession, Observation()
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    counts = [F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in checks.items()]
    dealt = (df.repartitionByRange(*by) if ranges else df.repartition(*by)).sortWithinPartitions(*within)
    seen = dealt.observe(metrics, F.count(F.lit(1)).alias("rows"), *counts).select(*keep)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    target, new = folder(path), folder(staged)
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        seen.write.parquet(staged)
        found = metrics.get
        broken = {name: found[name] for name in checks if found[name]}
        if broken:
            raise ValueError(f"nothing written to {path}: {broken}")
        files.delete(target, True)
        if not files.rename(new, target):
            raise OSError(f"could not publish {path}")
    finally:
        files.delete(new, True)
    return found
