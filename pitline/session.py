"""Session settings for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from pitline.config import JOB_CONF, PARTITION_ROWS, SESSION_CONF


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pitline")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_settings(spark: SparkSession) -> None:
    """Set the job settings that are unset, whether at launch or since; choices of the caller win."""
    for key, value in JOB_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Deal shuffles of large inputs to at least one partition for PARTITION_ROWS input rows, so that a task's sort fits in memory.

    The number applies only where the session gives fewer partitions and names no initial number of its own.
    """
    ours = spark.conf.get("pitline.initialPartitions", None)
    if spark.conf.get(INITIAL, None) not in (None, ours):
        return
    number = str(-(-rows // PARTITION_ROWS))
    if int(number) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, number)
        spark.conf.set("pitline.initialPartitions", number)
    elif ours is not None:
        spark.conf.unset(INITIAL)
        spark.conf.unset("pitline.initialPartitions")


def stored_table(spark: SparkSession, label: str) -> str:
    """Path for a table that a query stores and reads again, in the shared folder of the session; one machine alone may do without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
