"""As-of joins by union and running windows: one shuffle on the key, a sort and one pass over the rows.

The right side must hold one row per key and time; callers aggregate to that first, which also keeps
a partition no larger than the key's own calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], strict: bool = False
) -> DataFrame:
    """Every left row with the latest right payload at or before (strict: before) its time."""
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"payload columns already on the left side: {sorted(clash)}")
    first, second = (1, 0) if strict else (0, 1)
    lrow, rrow = F.struct(*left.columns), F.struct(*payload)
    lt = left.select(*by, F.col(left_on).alias("_t"), F.lit(second).alias("_k"), lrow.alias("_l"))
    rt = right.select(*by, F.col(right_on).alias("_t"), F.lit(first).alias("_k"), rrow.alias("_r"))
    w = W.partitionBy(*by).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    u = lt.unionByName(rt, allowMissingColumns=True).withColumn("_s", F.last("_r", ignorenulls=True).over(w))
    return u.filter(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_s.{c}").alias(c) for c in payload])


def next_after(events: DataFrame, sessions: DataFrame, by: str, event_on: str, session_on: str, out: str) -> DataFrame:
    """First session strictly after each event time; NULL after the last session.

    Runs on distinct event times, then joins the answer back, so repeated times cost nothing extra.
    """
    times = events.select(by, F.col(event_on).alias("_t")).distinct().withColumn("_k", F.lit(1))
    cal = sessions.select(by, F.col(session_on).alias("_t"), F.lit(0).alias("_k"))
    # backwards in time, so that the frame grows row by row and each row is taken once
    w = W.partitionBy(by).orderBy(F.desc("_t"), F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    u = times.unionByName(cal).withColumn(out, F.last(F.when(F.col("_k") == 0, F.col("_t")), ignorenulls=True).over(w))
    found = u.filter(F.col("_k") == 1).select(by, F.col("_t").alias(event_on), out)
    return events.join(found, [by, event_on], "left")
