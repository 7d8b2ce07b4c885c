"""Run summaries of many columns over the sessions of a symbol, from the wide rows as they are.

The sessions of a symbol are summarised block by block for all columns at once, and the summaries of neighbouring blocks join: a run that
ends one block and begins the next one becomes a single run. A summary therefore holds, for each column, the run at its head, the
run at its tail, the longest inside, and counts. No row is copied to its columns and nothing is sorted but a symbol's dates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitline.operators.moments import matrix

#: Sessions of a block.
BLOCK = 4096
NEVER = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Summary of consecutive rows; every array has an entry for each column. A run of equal values holds no missing one."""

    rows: int
    first: np.ndarray  # the values of the first and last row, NaN where missing
    last: np.ndarray
    valid: np.ndarray
    head_missing: np.ndarray
    tail_missing: np.ndarray
    longest_missing: np.ndarray
    missing_blocks: np.ndarray
    head_equal: np.ndarray
    tail_equal: np.ndarray
    longest_equal: np.ndarray
    transitions: np.ndarray  # rows that differ from the one before, a missing value being a value of its own
    changes: np.ndarray  # of them those between two values
    first_valid: np.ndarray  # days; NEVER and -NEVER where there is none
    last_valid: np.ndarray
    values: list[np.ndarray] = field(default_factory=list)  # distinct, sorted

    @classmethod
    def of(cls, x: np.ndarray, days: np.ndarray) -> Runs:
        n, k = x.shape
        at, valid = np.arange(n)[:, None], ~np.isnan(x)
        latest = np.maximum.accumulate(np.where(valid, at, -1), axis=0)
        gap = np.where(valid, 0, at - latest)
        starts_gap = ~valid
        starts_gap[1:] &= valid[:-1]
        same = np.zeros((n, k), bool)
        same[1:] = x[1:] == x[:-1]
        begun = np.maximum.accumulate(np.where(valid & ~same, at, -1), axis=0)
        equal = np.where(valid, at - begun + 1, 0)
        both = valid[1:] & valid[:-1]
        has = valid.any(axis=0)
        broken = np.concatenate((~same[1:], np.ones((1, k), bool))).argmax(axis=0) + 1  # rows up to the first that differs
        return cls(
            n, x[0], x[-1], valid.sum(axis=0), np.where(has, valid.argmax(axis=0), n), n - 1 - latest[-1], gap.max(axis=0), starts_gap.sum(axis=0),
            np.where(valid[0], broken, 0), equal[-1], equal.max(axis=0), (~same[1:] & (valid[1:] | valid[:-1])).sum(axis=0), (both & ~same[1:]).sum(axis=0),
            np.where(has, days[valid.argmax(axis=0)], NEVER), np.where(has, days[latest[-1]], -NEVER), [np.unique(x[valid[:, c], c]) for c in range(k)],
        )

    def join(self, more: Runs) -> Runs:
        """The summary of these rows followed by those of `more`."""
        meet = self.last == more.first  # false where a side is missing
        neither = np.isnan(self.last) & np.isnan(more.first)
        both = ~np.isnan(self.last) & ~np.isnan(more.first)
        across = np.where(meet, self.tail_equal + more.head_equal, 0)
        return Runs(
            self.rows + more.rows, self.first, more.last, self.valid + more.valid,
            np.where(self.head_missing < self.rows, self.head_missing, self.rows + more.head_missing),
            np.where(more.tail_missing < more.rows, more.tail_missing, more.rows + self.tail_missing),
            np.maximum(np.maximum(self.longest_missing, more.longest_missing), self.tail_missing + more.head_missing),
            self.missing_blocks + more.missing_blocks - neither,
            np.where(meet & (self.head_equal == self.rows), across, self.head_equal),
            np.where(meet & (more.tail_equal == more.rows), across, more.tail_equal),
            np.maximum(np.maximum(self.longest_equal, more.longest_equal), across),
            self.transitions + more.transitions + ~(meet | neither), self.changes + more.changes + (both & ~meet),
            np.minimum(self.first_valid, more.first_valid), np.maximum(self.last_valid, more.last_valid),
            [np.union1d(a, b) for a, b in zip(self.values, more.values, strict=True)],
        )


def summary(x: np.ndarray, days: np.ndarray, block: int = BLOCK) -> Runs:
    """Of rows in the order of their days, folded over blocks."""
    whole = Runs.of(x[:block], days[:block])
    for start in range(block, len(x), block):
        whole = whole.join(Runs.of(x[start : start + block], days[start : start + block]))
    return whole


SUMMARY = [T.StructField(n, t) for n, t in (
    ("feature", T.StringType()), ("sessions", T.LongType()), ("non_null_count", T.LongType()), ("unique_count", T.IntegerType()), ("first_valid_date", T.DateType()),
    ("last_valid_date", T.DateType()), ("value_changes", T.LongType()), ("payload_transitions", T.LongType()), ("longest_missing_run", T.IntegerType()),
    ("missing_blocks", T.LongType()), ("leading_missing", T.IntegerType()), ("longest_constant_run", T.IntegerType()),
)]


def summary_columns(x: np.ndarray, days: np.ndarray, features: tuple[str, ...], block: int = BLOCK) -> dict[str, pa.Array]:
    r = summary(x, days, block)
    day = lambda v: pa.array([None if abs(int(d)) == NEVER else int(d) for d in v], pa.int32()).cast(pa.date32())
    return {
        "feature": pa.array(features), "sessions": pa.array([r.rows] * len(features), pa.int64()), "non_null_count": pa.array(r.valid, pa.int64()),
        "unique_count": pa.array([len(v) for v in r.values], pa.int32()), "first_valid_date": day(r.first_valid), "last_valid_date": day(r.last_valid),
        "value_changes": pa.array(r.changes, pa.int64()), "payload_transitions": pa.array(r.transitions, pa.int64()),
        "longest_missing_run": pa.array(r.longest_missing, pa.int32()), "missing_blocks": pa.array(r.missing_blocks, pa.int64()),
        "leading_missing": pa.array(r.head_missing, pa.int32()), "longest_constant_run": pa.array(r.longest_equal, pa.int32()),
    }


def by_date(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by("date")
    return table, table.column("date").cast(pa.int32()).to_numpy().astype(np.int64)


def run_summaries(wide: DataFrame, features: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """One row for each symbol and feature: counts, distinct values, first and last valid date, changes, and runs of missing and of equal values."""

    def of_symbol(table: pa.Table) -> pa.Table:
        table, days = by_date(table)
        columns = summary_columns(matrix(table, list(features)), days, features, block)
        return pa.table({"symbol": pa.array([table.column("symbol")[0].as_py()] * len(features), pa.string())} | columns)

    rows = wide.select("symbol", "date", *[wide[f].cast("double").alias(f) for f in features])
    return rows.groupBy("symbol").applyInArrow(of_symbol, T.StructType([T.StructField("symbol", T.StringType()), *SUMMARY]))
