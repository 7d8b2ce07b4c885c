"""Seeded faults: cells of a table changed where a hash of the row's key says so, to see that an audit counts what is wrong.

The rule needs md5 alone, so another engine can count the same faults from the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERY = 37
DIGITS = 6


def planted(name: str, key: list[str], every: int = EVERY) -> Column:
    """Whether the fault of this name stands in a row: about one row in `every`, each name by its own hash."""
    text = F.concat_ws("|", F.lit(name), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") % every == 0


def plant(frame: DataFrame, key: list[str], faults: dict[str, tuple[str, Column]], gone: str | None = None, every: int = EVERY) -> DataFrame:
    """The frame with faults {name: (column, value that replaces it)}, all reading the original values; rows of the fault `gone` are left out.

    A column takes one fault, so that what an audit must find follows from the names alone.
    """
    columns = [c for c, _ in faults.values()]
    if len(set(columns)) != len(columns) or set(columns) & set(key):
        raise ValueError("a column takes one fault and keys none")
    # a plain projection: the key is read before any cell changes
    cells = {c: F.when(planted(name, key, every), value).otherwise(F.col(c)) for name, (c, value) in faults.items()}
    kept = frame if gone is None else frame.filter(~planted(gone, key, every))
    return kept.withColumns(cells)
