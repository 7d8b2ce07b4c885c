"""Strict calendar-date parsing and calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: accepted spellings of a calendar date.
DATE_PATTERN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})$"
DATE_SUFFIXES = ("_filing_date", "_period_start", "_period_end", "_effective_date")
DATE_NAMES = ("date", "period_start", "period_end", "filing_date", "effective_date")


def strict_date(c: Column | str) -> Column:
    """DATE for YYYY-MM-DD or YYYYMMDD that exists in the calendar, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_replace(c, "-", "")
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(c.rlike(DATE_PATTERN), iso.try_cast("date"))


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def is_plain_date(ts: Column | str) -> Column:
    """True when a timestamp carries no time of day."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts == F.date_trunc("day", ts)


def date_columns(names: list[str]) -> list[str]:
    """Which of these column names hold dates (ages and flags are excluded)."""
    return [n for n in names if "days_since" not in n and (n in DATE_NAMES or n.endswith(DATE_SUFFIXES))]


def new_york_date(epoch_seconds: Column | str) -> Column:
    """Session date of an epoch timestamp on the New York wall clock."""
    c = F.col(epoch_seconds) if isinstance(epoch_seconds, str) else epoch_seconds
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(c), "America/New_York"))


def quarter_index(d: Column | str) -> Column:
    """Consecutive number of the calendar quarter."""
    return F.year(d) * 4 + F.quarter(d) - 1
