"""Column-name and identifier text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(name: object) -> str:
    return str(name).strip().lower().replace(" ", "_")


def is_amended(form: Column | str) -> Column:
    form = F.col(form) if isinstance(form, str) else form
    return form.endswith("/A").cast("int")


def joined_flags(flags: dict[str, Column]) -> Column:
    """Names of the true flags joined by '|'."""
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in flags.items()])
