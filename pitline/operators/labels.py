"""Forward labels: enter at the next session's open, exit at the close h sessions ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.config import HORIZONS, PRIMARY_HORIZON
from pitline.functions.windows import by_session, ordinal


def label_columns() -> tuple[str, ...]:
    per = (c for h in HORIZONS for c in (f"target_exit_date_{h}d", f"target_exit_close_{h}d", f"forward_return_{h}d"))
    return ("target_entry_date", "target_entry_open", *per)


def _with_labels(df: DataFrame) -> DataFrame:
    """Positional labels per symbol; sessions without a future stay NULL. Overflowing returns raise."""
    w = by_session()
    cols = {"target_entry_date": F.lead("date").over(w), "target_entry_open": F.lead("open").over(w)}
    for h in HORIZONS:
        cols[f"target_exit_date_{h}d"] = F.lead("date", h).over(w)
        cols[f"target_exit_close_{h}d"] = F.lead("close", h).over(w)
    returns = {}
    for h in HORIZONS:
        ret = F.col(f"target_exit_close_{h}d") / F.col("target_entry_open") - 1
        returns[f"forward_return_{h}d"] = F.when(F.abs(ret) == float("inf"), F.raise_error(F.lit(f"non-finite return at horizon {h}"))).otherwise(ret)
    return df.withColumns(cols).withColumns(returns)


def build_labels(bars: DataFrame) -> DataFrame:
    return _with_labels(bars).select("symbol", "date", *label_columns())


def append_labels(features: DataFrame) -> DataFrame:
    """Labels beside the feature columns; both come from the same sorted partition, so no join is needed."""
    clash = set(label_columns()) & set(features.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    return _with_labels(features).select(*features.columns, *label_columns())


def price_contract(bars: DataFrame) -> DataFrame:
    """Rows per symbol whose open or close is missing, non-finite or not positive."""

    def bad(c: str):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) <= 0)

    return bars.groupBy("symbol").agg(F.count_if(bad("open") | bad("close")).alias("invalid_price_rows"))


def label_oracle(bars: DataFrame) -> DataFrame:
    """Labels rebuilt by equi-joins on session positions, independent of lead()."""
    p = bars.select("symbol", "date", "open", "close").withColumn("pos", ordinal())
    entry = p.select("symbol", (F.col("pos") - 1).alias("pos"), F.col("date").alias("entry_date"), F.col("open").alias("entry_open"))
    out = p.select("symbol", "date", "pos").join(entry, ["symbol", "pos"], "left")
    for h in HORIZONS:
        ahead = p.select(
            "symbol", (F.col("pos") - h).alias("pos"), F.col("date").alias(f"exit_date_{h}"), F.col("close").alias(f"exit_close_{h}")
        )
        out = out.join(ahead, ["symbol", "pos"], "left").withColumn(
            f"ret_{h}", F.col(f"exit_close_{h}") / F.col("entry_open") - 1
        )
    return out


def validate_labels(labels: DataFrame, bars: DataFrame, locked_from=None) -> DataFrame:
    """Violations per symbol and horizon against the positional rebuild; locked dates are skipped."""
    j = labels.join(label_oracle(bars), ["symbol", "date"], "full_outer")
    if locked_from is not None:
        j = j.filter(F.col("date") < F.lit(locked_from))
    structs = []
    for h in HORIZONS:
        ret, want = F.col(f"forward_return_{h}d"), F.col(f"ret_{h}")
        structs.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.count(F.lit(1)).alias("rows_checked"),
                F.count_if(
                    ~F.col("target_entry_date").eqNullSafe(F.col("entry_date"))
                    | ~F.col(f"target_exit_date_{h}d").eqNullSafe(F.col(f"exit_date_{h}"))
                ).alias("position_violations"),
                F.count_if(
                    ~F.col("target_entry_open").eqNullSafe(F.col("entry_open"))
                    | ~F.col(f"target_exit_close_{h}d").eqNullSafe(F.col(f"exit_close_{h}"))
                ).alias("price_violations"),
                F.count_if(
                    (ret.isNull() != want.isNull()) | F.coalesce(F.abs(ret - want) > 1e-12, F.lit(False))
                ).alias("formula_violations"),
                F.count_if(want.isNull()).alias("tail_nulls"),
            )
        )
    return j.groupBy("symbol").agg(F.array(*structs).alias("r")).select("symbol", F.inline("r"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Count, moments, quantiles and extrema of every horizon's return, per symbol."""
    structs = []
    for h in HORIZONS:
        c = F.col(f"forward_return_{h}d")
        q = F.percentile(c, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]))
        structs.append(
            F.struct(
                F.lit(f"forward_return_{h}d").alias("target_name"),
                F.lit(h).alias("horizon"),
                F.lit(h == PRIMARY_HORIZON).alias("primary_target"),
                F.count(c).alias("n"),
                F.count_if(c.isNull()).alias("missing"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                *[q[i].alias(n) for i, n in enumerate(("p01", "p05", "p25", "median", "p75", "p95", "p99"))],
                F.max(c).alias("max"),
            )
        )
    return labels.groupBy("symbol").agg(F.array(*structs).alias("r")).select("symbol", F.inline("r"))
