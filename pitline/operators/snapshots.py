"""Filing snapshots: ratios of one observation and growth against the comparable prior-year one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import (
    BALANCE_RATIOS,
    BASIS_PREFIX,
    FIELDS,
    FILING_META,
    FUNDAMENTAL_FEATURES,
    GROWTH,
    RATIOS,
)
from pitline.functions.numeric import sdiv
from pitline.functions.text import is_amended

REFERENCE = tuple(f"yoy_reference_{c}" for c in FILING_META)
PROVENANCE = ("yoy_comparison_status", *REFERENCE)
#: What places an observation among those of its company; without one of them it is no snapshot.
PERIOD = ("symbol", "data_period_type", "fiscal_period", "fiscal_year", "filing_date")


def eligible(filings: DataFrame) -> DataFrame:
    """Standalone quarters and full years; cumulative year-to-date rows never enter a state."""
    return filings.filter(F.col("data_period_type").isin(*BASIS_PREFIX))


def ratio_columns() -> dict[str, Column]:
    cols = {}
    for basis, prefix in BASIS_PREFIX.items():
        for name, num in RATIOS.items():
            cols[f"{prefix}_{name}"] = F.when(F.col("data_period_type") == basis, sdiv(num, "revenue"))
    cols.update({name: sdiv(num, den) for name, (num, den) in BALANCE_RATIOS.items()})
    return cols


def prior_year_reference(obs: DataFrame) -> DataFrame:
    """Adds the reference struct and comparison status each filing could know on its filing day.

    Observations first shrink to one row per (basis, period, fiscal year, filing day). Each such row enters the window of its own
    year and that of the next one, so no pairs are formed. Filings that are dealt by symbol stay where they are.
    """
    keys = list(PERIOD[:-2])
    span = F.struct("period_start", "period_end")
    ranked = F.struct(
        "period_end", is_amended("form").alias("_amended"), "period_start", "accession",
        *[c for c in (*FILING_META, *GROWTH.values()) if c not in ("period_end", "period_start", "accession")],
    )
    day = obs.groupBy(*keys, "fiscal_year", "filing_date").agg(
        F.max(ranked).alias("top"), F.min(span).alias("lo"), F.max(span).alias("hi")
    )
    years = F.array(*[F.struct((F.col("fiscal_year") + 1 - k).alias("fiscal_year"), F.lit(k).alias("_k")) for k in (1, 0)])  # its own, and as prior year
    w = W.partitionBy(*keys, "fiscal_year").orderBy("filing_date", "_k").rowsBetween(W.unboundedPreceding, 0)

    def seen(agg, c: str, kind: int) -> Column:
        return agg(F.when(F.col("_k") == kind, F.col(c))).over(w)

    known = (
        day.select(*keys, "filing_date", "top", "lo", "hi", F.inline(years))
        .withColumns(
            {
                "_ref": F.last(F.when(F.col("_k") == 0, F.col("top")), ignorenulls=True).over(w),
                "_several_now": seen(F.min, "lo", 1) != seen(F.max, "hi", 1),
                "_several_before": seen(F.min, "lo", 0) != seen(F.max, "hi", 0),
            }
        )
        .filter(F.col("_k") == 1)
        .select(*keys, "fiscal_year", "filing_date", "_ref", "_several_now", "_several_before")
    )
    out = obs.join(known.hint("shuffle_hash"), list(PERIOD))
    gaps_ok = F.datediff("period_start", "_ref.period_start").between(330, 400) & F.datediff(
        "period_end", "_ref.period_end"
    ).between(330, 400)
    status = (
        F.when(F.col("_several_now"), "ambiguous_current_period")
        .when(F.col("_ref").isNull(), "missing_previous_period")
        .when(F.col("_several_before"), "ambiguous_previous_period")
        .when(~gaps_ok | (F.col("_ref.period_end") >= F.col("period_start")), "noncomparable_period_dates")
        .otherwise("available")
    )
    return out.withColumn("yoy_comparison_status", status).withColumn(
        "_ref", F.when(F.col("yoy_comparison_status") == "available", F.col("_ref"))
    )


def build_snapshots(filings: DataFrame) -> DataFrame:
    """Eligible observations with thirty ratio and growth features and a frozen reference identity."""
    clash = set(filings.columns) & {*FUNDAMENTAL_FEATURES, *PROVENANCE}
    if clash:
        raise ValueError(f"reserved columns present: {sorted(clash)}")
    obs = prior_year_reference(eligible(filings).withColumns(ratio_columns()))
    growth = {
        f"{prefix}_{name}_growth_yoy": F.when(
            F.col("data_period_type") == basis, sdiv(F.col(field), F.col(f"_ref.{field}"), growth=True)
        )
        for basis, prefix in BASIS_PREFIX.items()
        for name, field in GROWTH.items()
    }
    reference = {f"yoy_reference_{c}": F.col(f"_ref.{c}") for c in FILING_META}
    return obs.withColumns({**growth, **reference}).select(
        "symbol", *FILING_META, *FIELDS, *FUNDAMENTAL_FEATURES, *PROVENANCE
    )


def reference_oracle(filings: DataFrame) -> DataFrame:
    """Prior-year reference by SQL self-join and grouping, a second formulation for checking.

    The join key is one reporting period of one company, whose filings are an original and amendments.
    """
    kept = ("filing_date", "period_end", "period_start", "accession", *GROWTH.values())
    picked = ", ".join(f"'{c}', b.{c}" for c in kept)
    same = "a.symbol = b.symbol AND a.data_period_type = b.data_period_type AND a.fiscal_period = b.fiscal_period"
    key = "symbol, accession, period_start, period_end, data_period_type"
    akey = ", ".join(f"a.{c.strip()}" for c in key.split(","))
    obs = eligible(filings)
    return obs.sparkSession.sql(
        f"""
        WITH cur AS (
          SELECT {akey}, count(DISTINCT struct(b.period_start, b.period_end)) AS n_now
          FROM {{obs}} a JOIN {{obs}} b ON {same} AND a.fiscal_year = b.fiscal_year AND b.filing_date <= a.filing_date
          GROUP BY {akey}),
        prev AS (
          SELECT {akey}, count(DISTINCT struct(b.period_start, b.period_end)) AS n_before,
                 max_by(named_struct({picked}),
                        struct(b.filing_date, b.period_end, endswith(b.form, '/A'), b.period_start, b.accession)) AS ref
          FROM {{obs}} a JOIN {{obs}} b ON {same} AND a.fiscal_year = b.fiscal_year + 1 AND b.filing_date <= a.filing_date
          GROUP BY {akey})
        SELECT {key}, CASE WHEN n_now = 1 AND n_before = 1
                AND datediff(period_start, ref.period_start) BETWEEN 330 AND 400
                AND datediff(period_end, ref.period_end) BETWEEN 330 AND 400
                AND ref.period_end < period_start THEN ref END AS oracle_ref
        FROM cur LEFT JOIN prev USING ({key})
        """,
        obs=obs,
    )


def reference_violations(snapshots: DataFrame, filings: DataFrame) -> DataFrame:
    """Per symbol: snapshots whose reference or growth differs from the second formulation."""
    key = ["symbol", "accession", "period_start", "period_end", "data_period_type"]
    j = snapshots.join(reference_oracle(filings), key, "left")
    bad = ~F.col("yoy_reference_accession").eqNullSafe(F.col("oracle_ref.accession"))
    late = F.coalesce(F.col("yoy_reference_filing_date") > F.col("filing_date"), F.lit(False))
    aggs = []
    for name, field in GROWTH.items():
        got = F.coalesce(f"q_{name}_growth_yoy", f"fy_{name}_growth_yoy")
        want = sdiv(F.col(field), F.col(f"oracle_ref.{field}"), growth=True)
        aggs.append(F.count_if(~got.eqNullSafe(want)).alias(f"{name}_violations"))
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if(bad).alias("reference_violations"),
        F.count_if(late).alias("unknown_reference_violations"), *aggs,
    )
