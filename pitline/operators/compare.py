"""Exact and tolerant comparison of tables and vintages, fingerprints, and lineage divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import ATOL_DERIVED, RESEARCH_FEATURES, WARMUP
from pitline.functions.numeric import is_close


def exact_diff(left: DataFrame, right: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """Changed cells per column, NULLs paired; rows of one side only and schema differences get their own lines.

    One full outer join on the key and one aggregate over all columns at once.
    """
    if columns is None:
        if left.columns != right.columns:
            odd = sorted(set(left.columns) ^ set(right.columns)) or ["order"]
            return left.sparkSession.createDataFrame([("__schema__", len(odd))], "column string, changed_cells bigint")
        columns = [c for c in left.columns if c not in key]
    a = left.select(*key, F.lit(True).alias("_l"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(*key, F.lit(True).alias("_r"), *[F.col(c).alias(f"b_{c}") for c in columns])
    j = a.join(b, key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = [F.struct(F.lit("__rows__").alias("column"), F.count_if(~both).alias("changed_cells"))]
    counts += [
        F.struct(F.lit(c).alias("column"), F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("changed_cells"))
        for c in columns
    ]
    return j.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def changed_cells(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The differing cells themselves, long, with both values as text."""
    a = left.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns])
    cells = [
        F.when(
            ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")),
            F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("string").alias("old_value"), F.col(f"b_{c}").cast("string").alias("new_value")),
        )
        for c in columns
    ]
    return a.join(b, key).select(*key, F.inline(F.array_compact(F.array(*cells))))


def session_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions present on one side only."""
    gone = old.select("symbol", "date").join(new, ["symbol", "date"], "left_anti").withColumn("side", F.lit("only_old"))
    came = new.select("symbol", "date").join(old, ["symbol", "date"], "left_anti").withColumn("side", F.lit("only_new"))
    return gone.unionByName(came)


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """Order-free fingerprint: row count, NULL counts and the sum of row hashes (wide enough not to overflow)."""
    if method == "md5":
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
        h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    else:
        h = F.xxhash64(*columns).cast("decimal(20,0)")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).alias("digest"), *nulls)


def vintage_gate(current: DataFrame, registry: DataFrame, features: tuple[str, ...], target: str) -> DataFrame:
    """Decision per vintage: unknown, not approved, out of scope, changed data, or accepted.

    ``registry`` has vintage, approved, features, targets, row_count, digest; ``current`` has vintage, row_count, digest.
    """
    reg = registry.select(
        "vintage", "approved", "features", "targets", F.col("row_count").alias("_n"), F.col("digest").alias("_d"), F.lit(True).alias("_known")
    )
    j = current.join(reg, "vintage", "left")
    scope = F.array(*[F.lit(f) for f in features])
    decision = (
        F.when(F.col("_known").isNull(), "unknown_vintage")
        .when(~F.coalesce("approved", F.lit(False)), "not_approved")
        .when((F.size(F.array_except(scope, "features")) > 0) | ~F.array_contains("targets", target), "out_of_scope")
        .when((F.col("row_count") != F.col("_n")) | (F.col("digest") != F.col("_d")), "fingerprint_mismatch")
        .otherwise("accepted")
    )
    return j.select("vintage", decision.alias("decision"))


def overlap_audit(old: DataFrame, new: DataFrame, exact: list[str], derived: list[str], states: list[str]) -> DataFrame:
    """Common cells of two vintages per field: exact, within tolerance, explained by the later start, or unexpected.

    A missing market feature is explained inside its warm-up rows of the old vintage. A state's effective
    date and its companions are explained when the same filing predates the old start.
    """
    w = W.partitionBy("symbol").orderBy("date")
    meta = [f"{p}_{c}" for p in states for c in ("accession", "filing_date")]
    fields = [*exact, *derived]
    eff = {}
    for p in states:
        eff.update({f"{p}_{c}": p for c in ("effective_date", "effective_date_basis", "effective_date_is_sample_truncated", "days_since_effective_date")})
    o = old.select("symbol", "date", (F.row_number().over(w) - 1).alias("_pos"), F.min("date").over(W.partitionBy("symbol")).alias("_start"),
                   *[F.col(c).alias(f"o_{c}") for c in (*fields, *eff, *meta)])
    j = o.join(new.select("symbol", "date", *fields, *eff, *meta), ["symbol", "date"])
    aggs = []
    for c in (*fields, *eff):
        a, b = F.col(f"o_{c}"), F.col(c)
        same = a.eqNullSafe(b)
        near = ~same & (is_close(a, b, 0.0, ATOL_DERIVED) if c in derived else F.lit(False))
        rest = ~same & ~near
        if c in WARMUP:
            explained = rest & a.isNull() & b.isNotNull() & (F.col("_pos") < WARMUP[c])
        elif c in eff:
            p = eff[c]
            explained = (
                rest & F.col(f"o_{p}_accession").eqNullSafe(F.col(f"{p}_accession")) & (F.col(f"o_{p}_filing_date") < F.col("_start"))
                & (F.col(f"o_{p}_effective_date") == F.col("_start"))
                & ((F.col(f"{p}_effective_date") > F.col(f"{p}_filing_date")) & (F.col(f"{p}_effective_date") <= F.col("_start")))
            )
        else:
            explained = F.lit(False)
        explained = F.coalesce(explained, F.lit(False))
        aggs.append(
            F.struct(
                F.lit(c).alias("field"), F.count(F.lit(1)).alias("overlap_cells"), F.count_if(same).alias("exact_matches"), F.count_if(near).alias("tolerant_matches"),
                F.count_if(explained).alias("explained_differences"), F.count_if(rest & ~explained).alias("unexpected_differences"),
            )
        )
    return j.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def first_divergence(trace: DataFrame, layers: list[str], key: list[str]) -> DataFrame:
    """First layer where two available sides differ; missing earlier layers leave the cause unidentified.

    ``trace`` is long: key, side ('legacy' or 'expanded'), layer, value, available.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))

    def side(s: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c)))

    per = trace.groupBy(*key, "layer").agg(
        side("legacy", "value").alias("a"), side("expanded", "value").alias("b"),
        F.coalesce(side("legacy", "available"), F.lit(False)).alias("la"), F.coalesce(side("expanded", "available"), F.lit(False)).alias("ea"),
    ).withColumn("_o", order)
    both = F.col("la") & F.col("ea")
    differs = both & (F.col("a") != F.col("b"))
    s = per.groupBy(*key).agg(
        F.min_by("layer", F.when(differs, F.col("_o"))).alias("first_observed_divergence_layer"),
        F.min(F.when(differs, F.col("_o"))).alias("_at"),
        F.collect_set(F.when(~both, F.col("_o"))).alias("_gaps"),
    )
    missing = F.size(F.filter("_gaps", lambda g: F.col("_at").isNull() | (g < F.col("_at"))))
    known = F.col("_at").isNotNull() & (missing == 0)
    return s.select(
        *key, "first_observed_divergence_layer", missing.alias("missing_earlier_layers"), known.alias("cause_identified"),
        F.when(known, F.col("first_observed_divergence_layer")).when(F.col("_at").isNotNull(), "NOT_IDENTIFIABLE_WITH_AVAILABLE_EVIDENCE").alias("first_divergence_layer"),
    )


def propagation(trace: DataFrame, layers: list[str], key: list[str]) -> DataFrame:
    """Edges between consecutive available layers of a side, and those where the value changes on the way."""
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    t = trace.filter("available").withColumn("_o", order)
    w = W.partitionBy(*key, "side").orderBy("_o")
    e = t.withColumns({"_prev": F.lag("value").over(w), "_n": F.row_number().over(w)})
    return e.groupBy("side").agg(
        F.count_if(F.col("_n") > 1).alias("edges_checked"),
        F.count_if((F.col("_n") > 1) & ~F.col("value").eqNullSafe(F.col("_prev"))).alias("propagation_violations"),
    )


def trace_validity(trace: DataFrame, layers: list[str], key: list[str]) -> DataFrame:
    """Each side must name every layer exactly once and give no value where it claims none."""
    per = trace.groupBy(*key, "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("layer").alias("d"), F.count_if(~F.col("available") & F.col("value").isNotNull()).alias("fabricated")
    )
    return per.groupBy("side").agg(
        F.count_if((F.col("n") != len(layers)) | (F.col("d") != len(layers))).alias("layer_violations"), F.sum("fabricated").alias("fabricated_values")
    )


#: What names a state's source snapshot within its symbol.
CELL_KEY = ("accession", "period_start", "period_end", "data_period_type")


def cell_audit(daily: DataFrame, snapshots: DataFrame, stream: str, features: tuple[str, ...], provenance: bool) -> DataFrame:
    """Every daily cell of a stream against its source snapshot: presence, eligibility and exact value."""
    key = CELL_KEY
    src = snapshots.select(
        "symbol", *[F.col(c).alias(f"{stream}_{c}") for c in key], F.col("filing_date").alias("_filed"), F.lit(True).alias("_found"),
        *([F.col("yoy_reference_filing_date").alias("_ref")] if provenance else [F.lit(None).cast("date").alias("_ref")]),
        *[F.col(c).alias(f"s_{c}") for c in features],
    )
    j = daily.select("symbol", "date", *[f"{stream}_{c}" for c in key], f"{stream}_filing_date", f"{stream}_effective_date", *features).join(
        src, ["symbol", *[f"{stream}_{c}" for c in key]], "left"
    )
    held = F.col(f"{stream}_accession").isNotNull()
    eligible = F.coalesce((F.col("_filed") < F.col("date")) & (F.col(f"{stream}_effective_date") <= F.col("date")), F.lit(False))
    value = sum((F.count_if(held & ~F.col(c).eqNullSafe(F.col(f"s_{c}"))) for c in features), F.lit(0))
    orphan = sum((F.count_if(~held & F.col(c).isNotNull()) for c in features), F.lit(0))
    return j.groupBy("symbol").agg(
        F.lit(stream).alias("stream"),
        (F.count(F.lit(1)) * len(features)).alias("cells"),
        F.count_if(held & F.col("_found").isNull()).alias("unknown_sources"),
        F.count_if(held & ~eligible).alias("ineligible_states"),
        F.count_if(F.coalesce(F.col("_ref") > F.col("_filed"), F.lit(False))).alias("unknown_references"),
        value.alias("value_violations"),
        orphan.alias("values_without_state"),
    )


def profile_violations(daily: DataFrame, features: tuple[str, ...] = RESEARCH_FEATURES) -> DataFrame:
    """Column inventory checked against counts taken straight from the wide table (no unpivot, no run logic)."""
    from pitline.operators.profile import inventory

    w = W.partitionBy("symbol").orderBy("date")
    base = daily.select("symbol", "date", *features)
    first = F.row_number().over(w) == 1
    probes = {}
    for c in features:
        v, p = F.col(c), F.lag(c).over(w)
        probes[f"c_{c}"] = F.coalesce(v != p, F.lit(False))
        probes[f"b_{c}"] = v.isNull() & (first | p.isNotNull())
    wide = base.withColumns(probes).groupBy("symbol").agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.count(c).alias("_n"), F.count_if(f"c_{c}").alias("_c"), F.count_if(f"b_{c}").alias("_b"))
                for c in features
            ]
        ).alias("r")
    ).select("symbol", F.inline("r"))
    j = inventory(daily, features).join(wide, ["symbol", "feature"], "full_outer")
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(~F.col("non_null_count").eqNullSafe(F.col("_n"))).alias("count_violations"),
        F.count_if(~F.col("value_changes").eqNullSafe(F.col("_c"))).alias("change_violations"),
        F.count_if(~F.col("missing_blocks").eqNullSafe(F.col("_b"))).alias("block_violations"),
    )
