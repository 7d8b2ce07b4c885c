"""Company-facts documents (nested JSON) to typed disclosure facts and wide filing observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.config import BALANCE_FIELDS, CONCEPTS, FIELDS, FILING_META, FISCAL_PERIODS, FORMS
from pitline.functions.dates import strict_date

FACT = T.StructType(
    [
        T.StructField("val", T.DoubleType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("accn", T.StringType()),
    ]
)
COMPANY_FACTS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("entityName", T.StringType()),
        T.StructField(
            "facts",
            T.MapType(
                T.StringType(),
                T.MapType(
                    T.StringType(),
                    T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT)))]),
                ),
            ),
        ),
    ]
)


def explode_documents(docs: DataFrame, symbol: str = "symbol", body: str = "body") -> DataFrame:
    """One row per fact of the us-gaap section of each document."""
    parsed = docs.select(symbol, F.from_json(body, COMPANY_FACTS).alias("d"))
    concept = parsed.select(symbol, F.explode(F.col("d.facts")["us-gaap"]).alias("concept", "c"))
    unit = concept.select(symbol, "concept", F.explode("c.units").alias("unit", "facts"))
    return unit.select(symbol, "concept", "unit", F.inline("facts"))


def concept_catalog(spark: SparkSession) -> DataFrame:
    """The fixed concept list as a table: about two dozen rows, whatever the data size."""
    rows = [
        (concept, unit, field, i, basis == "instant")
        for field, (concepts, unit, basis) in CONCEPTS.items()
        for i, concept in enumerate(concepts)
    ]
    return spark.createDataFrame(rows, "concept string, unit string, field string, priority int, instant boolean")


def calendar_date(flat: DataFrame, c: str) -> Column:
    """A column as a strict date; one of dates needs no parsing, only years of four digits."""
    if flat.schema[c].dataType == T.DateType():
        return F.when(F.year(c).between(0, 9999), F.col(c))
    return strict_date(F.col(c).cast("string"))


def type_facts(flat: DataFrame) -> DataFrame:
    """Mapped facts of supported forms with typed dates and the reason they are unusable, if any."""
    catalog = F.broadcast(concept_catalog(flat.sparkSession))
    typed = (
        flat.filter(F.col("form").isin(*FORMS))
        .join(catalog, ["concept", "unit"])
        .select(
            "symbol",
            "concept",
            "field",
            "priority",
            "instant",
            F.when(~F.col("instant"), calendar_date(flat, "start")).alias("start"),
            calendar_date(flat, "end").alias("end"),
            calendar_date(flat, "filed").alias("filed"),
            "fy",
            "fp",
            "form",
            "accn",
            F.col("val").cast("double").alias("val"),
        )
    )
    bad_date = F.col("end").isNull() | F.col("filed").isNull() | (~F.col("instant") & F.col("start").isNull())
    reason = (
        F.when(bad_date, "invalid_date")
        .when(F.col("fy").isNull() | ~F.col("fy").between(1990, 2100), "invalid_fiscal_year")
        .when(F.col("fp").isNull() | ~F.col("fp").isin(*FISCAL_PERIODS), "invalid_fiscal_period")
        .when(F.coalesce(F.col("accn"), F.lit("")) == "", "missing_accession")
        .when(F.col("val").isNull() | F.isnan("val") | (F.abs("val") == float("inf")), "nonfinite_value")
        .when(
            (F.col("filed") < F.col("end")) | F.coalesce(F.col("start") > F.col("end"), F.lit(False)), "invalid_chronology"
        )
    )
    return typed.withColumn("reason", reason)


def period_type() -> Column:
    """Duration class by inclusive days, form and fiscal label; NULL when unsupported."""
    days = F.datediff("end", "start") + 1
    annual_form = F.col("form").startswith("10-K")
    return (
        F.when(days.between(330, 400) & annual_form & (F.col("fp") == "FY"), "annual")
        .when(days.between(70, 110), "quarterly")
        .when(days.between(111, 300) & ~annual_form & F.col("fp").isin("Q2", "Q3"), "ytd")
    )


def distinct_facts(typed: DataFrame) -> DataFrame:
    """Usable facts, identical ones folded into a count, with duration class and currency.

    Folding first keeps a filing that repeats its facts small; after it everything stays on the
    (symbol, accession) partitioning of the window below.
    """
    cols = [c for c in typed.columns if c != "reason"]
    folded = typed.filter(F.col("reason").isNull()).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    latest = F.max("end").over(W.partitionBy("symbol", "accn"))
    return folded.withColumns(
        {"is_current": F.col("end") == latest, "kind": F.when(~F.col("instant"), period_type())}
    )


_GROUP = ["symbol", "accn", "end", "start", "kind", "instant"]


def preferred_values(current: DataFrame) -> DataFrame:
    """Per reporting group and field: value of the best concept, NULL when it contradicts itself."""
    ident = F.struct("fy", "fp", "filed", "form")
    level = current.groupBy(*_GROUP, "field", "priority", "concept").agg(
        F.min("val").alias("lo"),
        F.max("val").alias("hi"),
        F.sum("n").alias("n"),
        F.count_distinct("val").alias("d"),
        F.min(ident).alias("mlo"),
        F.max(ident).alias("mhi"),
    )
    best = level.groupBy(*_GROUP, "field").agg(
        F.min_by(F.struct("lo", "hi", "n", "d", "concept"), "priority").alias("b"), F.min("mlo").alias("mlo"), F.max("mhi").alias("mhi")
    )
    agrees = F.col("b.lo") == F.col("b.hi")
    return best.select(
        *_GROUP,
        "field",
        F.when(agrees, F.col("b.lo")).alias("val"),
        F.when(agrees, F.col("b.concept")).alias("concept"),
        (F.col("b.n") - F.col("b.d")).alias("dup"),
        (~agrees).alias("conflict"),
        "mlo",
        "mhi",
    )


def normalise_facts(flat: DataFrame) -> DataFrame:
    """Wide observations (metadata, twenty fields, concept provenance) with duplicate/conflict counts.

    Groups whose facts disagree on fiscal metadata are left out; see ``fact_issues``. Balance-sheet
    instants of a filing attach to each of its durations with the same end.
    """
    current = distinct_facts(type_facts(flat)).filter(F.col("is_current") & (F.col("instant") | F.col("kind").isNotNull()))
    pref = preferred_values(current)
    aggs = []
    for f in CONCEPTS:
        aggs.append(F.max(F.when(F.col("field") == f, F.col("val"))).alias(f))
        aggs.append(F.max(F.when(F.col("field") == f, F.col("concept"))).alias(f"{f}_concept"))
    wide = pref.groupBy(*_GROUP).agg(
        *aggs,
        F.sum("dup").alias("_dup"),
        F.count_if("conflict").alias("_conflicts"),
        F.min("mlo").alias("m"),
        (F.min("mlo") != F.max("mhi")).alias("clash"),
    )
    same_end = W.partitionBy("symbol", "accn", "end")
    shared = [*BALANCE_FIELDS, *[f"{f}_concept" for f in BALANCE_FIELDS]]
    wide = wide.withColumns(
        {
            **{c: F.max(c).over(same_end) for c in shared},
            "_idup": F.max(F.when(F.col("instant"), F.col("_dup"))).over(same_end),
            "_iconf": F.max(F.when(F.col("instant"), F.col("_conflicts"))).over(same_end),
        }
    ).filter(~F.col("instant") & ~F.col("clash"))
    label = F.when((F.col("kind") == "quarterly") & (F.col("m.fp") == "FY"), "Q4").otherwise(F.col("m.fp"))
    return wide.select(
        "symbol",
        F.col("m.fy").alias("fiscal_year"),
        label.alias("fiscal_period"),
        F.col("start").alias("period_start"),
        F.col("end").alias("period_end"),
        F.col("m.filed").alias("filing_date"),
        F.col("m.form").alias("form"),
        F.col("kind").alias("data_period_type"),
        F.col("accn").alias("accession"),
        *CONCEPTS,
        (F.col("operating_cash_flow") - F.col("capital_expenditures")).alias("free_cash_flow"),
        *[f"{f}_concept" for f in CONCEPTS],
        (F.col("_dup") + F.coalesce("_idup", F.lit(0))).alias("duplicates_removed"),
        (F.col("_conflicts") + F.coalesce("_iconf", F.lit(0))).alias("conflicting_fields"),
    )


def fact_issues(flat: DataFrame) -> DataFrame:
    """Rejected facts and groups: symbol, accession, field, reason and count."""
    typed = type_facts(flat)
    malformed = typed.filter(F.col("reason").isNotNull()).select("symbol", "accn", "field", "reason", F.lit(1).cast("bigint").alias("n"))
    current = distinct_facts(typed).filter("is_current")
    unsupported = ~F.col("instant") & F.col("kind").isNull()
    pref = preferred_values(current)
    first_field = F.min("field").over(W.partitionBy(*_GROUP)) == F.col("field")
    clash = ~F.col("instant") & (F.min("mlo").over(W.partitionBy(*_GROUP)) != F.max("mhi").over(W.partitionBy(*_GROUP)))
    found = pref.withColumn("_clash", clash & first_field).select(
        "symbol",
        "accn",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(unsupported, F.struct(F.col("field"), F.lit("unsupported_duration").alias("reason"))),
                    F.when(~unsupported & F.col("conflict"), F.struct(F.col("field"), F.lit("conflicting_values").alias("reason"))),
                    F.when(F.col("_clash"), F.struct(F.lit(None).cast("string").alias("field"), F.lit("conflicting_metadata").alias("reason"))),
                )
            )
        ),
    )
    rows = malformed.unionByName(found.withColumn("n", F.lit(1).cast("bigint")))
    return rows.groupBy("symbol", F.col("accn").alias("accession"), "field", "reason").agg(F.sum("n").alias("n"))


def comparative_counts(flat: DataFrame) -> DataFrame:
    """Facts per symbol left out because they restate an earlier period, from the counts of each filing's period ends."""
    n = F.count(F.lit(1)).alias("n")
    ends = type_facts(flat).filter(F.col("reason").isNull()).groupBy("symbol", "accn", "end").agg(n)
    filings = ends.groupBy("symbol", "accn").agg(F.sum("n").alias("n"), F.max(F.struct("end", "n")).alias("latest"))
    return filings.groupBy("symbol").agg(
        F.sum("n").alias("usable_facts"), F.sum(F.col("n") - F.col("latest.n")).alias("comparative_facts_excluded")
    )


def build_documents(facts: DataFrame) -> DataFrame:
    """Nest flat facts back into one JSON document per symbol and fiscal year (bounded by one year's filings)."""
    fact = F.struct(
        "val", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
        F.col("filed").cast("string").alias("filed"), "fy", "fp", "form", "accn",
    )
    unit = facts.groupBy("symbol", "fy", "concept", "unit").agg(F.collect_list(fact).alias("facts"))
    concept = unit.groupBy("symbol", "fy", "concept").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units")
    )
    doc = concept.groupBy("symbol", "fy").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("concept"), F.struct("units")))).alias("concepts")
    )
    body = F.to_json(
        F.struct(
            F.col("symbol").alias("cik"),
            F.col("symbol").alias("entityName"),
            F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts"),
        )
    )
    return doc.select("symbol", body.alias("body"))


def filing_errors(filings: DataFrame) -> DataFrame:
    """Filings that break a rule, one row per observation and error code."""
    days = F.datediff("period_end", "period_start") + 1
    k, form, fp = F.col("data_period_type"), F.col("form"), F.col("fiscal_period")
    period_ok = (
        ((k == "annual") & days.between(330, 400) & form.startswith("10-K") & (fp == "FY"))
        | ((k == "quarterly") & days.between(70, 110) & (fp != "FY"))
        | ((k == "ytd") & days.between(111, 300) & form.startswith("10-Q") & fp.isin("Q2", "Q3"))
    )
    nonfinite = F.lit(False)
    for c in FIELDS:
        nonfinite = nonfinite | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    diff = F.abs(F.col("free_cash_flow") - (F.col("operating_cash_flow") - F.col("capital_expenditures")))
    larger = F.greatest(F.abs("free_cash_flow"), F.abs(F.col("operating_cash_flow") - F.col("capital_expenditures")))
    inputs = F.col("operating_cash_flow").isNotNull() & F.col("capital_expenditures").isNotNull()
    rules = {
        "invalid_fiscal_year": ~F.coalesce(F.col("fiscal_year").between(1990, 2100), F.lit(False)),
        "invalid_fiscal_period": ~F.coalesce(fp.isin(*FISCAL_PERIODS), F.lit(False)),
        "invalid_chronology_or_form": ~F.coalesce(
            (F.col("period_start") <= F.col("period_end")) & (F.col("filing_date") >= F.col("period_end")) & form.isin(*FORMS),
            F.lit(False),
        ),
        "invalid_period_type": ~F.coalesce(period_ok, F.lit(False)) | (F.coalesce("accession", F.lit("")) == ""),
        "nonfinite_number": nonfinite,
        "negative_capex": F.coalesce(F.col("capital_expenditures") < 0, F.lit(False)),
        "fcf_identity": F.when(
            inputs, F.coalesce(diff > F.greatest(F.lit(0.01), larger * 1e-9), F.lit(True))
        ).otherwise(F.col("free_cash_flow").isNotNull()),
    }
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return filings.select("symbol", "accession", "period_start", "period_end", "data_period_type", F.explode(codes).alias("error"))


def duplicate_filings(filings: DataFrame) -> DataFrame:
    key = ["symbol", "accession", "period_start", "period_end", "data_period_type"]
    return filings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def redisclosed(snapshots: DataFrame, observations: DataFrame, flat: DataFrame) -> DataFrame:
    """Growth denominators against the latest value disclosed for the same period by the current filing day.

    A denominator is compared under the concept that its own filing used, which observations carry as `<field>_concept`.

    Facts shrink to one row per (concept, unit, period, filing day), then answer by a backward as-of.
    """
    from pitline.operators.asof import asof_backward
    from pitline.functions.text import is_amended

    fields = ("revenue", "gross_profit", "operating_income", "net_income", "research_and_development", "operating_cash_flow")
    key = ["symbol", "accession", "period_start", "period_end", "data_period_type"]
    refs = snapshots.filter(F.col("yoy_reference_accession").isNotNull()).select(
        "symbol",
        F.col("accession").alias("snapshot_accession"),
        F.col("period_start").alias("snapshot_period_start"),
        F.col("period_end").alias("snapshot_period_end"),
        F.col("data_period_type").alias("snapshot_data_period_type"),
        F.col("filing_date").alias("cutoff"),
        *[F.col(f"yoy_reference_{c}").alias(c) for c in key[1:]],
    )
    source = observations.select(*key, *[F.struct(F.col(f).alias("retained"), F.col(f"{f}_concept").alias("concept")).alias(f) for f in fields])
    ids = [c for c in refs.columns if c not in key] + ["symbol", "accession", "period_start", "period_end"]
    long = refs.join(source, key).unpivot(ids, list(fields), "metric", "v").select(*ids, "metric", "v.*")
    wanted = long.filter(F.col("retained").isNotNull()).withColumnsRenamed({"period_start": "start", "period_end": "end"})
    by = ["symbol", "concept", "start", "end"]
    disclosed = (
        flat.filter(F.col("form").isin(*FORMS) & F.col("start").isNotNull() & (F.col("unit") == "USD"))
        .select(*by, "filed", F.struct(is_amended("form").alias("amended"), F.col("accn"), F.col("form")).alias("rank"), "val")
        .groupBy(*by, "filed", "rank")
        .agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
        .groupBy(*by, "filed")
        .agg(F.max_by(F.struct("rank.accn", "lo", "hi"), "rank").alias("d"))
        .select(*by, "filed", F.struct(F.col("filed").alias("latest_filed"), "d.*").alias("d"))
    )
    j = asof_backward(wanted, disclosed, by, "cutoff", "filed", ["d"]).filter(F.col("d").isNotNull())
    status = (
        F.when(F.col("d.lo") != F.col("d.hi"), "conflicting_latest_values")
        .when(F.col("retained") != F.col("d.lo"), "different")
        .otherwise("equal")
    )
    return j.select(
        "symbol", "snapshot_accession", "snapshot_period_start", "snapshot_period_end", "snapshot_data_period_type",
        F.col("accession").alias("reference_accession"), "metric", "concept", "retained",
        F.col("d.latest_filed").alias("latest_filing_date"), F.col("d.accn").alias("latest_accession"),
        F.when(status != "conflicting_latest_values", F.col("d.lo")).alias("latest_value"), status.alias("status"),
    )
