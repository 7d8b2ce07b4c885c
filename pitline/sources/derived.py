"""Bars, filings and facts derived from the order-line table.

A supplier plays the listed company: each order line is a trade print, each calendar quarter of lines
(shifted back nine months) is a reporting period. Both views grow with the table and both are grouped
with map-side combine, so a supplier holding a third of the lines costs no more than its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import CONCEPTS
from pitline.functions.keys import packed_key

LAG_MONTHS = 9
PRINT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("bigint")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def print_number() -> Column:
    """PRINT_ORDER as one number: prices in cents, quantities whole, both as the table has them."""
    order, line, part, price, quantity = (F.col(c) for c in PRINT_ORDER)
    return packed_key([(order, 14), (line, 2), (part, 11), (cents(price), 9), (quantity.cast("bigint"), 2)])


def prints(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        print_number().alias("seq"),
    )


def derive_bars(lines: DataFrame) -> DataFrame:
    """One bar per symbol and day; first/last print by a total order of fixed width, all in one partial hash aggregate."""
    return (
        prints(lines)
        .groupBy("symbol", "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").alias("volume"),
        )
    )


def _quarters(lines: DataFrame) -> DataFrame:
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - LAG_MONTHS
    fy = F.floor(month / 12).cast("int")
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    base = lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        fy.alias("fy"),
        (F.floor((month - fy * 12) / 3) + 1).cast("int").alias("fq"),
        "l_quantity",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_discount",
        "l_tax",
        cents(ext).alias("c"),
        cents(ext * disc).alias("cd"),
        cents(ext * tax).alias("ct"),
    )
    q, c = F.col("l_quantity"), F.col("c")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, c))

    return base.groupBy("symbol", "fy", "fq").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max("l_quantity").alias("qmax"),
        F.min("l_quantity").alias("qmin"),
        F.sum("l_quantity").alias("units"),
        F.sum("cd").alias("cd"),
        F.sum("ct").alias("ct"),
        F.sum("c").alias("revenue"),
        total(F.col("l_returnflag") == "R").alias("cost_of_revenue"),
        total(F.col("l_returnflag") != "R").alias("gross_profit"),
        total(F.col("l_linenumber") <= 3).alias("operating_income"),
        F.sum(F.when(F.col("l_discount") <= 0.05, c).otherwise(-c)).alias("net_income"),
        total(F.col("l_linestatus") == "F").alias("operating_cash_flow"),
        total(q >= 46).alias("capital_expenditures"),
        total(q <= 6).alias("cash"),
        total(q <= 25).alias("cur_assets"),
        total((q > 25) & (q <= 40)).alias("cur_liab"),
        total((q > 40) & (F.col("l_tax") > 0.04)).alias("debt"),
    )


_FLOWS = (
    "revenue",
    "cost_of_revenue",
    "gross_profit",
    "operating_income",
    "net_income",
    "operating_cash_flow",
    "capital_expenditures",
    "cd",
    "ct",
)


def _statement(prefix: str, amended: bool) -> list[Column]:
    """Financial fields in currency units from summed cents; the prefix picks year-to-date flows."""

    def money(c: Column) -> Column:
        return c / F.lit(100.0)

    def flow(n: str) -> Column:
        return F.col(f"{prefix}{n}")

    revenue = flow("revenue") + flow("ct") if amended else flow("revenue")
    oi = flow("operating_income") - flow("cd") if amended else flow("operating_income")
    disclosed = F.lit(False) if amended else F.col("n") > 16

    def bs(c: Column) -> Column:
        return F.when(disclosed, money(c))

    rev, cd = F.col("revenue"), F.col("cd")
    return [
        money(revenue).alias("revenue"),
        money(flow("cost_of_revenue")).alias("cost_of_revenue"),
        money(flow("gross_profit")).alias("gross_profit"),
        money(oi).alias("operating_income"),
        money(flow("net_income")).alias("net_income"),
        money(flow("ct")).alias("research_and_development"),
        money(flow("cd")).alias("selling_general_administrative"),
        (money(flow("net_income")) / flow("units")).alias("eps"),
        bs(F.col("cash")).alias("cash_and_cash_equivalents"),
        bs(rev * 3).alias("total_assets"),
        bs(rev + cd).alias("total_liabilities"),
        bs(rev * 2 - cd).alias("stockholders_equity"),
        bs(F.col("cur_assets")).alias("current_assets"),
        bs(F.col("cur_liab")).alias("current_liabilities"),
        bs(F.col("debt")).alias("long_term_debt"),
        money(flow("operating_cash_flow")).alias("operating_cash_flow"),
        money(flow("capital_expenditures")).alias("capital_expenditures"),
        money(-flow("capital_expenditures")).alias("investing_cash_flow"),
        money(flow("operating_cash_flow") - flow("revenue")).alias("financing_cash_flow"),
        (money(flow("operating_cash_flow")) - money(flow("capital_expenditures"))).alias("free_cash_flow"),
    ]


def derive_filings(lines: DataFrame) -> DataFrame:
    """Quarterly, year-to-date, annual and amended observations, one wide row each."""
    q = _quarters(lines)
    q = q.withColumns(
        {
            "q_start": F.make_date("fy", F.col("fq") * 3 - 2, F.lit(1)),
            "q_end": F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1))),
        }
    )
    # at most one row a quarter: dealt by symbol once, for all that is derived from the filings of a symbol
    q = q.repartition("symbol")
    # at most four rows per (symbol, fy)
    year = W.partitionBy("symbol", "fy").orderBy("fq").rowsBetween(W.unboundedPreceding, 0)
    q = q.withColumns({f"y_{c}": F.sum(c).over(year) for c in (*_FLOWS, "units")})
    delay = F.least(F.lit(20), F.col("n"))
    filed = F.when(F.col("fq") == 4, F.date_add("q_end", delay + 45)).otherwise(F.date_add("q_end", delay + 30))
    accession = F.concat_ws(
        "-", "symbol", F.col("fy").cast("string"), F.when(F.col("fq") == 4, "K").otherwise(F.concat(F.lit("Q"), "fq"))
    )
    q = q.withColumns({"filed": filed, "acc": accession, "year_start": F.make_date("fy", F.lit(1), F.lit(1))})
    label = F.concat(F.lit("Q"), F.col("fq").cast("string"))
    base_form = F.when(F.col("fq") == 4, "10-K").otherwise("10-Q")

    def row(fp: Column, start: Column, filed: Column, form: Column, kind: str, acc: Column, prefix: str = "", amended=False):
        return F.struct(
            F.col("fy").alias("fiscal_year"),
            fp.alias("fiscal_period"),
            start.alias("period_start"),
            F.col("q_end").alias("period_end"),
            filed.alias("filing_date"),
            form.alias("form"),
            F.lit(kind).alias("data_period_type"),
            acc.alias("accession"),
            *_statement(prefix, amended),
        )

    start, done, acc = F.col("q_start"), F.col("filed"), F.col("acc")
    shifted = F.when(F.col("n") >= 26, F.date_add("q_start", 1)).otherwise(start)
    rows = F.array(
        row(label, start, done, base_form, "quarterly", acc),
        F.when(
            (F.col("fq") < 4) & (F.col("qmax") == 50),
            row(label, shifted, F.date_add("filed", 180), F.lit("10-Q/A"), "quarterly", F.concat("acc", F.lit("-A")), amended=True),
        ),
        F.when(F.col("fq").isin(2, 3), row(label, F.col("year_start"), done, F.lit("10-Q"), "ytd", acc, "y_")),
        F.when(F.col("fq") == 4, row(F.lit("FY"), F.col("year_start"), done, F.lit("10-K"), "annual", acc, "y_")),
    )
    return q.select("symbol", F.inline(F.array_compact(rows)))


def revenue_concept(fiscal_year: str) -> Column:
    """Revenue is disclosed under its second concept in odd fiscal years."""
    return F.when(F.col(fiscal_year) % 2 == 1, CONCEPTS["revenue"][0][1]).otherwise(CONCEPTS["revenue"][0][0])


def derive_facts(filings: DataFrame) -> DataFrame:
    """Long disclosure facts behind the observations, including the blemishes an ingest must handle.

    Adds a lower-priority revenue concept, the prior-year comparative, an identical duplicate, a
    conflicting net income, an unsupported form and a fact filed before its period ended.
    """
    quarter = (F.col("form") == "10-Q") & (F.col("data_period_type") == "quarterly")
    # at most one original filing per fiscal year in each (symbol, period label)
    w = W.partitionBy("symbol", "fiscal_period", "form", "data_period_type").orderBy("fiscal_year")
    last_year = F.lag(F.struct("fiscal_year", "period_start", "period_end", F.col("revenue").alias("val"))).over(w)
    base = filings.drop("free_cash_flow").withColumn("_b", F.when(quarter, last_year))
    fp = F.when(F.col("form") == "10-K", "FY").otherwise(F.col("fiscal_period"))
    instant_row = ~F.col("data_period_type").isin("annual", "ytd")

    def fact(concept, unit, val, start=F.col("period_start"), end=F.col("period_end"), filed=F.col("filing_date"), form=F.col("form")):
        return F.struct(
            F.lit(concept).alias("concept"), F.lit(unit).alias("unit"), start.alias("start"), end.alias("end"),
            val.alias("val"), F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"), fp.alias("fp"),
            form.alias("form"), filed.alias("filed"),
        )

    items: list[Column] = []
    for field, (concepts, unit, basis) in CONCEPTS.items():
        here = F.col(field).isNotNull()
        if basis == "instant":  # disclosed once per filing although two durations share its end
            items.append(F.when(here & instant_row, fact(concepts[0], unit, F.col(field), start=F.lit(None).cast("date"))))
        else:
            items.append(F.when(here, fact(revenue_concept("fiscal_year") if field == "revenue" else concepts[0], unit, F.col(field))))
    revenue, best = F.col("revenue"), revenue_concept("fiscal_year")
    before = F.col("_b.val")
    items += [
        F.when(revenue.isNotNull(), fact("Revenues", "USD", revenue + 1)),
        F.when(F.col("gross_profit") > 400000, fact("GrossProfit", "USD", F.col("gross_profit"))),
        F.when(F.col("net_income") < 0, fact("NetIncomeLoss", "USD", F.col("net_income") - 1)),
        F.when(F.col("form") == "10-Q/A", fact(best, "USD", revenue, form=F.lit("8-K"))),
        F.when(F.col("form") == "10-K", fact(best, "USD", revenue, filed=F.date_sub("period_end", 1))),
        F.when(
            F.col("_b.fiscal_year") == F.col("fiscal_year") - 1,
            fact(
                revenue_concept("_b.fiscal_year"), "USD", F.when(before > 600000, before + 5).otherwise(before),
                start=F.col("_b.period_start"), end=F.col("_b.period_end"),
            ),
        ),
    ]
    return base.select("symbol", F.inline(F.array_compact(F.array(*items))))

