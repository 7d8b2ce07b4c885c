import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.config import FIELDS, FILING_META
from pitline.operators import pit
from pitline.operators.asof import asof_backward
from pitline.operators.snapshots import build_snapshots, reference_violations
from pitline.sources import facts

DAYS = [dt.date(2025, 1, d) for d in (2, 3, 6, 7, 8, 10, 13)]
SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType())]
    + [T.StructField(c, {"fiscal_year": T.IntegerType()}.get(c, T.DateType() if c in ("period_start", "period_end", "filing_date") else T.StringType())) for c in FILING_META]
    + [T.StructField(c, T.DoubleType()) for c in FIELDS]
)


def filing(filed, acc="a", kind="quarterly", form="10-Q", fy=2024, fp="Q3", start=dt.date(2024, 7, 1), end=dt.date(2024, 9, 30), **values):
    meta = dict(fiscal_year=fy, fiscal_period=fp, period_start=start, period_end=end, filing_date=filed, form=form, data_period_type=kind, accession=acc)
    return ("X", *[meta[c] for c in FILING_META], *[values.get(f) for f in FIELDS])


def market(spark, days=DAYS):
    return spark.createDataFrame([("X", d) for d in days], "symbol string, date date")


def states(spark, rows, days=DAYS, streams=("mixed",)):
    obs = spark.createDataFrame(rows, SCHEMA)
    out = pit.attach_states(market(spark, days), obs if streams == ("mixed",) else build_snapshots(obs), streams)
    return out.orderBy("date").collect()


@pytest.mark.parametrize("filed,first", [(dt.date(2025, 1, 2), dt.date(2025, 1, 3)), (dt.date(2025, 1, 4), dt.date(2025, 1, 6)), (dt.date(2025, 1, 8), dt.date(2025, 1, 10))])
def test_filing_acts_from_the_next_session(spark, filed, first):
    got = states(spark, [filing(filed, revenue=5.0)])
    seen = [r.date for r in got if r.fundamental_accession is not None]
    assert seen[0] == first and got[-1].fundamental_effective_date == first
    assert all(r.fundamental_days_since_filing > 0 for r in got if r.fundamental_accession)


def test_filing_before_the_sample_is_truncated(spark):
    got = states(spark, [filing(dt.date(2024, 11, 1))])
    assert got[0].fundamental_effective_date == DAYS[0] and got[0].fundamental_effective_date_basis == "sample_start_truncated"


def test_filing_on_the_last_day_never_acts(spark):
    assert all(r.fundamental_accession is None for r in states(spark, [filing(DAYS[-1])]))


def test_amendment_replaces_whole_row_with_its_nulls(spark):
    rows = [filing(dt.date(2025, 1, 2), revenue=5.0, gross_profit=2.0), filing(dt.date(2025, 1, 6), acc="b", form="10-Q/A", revenue=6.0)]
    got = states(spark, rows)
    assert [r.fundamental_revenue for r in got] == [None, 5.0, 5.0, 6.0, 6.0, 6.0, 6.0]
    assert got[-1].fundamental_gross_profit is None


def test_ytd_never_becomes_a_state(spark):
    rows = [filing(dt.date(2025, 1, 2), kind="ytd", start=dt.date(2024, 1, 1))]
    assert all(r.fundamental_accession is None for r in states(spark, rows))


def test_ties_do_not_depend_on_row_order(spark):
    day = dt.date(2025, 1, 2)
    q = filing(day, acc="q", start=dt.date(2024, 10, 1), end=dt.date(2024, 12, 31), fp="Q4", form="10-K")
    y = filing(day, acc="y", kind="annual", form="10-K", fp="FY", start=dt.date(2024, 1, 1), end=dt.date(2024, 12, 31))
    old = filing(day, acc="z")
    for rows in ([q, y, old], [old, y, q], [y, q, old]):
        assert states(spark, rows)[-1].fundamental_accession == "q"


def test_streams_do_not_clear_each_other(spark):
    rows = [
        filing(dt.date(2025, 1, 2), acc="y", kind="annual", form="10-K", fp="FY", start=dt.date(2023, 1, 1), end=dt.date(2023, 12, 31), total_assets=9.0),
        filing(dt.date(2025, 1, 6), acc="q", revenue=4.0, net_income=1.0),
    ]
    last = states(spark, rows, streams=("q", "fy", "bs"))[-1]
    assert (last.q_accession, last.fy_accession, last.bs_accession, last.q_net_margin) == ("q", "y", "y", 0.25)


def year_ago(**kw):
    return filing(dt.date(2023, 11, 1), acc="p", fy=2023, start=dt.date(2023, 7, 1), end=dt.date(2023, 9, 30), **kw)


@pytest.mark.parametrize(
    "rows,status,growth",
    [
        ([year_ago(revenue=4.0), filing(dt.date(2024, 11, 1), revenue=5.0)], "available", 0.25),
        ([filing(dt.date(2024, 11, 1), revenue=5.0)], "missing_previous_period", None),
        ([year_ago(revenue=0.0), filing(dt.date(2024, 11, 1), revenue=5.0)], "available", None),
        ([filing(dt.date(2023, 11, 1), acc="p", fy=2023, start=dt.date(2024, 4, 1), end=dt.date(2024, 6, 30), revenue=4.0), filing(dt.date(2024, 11, 1), revenue=5.0)],
         "noncomparable_period_dates", None),
        ([year_ago(revenue=4.0), filing(dt.date(2023, 12, 1), acc="r", fy=2023, start=dt.date(2023, 7, 2), end=dt.date(2023, 9, 30), revenue=4.0), filing(dt.date(2024, 11, 1), revenue=5.0)],
         "ambiguous_previous_period", None),
        ([year_ago(revenue=4.0), filing(dt.date(2024, 11, 1), revenue=5.0), filing(dt.date(2024, 11, 1), acc="c", start=dt.date(2024, 7, 2), revenue=5.0)],
         "ambiguous_current_period", None),
        ([filing(dt.date(2024, 12, 1), acc="p", fy=2023, start=dt.date(2023, 7, 1), end=dt.date(2023, 9, 30), revenue=4.0), filing(dt.date(2024, 11, 1), revenue=5.0)],
         "missing_previous_period", None),
    ],
)
def test_prior_year_reference(spark, rows, status, growth):
    obs = spark.createDataFrame(rows, SCHEMA)
    s = build_snapshots(obs)
    r = s.filter("accession = 'a'").first()
    assert (r.yoy_comparison_status, r.q_revenue_growth_yoy) == (status, growth)
    assert reference_violations(s, obs).agg(F.sum("reference_violations") + F.sum("revenue_violations")).first()[0] == 0


def test_asof_strictness(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "v")], "k string, u int, p string")
    loose = [r.p for r in asof_backward(left, right, ["k"], "t", "u", ["p"]).orderBy("t").collect()]
    strict = [r.p for r in asof_backward(left, right, ["k"], "t", "u", ["p"], strict=True).orderBy("t").collect()]
    assert (loose, strict) == ([None, "v", "v"], [None, None, "v"])


FACT = '{{"val": {v}, "start": "{s}", "end": "{e}", "filed": "{f}", "fy": {fy}, "fp": "{fp}", "form": "{form}", "accn": "{a}"}}'


def doc(concepts):
    body = ", ".join(f'"{c}": {{"units": {{"USD": [{", ".join(fs)}]}}}}' for c, fs in concepts.items())
    return f'{{"cik": "1", "entityName": "X", "facts": {{"us-gaap": {{{body}}}}}}}'


def fact(v, s="2024-07-01", e="2024-09-30", f="2024-11-01", fy=2024, fp="Q3", form="10-Q", a="acc"):
    return FACT.format(v=v, s=s, e=e, f=f, fy=fy, fp=fp, form=form, a=a)


def test_facts_documents(spark):
    body = doc(
        {
            "Revenues": [fact(9)],
            "RevenueFromContractWithCustomerExcludingAssessedTax": [fact(5), fact(5), fact(4, s="2023-07-01", e="2023-09-30")],
            "NetIncomeLoss": [fact(1), fact(2)],
            "GrossProfit": [fact(3, f="2024-01-01"), fact(3, s="2024-09-01"), fact(3, form="8-K")],
            "Assets": ['{"val": 7, "end": "2024-09-30", "filed": "2024-11-01", "fy": 2024, "fp": "Q3", "form": "10-Q", "accn": "acc"}'],
        }
    )
    flat = facts.explode_documents(spark.createDataFrame([("X", body)], "symbol string, body string"))
    rows = facts.normalise_facts(flat).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.revenue, r.revenue_concept.startswith("RevenueFrom"), r.net_income, r.total_assets) == (5.0, True, None, 7.0)
    assert (r.duplicates_removed, r.conflicting_fields, r.data_period_type) == (1, 1, "quarterly")
    issues = {(x.field, x.reason) for x in facts.fact_issues(flat).collect()}
    assert issues == {("net_income", "conflicting_values"), ("gross_profit", "invalid_chronology"), ("gross_profit", "unsupported_duration")}
    c = facts.comparative_counts(flat).first()
    assert c.comparative_facts_excluded == 1


def test_filing_rules(spark):
    good = filing(dt.date(2024, 11, 1), operating_cash_flow=3.0, capital_expenditures=1.0, free_cash_flow=2.0)
    bad = filing(dt.date(2024, 8, 1), acc="b", fp="FY", operating_cash_flow=3.0, capital_expenditures=-1.0, free_cash_flow=9.0)
    e = {r.error for r in facts.filing_errors(spark.createDataFrame([good, bad], SCHEMA)).collect()}
    assert e == {"invalid_chronology_or_form", "invalid_period_type", "negative_capex", "fcf_identity"}


def test_redisclosure_uses_the_concept_of_its_own_filing(spark):
    from pitline.config import CONCEPTS

    best, second = CONCEPTS["revenue"][0][:2]
    before, now = (dt.date(2023, 7, 1), dt.date(2023, 9, 30)), (dt.date(2024, 7, 1), dt.date(2024, 9, 30))
    d0, d1 = dt.date(2023, 11, 1), dt.date(2024, 11, 1)
    rows = [
        ("X", second, "USD", *before, 100.0, "a", 2023, "Q3", "10-Q", d0),
        ("X", second, "USD", *before, 103.0, "b", 2024, "Q3", "10-Q", d1),  # restated under the concept that filing a used
        ("X", best, "USD", *before, 999.0, "b", 2024, "Q3", "10-Q", d1),
        ("X", best, "USD", *now, 120.0, "b", 2024, "Q3", "10-Q", d1),
    ]
    flat = spark.createDataFrame(rows, "symbol string, concept string, unit string, start date, end date, val double, accn string, fy int, fp string, form string, filed date")
    observations = facts.normalise_facts(flat)
    got = facts.redisclosed(build_snapshots(observations), observations, flat).filter("metric = 'revenue'").collect()
    assert [(r.concept, r.retained, r.latest_value, r.status) for r in got] == [(second, 100.0, 103.0, "different")]


def test_states_need_one_sort_of_the_sessions(spark):
    """A filing superseded between two sessions is no state, the later one takes effect on the next session, and no session is sorted backwards in time."""
    rows = [filing(dt.date(2025, 1, 3), "a", revenue=1.0), filing(dt.date(2025, 1, 4), "b", revenue=2.0), filing(dt.date(2025, 1, 20), "c", revenue=3.0)]
    got = states(spark, rows)
    assert [r.fundamental_accession for r in got] == [None, None, "b", "b", "b", "b", "b"]
    assert [r.fundamental_effective_date for r in got] == [None, None, *[dt.date(2025, 1, 6)] * 5]
    plan = pit.attach_states(market(spark), spark.createDataFrame(rows, SCHEMA), ("mixed",))._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "_t#" in line for line in plan.splitlines()) == 1 and "DESC" not in plan


def test_comparative_counts_combine_before_the_shuffle(spark):
    """Typed dates are not parsed again, and facts are counted by their filing's period ends, not sorted in a window."""
    day = dt.date(2024, 9, 30)
    rows = [("X", "Assets", "USD", None, end, 1.0, accn, 2024, "Q3", "10-Q", dt.date(2024, 11, 1))
            for accn, end in (("a", day), ("a", day), ("a", dt.date(2023, 9, 30)), ("b", dt.date(2023, 9, 30)))]
    flat = spark.createDataFrame(rows, "symbol string, concept string, unit string, start date, end date, val double, accn string, fy int, fp string, form string, filed date")
    counts = facts.comparative_counts(flat)
    assert [tuple(r) for r in counts.collect()] == [("X", 4, 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RLIKE" not in plan


def test_states_stay_dealt_by_symbol(spark):
    """What groups the matrix by symbol needs no shuffle of its wide rows."""
    market = spark.createDataFrame([("X", dt.date(2024, 1, 2), 1.0)], "symbol string, date date, close double")
    schema = T.StructType([T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DateType() if c.endswith(("_start", "_end", "_date")) else T.IntegerType() if c == "fiscal_year" else T.StringType()) for c in FILING_META], *[T.StructField(f, T.DoubleType()) for f in FIELDS]])
    daily = pit.attach_states(market, spark.createDataFrame([], schema), ("mixed",))
    assert daily.columns[:3] == market.columns
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(daily.groupBy("symbol").agg(F.max("fundamental_revenue"), F.max("close"))) == shuffles(daily)


def test_large_inputs_get_more_partitions(spark):
    from pitline.session import INITIAL, size_shuffles

    try:
        size_shuffles(spark, 100)
        assert spark.conf.get(INITIAL, None) is None
        size_shuffles(spark, 3_000_000)
        assert spark.conf.get(INITIAL) == "15"
        size_shuffles(spark, 100)
        assert spark.conf.get(INITIAL, None) is None
        spark.conf.set(INITIAL, "7")
        size_shuffles(spark, 3_000_000)
        assert spark.conf.get(INITIAL) == "7"  # a choice of the caller
    finally:
        spark.conf.unset(INITIAL)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_wide_rows_of_the_matrix_are_not_shuffled(spark):
    """features and snapshots are computed where bars and quarters lie by symbol; of the states only their filing days meet the bars in a shuffle."""
    from pitline.plans import load_all
    from pitline.plans.registry import Tables

    load_all()
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    t = Tables(spark, "/root/testdata/sf0.001")
    shuffles = lambda df: len(exchanges(df)[0])
    # the join brings the snapshots' plan, which is that of the filings (dealt by symbol already) read twice
    assert shuffles(t.snapshots) == 2 * shuffles(t.filings)
    for frame in (t.daily, t.labelled):
        assert shuffles(frame) == shuffles(t.bars) + 1 + shuffles(t.filings) + shuffles(t.snapshots)
        assert shuffles(frame.groupBy("symbol").agg(F.max("sma_20"), F.max("q_gross_margin"))) == shuffles(frame)


def test_reserved_columns_are_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        pit.state_days(market(spark).withColumn("_filed", F.lit(1)), spark.createDataFrame([], SCHEMA))


def test_states_are_audited_in_one_pass(spark):
    """the audit keeps no copy of the matrix, reads it once for all streams and shuffles none of its rows."""
    from pitline.plans import load_all
    from pitline.plans.registry import REGISTRY, Tables

    load_all()
    found = REGISTRY["running_max_faults"].run(spark, "/root/testdata/sf0.001")
    lines, plan = exchanges(found)
    t = Tables(spark, "/root/testdata/sf0.001")
    assert "InMemoryTableScan" not in plan
    assert len(lines) <= len(exchanges(t.daily)[0]) + len(exchanges(t.filings)[0])
    assert {r.stream for r in found.filter("violations > 0").select("stream").distinct().collect()} == {"q", "fy", "bs"}
