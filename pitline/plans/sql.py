"""DuckDB formulations of the derived views and operators, written independently of the Spark code.

``compose("features", "SELECT ...")`` prefixes the statement with every table expression it needs.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def needs(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", text)]


def compose(select: str) -> str:
    """Collect the table expressions a statement refers to, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in needs(CTES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in needs(select):
        visit(name)
    if not order:
        return select
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    own = re.match(r"\s*WITH\s+", select)
    if own:
        return f"WITH {body},\n{select[own.end():]}"
    return f"WITH {body}\n{select}"


def R(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expr})::DOUBLE * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE"


def fin(expr: str) -> str:
    return f"(CASE WHEN isfinite(({expr})::DOUBLE) THEN ({expr})::DOUBLE END)"


def sdiv(num: str, den: str, growth: bool = False) -> str:
    minus = " - 1.0" if growth else ""
    return fin(f"CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den})::DOUBLE{minus} END")


def corr(x: str, y: str) -> str:
    ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    a, b = f"(CASE WHEN {ok} THEN {x} END)", f"(CASE WHEN {ok} THEN {y} END)"
    return (
        f"(CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) "
        f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END)"
    )


cte(
    "bars",
    """
SELECT symbol, date,
       first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
       max(price) AS high, min(price) AS low,
       last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, *
      FROM lineitem)
GROUP BY symbol, date
""",
)

cte(
    "quarters",
    """
SELECT symbol, fy, fq, count(*)::INTEGER AS n, max(l_quantity) AS qmax, sum(l_quantity) AS units,
       sum(cd)::BIGINT AS cd, sum(ct)::BIGINT AS ct, sum(c)::BIGINT AS revenue,
       (sum(c) FILTER (l_returnflag = 'R'))::BIGINT AS cost_of_revenue,
       (sum(c) FILTER (l_returnflag <> 'R'))::BIGINT AS gross_profit,
       (sum(c) FILTER (l_linenumber <= 3))::BIGINT AS operating_income,
       sum(CASE WHEN l_discount <= 0.05::DOUBLE THEN c ELSE -c END)::BIGINT AS net_income,
       (sum(c) FILTER (l_linestatus = 'F'))::BIGINT AS ocf,
       (sum(c) FILTER (l_quantity >= 46))::BIGINT AS capex,
       (sum(c) FILTER (l_quantity <= 6))::BIGINT AS cash,
       (sum(c) FILTER (l_quantity <= 25))::BIGINT AS cur_assets,
       (sum(c) FILTER (l_quantity > 25 AND l_quantity <= 40))::BIGINT AS cur_liab,
       (sum(c) FILTER (l_quantity > 40 AND l_tax > 0.04::DOUBLE))::BIGINT AS debt
FROM (SELECT 'S' || l_suppkey AS symbol, m // 12 AS fy, (m % 12) // 3 + 1 AS fq,
             CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c,
             CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS cd,
             CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS ct, *
      FROM (SELECT *, (year(l_shipdate) * 12 + month(l_shipdate) - 1 - 9)::INTEGER AS m FROM lineitem))
GROUP BY symbol, fy, fq
""",
)

cte(
    "quarter_dates",
    """
SELECT *, make_date(fy, fq * 3 - 2, 1) AS q_start, last_day(make_date(fy, fq * 3, 1)) AS q_end,
       make_date(fy, 1, 1) AS y_start,
       last_day(make_date(fy, fq * 3, 1)) + (CASE WHEN fq = 4 THEN 45 ELSE 30 END + least(20, n))::INTEGER AS filed,
       symbol || '-' || fy || '-' || (CASE WHEN fq = 4 THEN 'K' ELSE 'Q' || fq END) AS acc,
       revenue AS bs_rev, cd AS bs_cd, n > 16 AS bs_ok
FROM quarters
""",
)

_FLOWS = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "ocf", "capex", "cd", "ct", "units")
_cum = ", ".join(
    f"sum({c}) OVER (PARTITION BY symbol, fy ORDER BY fq ROWS UNBOUNDED PRECEDING) AS {c}" for c in _FLOWS
)
cte("cumulative", f"SELECT * EXCLUDE ({', '.join(_FLOWS)}), {_cum} FROM quarter_dates")


def _statement(src: str, fp: str, start: str, filed: str, form: str, kind: str, acc: str, where: str, amended=False) -> str:
    def m(e: str) -> str:
        return f"({e})::DOUBLE / 100.0::DOUBLE"

    def bs(e: str) -> str:
        return "NULL::DOUBLE" if amended else f"CASE WHEN bs_ok THEN {m(e)} END"

    rev = "revenue + ct" if amended else "revenue"
    oi = "operating_income - cd" if amended else "operating_income"
    return f"""
SELECT symbol, fy::INTEGER AS fiscal_year, {fp} AS fiscal_period, {start} AS period_start, q_end AS period_end,
  {filed} AS filing_date, {form} AS form, '{kind}' AS data_period_type, {acc} AS accession,
  {m(rev)} AS revenue, {m('cost_of_revenue')} AS cost_of_revenue, {m('gross_profit')} AS gross_profit,
  {m(oi)} AS operating_income, {m('net_income')} AS net_income, {m('ct')} AS research_and_development,
  {m('cd')} AS selling_general_administrative, {m('net_income')} / units AS eps,
  {bs('cash')} AS cash_and_cash_equivalents, {bs('bs_rev * 3')} AS total_assets,
  {bs('bs_rev + bs_cd')} AS total_liabilities, {bs('bs_rev * 2 - bs_cd')} AS stockholders_equity,
  {bs('cur_assets')} AS current_assets, {bs('cur_liab')} AS current_liabilities, {bs('debt')} AS long_term_debt,
  {m('ocf')} AS operating_cash_flow, {m('capex')} AS capital_expenditures, {m('-capex')} AS investing_cash_flow,
  {m('ocf - revenue')} AS financing_cash_flow, {m('ocf')} - {m('capex')} AS free_cash_flow
FROM {src} WHERE {where}"""


cte(
    "filings",
    " UNION ALL ".join(
        (
            _statement("quarter_dates", "'Q' || fq", "q_start", "filed", "CASE WHEN fq = 4 THEN '10-K' ELSE '10-Q' END", "quarterly", "acc", "true"),
            _statement("quarter_dates", "'Q' || fq", "CASE WHEN n >= 26 THEN q_start + 1 ELSE q_start END", "filed + 180", "'10-Q/A'", "quarterly", "acc || '-A'", "fq < 4 AND qmax = 50", True),
            _statement("cumulative", "'Q' || fq", "y_start", "filed", "'10-Q'", "ytd", "acc", "fq IN (2, 3)"),
            _statement("cumulative", "'FY'", "y_start", "filed", "'10-K'", "annual", "acc", "fq = 4"),
        )
    ),
)
