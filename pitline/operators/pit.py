"""Point-in-time states: independent quarterly, annual, balance-sheet and mixed streams per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import BALANCE_FIELDS, FIELDS, FILING_KEY, FILING_META, STATE_KEY, STREAM_FEATURES
from pitline.functions.text import is_amended
from pitline.operators.asof import next_after
from pitline.operators.snapshots import PROVENANCE, eligible

AGES = ("days_since_filing", "days_since_effective_date")


def stream_member(stream: str) -> Column:
    """Which observations may become the state of a stream."""
    basis = F.col("data_period_type")
    if stream == "q":
        return basis == "quarterly"
    if stream == "fy":
        return basis == "annual"
    if stream == "bs":
        return F.coalesce(*[F.col(c) for c in BALANCE_FIELDS]).isNotNull()
    return F.lit(True)


def stream_payload(stream: str) -> tuple[str, ...]:
    if stream == "bs":
        return (*STREAM_FEATURES["bs"], *BALANCE_FIELDS)
    if stream in ("q", "fy"):
        return (*STREAM_FEATURES[stream], *PROVENANCE)
    return FIELDS


def tie_order() -> Column:
    """Among observations filed the same day: later period, standalone quarter, amendment, start, accession."""
    return F.struct(
        F.col("period_end"),
        (F.col("data_period_type") == "quarterly").cast("int").alias("quarter"),
        is_amended("form").alias("amended"),
        F.col("period_start"),
        F.col("accession"),
    )


def daily_winners(observations: DataFrame, streams: tuple[str, ...]) -> DataFrame:
    """One row per symbol and filing day holding each stream's winning whole observation."""
    aggs = []
    for s in streams:
        row = F.struct(*FILING_META, *stream_payload(s))
        aggs.append(F.max_by(row, F.when(stream_member(s), tie_order())).alias(s))
    return eligible(observations).groupBy("symbol", "filing_date").agg(*aggs)


def day_columns(streams: tuple[str, ...] = ("q", "fy", "bs")) -> tuple[str, ...]:
    """The columns that `state_days` adds."""
    return ("_first", "_filed", *[f"_eff_{s}" for s in streams])


def state_days(market: DataFrame, observations: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Every market row with the days that `join_states` needs: the symbol's first session, the last day strictly before the row's on which
    a stream was filed, and each stream's effective date.

    Market rows and filing days meet in one window per symbol; of filings only their days take part. A filing sorts behind the session of its
    own day, so it acts from the next observed session on; that session is its effective date.
    """
    clash = {"_t", "_k", *day_columns(streams)} & set(market.columns)
    if clash:
        raise ValueError(f"reserved columns present: {sorted(clash)}")
    days = eligible(observations).groupBy("symbol", F.col("filing_date").alias("_t")).agg(*[F.max(stream_member(s)).alias(f"_has_{s}") for s in streams])
    days = days.filter(F.greatest(*[F.col(f"_has_{s}") for s in streams], F.lit(False))).withColumn("_k", F.lit(1))
    order = W.partitionBy("symbol").orderBy("_t", "_k")
    past = order.rowsBetween(W.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(past)
    u = market.withColumns({"_t": F.col("date"), "_k": F.lit(0)}).unionByName(days, allowMissingColumns=True)
    u = u.withColumns(
        {
            "_first": F.min(F.when(F.col("_k") == 0, F.col("_t"))).over(past),
            "_filed": latest(F.when(F.col("_k") == 1, F.col("_t"))),
            **{f"_day_{s}": latest(F.when(F.col(f"_has_{s}"), F.col("_t"))) for s in streams},
        }
    ).filter(F.col("_k") == 0)
    # one sort serves all windows: a filing that is superseded before the next session is no session's state, so a state's effective
    # date is the first session that has it
    day = {s: F.col(f"_day_{s}") for s in streams}
    u = u.withColumns({f"_new_{s}": F.when(~day[s].eqNullSafe(F.lag(day[s]).over(order)), F.col("_t")) for s in streams})
    u = u.withColumns({f"_eff_{s}": F.when(day[s].isNotNull(), latest(f"_new_{s}")) for s in streams})
    # the keys of the window themselves, so that the frame stays dealt and sorted by symbol and date for what reads it
    return u.select(*[F.col("_t").alias("date") if c == "date" else F.col(c) for c in market.columns], *day_columns(streams))


def join_states(market: DataFrame, observations: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Rows with the columns of `state_days`, which give way to the whole observation of each stream.

    The states of a symbol's filing days are a hash table that the rows stream past: they are neither shuffled nor sorted again.
    """
    columns = [c for c in market.columns if c not in day_columns(streams)]
    clash = {f"{_prefix(s)}_{c}" for s in streams for c in state_columns(s)} & set(columns)
    if clash:
        raise ValueError(f"market columns collide with state columns: {sorted(clash)}")
    so_far = W.partitionBy("symbol").orderBy("filing_date").rowsBetween(W.unboundedPreceding, 0)
    held = daily_winners(observations, streams).select(
        "symbol", F.col("filing_date").alias("_filed"), *[F.last(s, ignorenulls=True).over(so_far).alias(s) for s in streams]
    )
    u = market.join(held.hint("shuffle_hash"), ["symbol", "_filed"], "left")
    cols: list[Column] = []
    for s in streams:
        p = _prefix(s)
        filed, eff = F.col(f"{s}.filing_date"), F.col(f"_eff_{s}")
        truncated, basis = effective_semantics(filed, eff, F.col("_first"))
        cols += [F.col(f"{s}.{c}").alias(f"{p}_{c}") for c in FILING_META]
        cols += [
            eff.alias(f"{p}_effective_date"),
            truncated.alias(f"{p}_effective_date_is_sample_truncated"),
            basis.alias(f"{p}_effective_date_basis"),
            F.datediff(F.col("date"), filed).alias(f"{p}_days_since_filing"),
            F.datediff(F.col("date"), eff).alias(f"{p}_days_since_effective_date"),
        ]
        for c in stream_payload(s):
            cols.append(F.col(f"{s}.{c}").alias(c if c in STREAM_FEATURES.get(s, ()) else f"{p}_{c}"))
    return u.select(*columns, *cols)


def attach_states(market: DataFrame, observations: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Every market row with the latest observation of each stream filed strictly before it.

    A state moves as a whole with its NULLs and no stream clears another. Windows over the market rows are best computed between the two steps.
    """
    return join_states(state_days(market, observations, streams), observations, streams)


def _prefix(stream: str) -> str:
    return "fundamental" if stream == "mixed" else stream


def state_columns(stream: str) -> tuple[str, ...]:
    extra = tuple(c for c in stream_payload(stream) if c not in STREAM_FEATURES.get(stream, ()))
    base = ("effective_date", "effective_date_is_sample_truncated", "effective_date_basis", *AGES)
    return (*FILING_META, *base, *extra)


def effective_semantics(filed: Column, effective: Column, first_session: Column) -> tuple[Column, Column]:
    """Whether a filing predates the first session, and how its effective date came about."""
    truncated = filed < first_session
    basis = (
        F.when(filed.isNull(), None)
        .when(effective.isNull(), "no_observed_next_session")
        .when(truncated, "sample_start_truncated")
        .otherwise("observed_next_session")
    )
    return truncated, basis


def with_effective_dates(snapshots: DataFrame, sessions: DataFrame) -> DataFrame:
    """Snapshots with the next observed session after filing and its basis."""
    first = sessions.groupBy("symbol").agg(F.min("date").alias("_first"))
    df = next_after(snapshots, sessions, "symbol", "filing_date", "date", "effective_date").join(first, "symbol", "left")
    truncated, basis = effective_semantics(F.col("filing_date"), F.col("effective_date"), F.col("_first"))
    return df.withColumns({"effective_date_is_sample_truncated": truncated, "effective_date_basis": basis}).drop("_first")


def latest_per_effective_date(observations: DataFrame, stream: str = "mixed") -> DataFrame:
    """One observation per symbol and effective date: the greatest by filing day, then tie order."""
    order = F.struct(F.col("filing_date"), tie_order())
    keep = [c for c in observations.columns if c not in ("symbol", "effective_date")]
    return (
        eligible(observations)
        .filter(F.col("effective_date").isNotNull() & stream_member(stream))
        .groupBy("symbol", "effective_date")
        .agg(F.max_by(F.struct(*keep), order).alias("o"))
        .select("symbol", "effective_date", "o.*")
    )


def mark_selected(snapshots: DataFrame, daily: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Flags telling which snapshots ever became a daily state of each stream."""
    out = snapshots
    for s in streams:
        p = _prefix(s)
        used = (
            daily.filter(F.col(f"{p}_accession").isNotNull())
            .select("symbol", *[F.col(f"{p}_{c}").alias(c) for c in FILING_KEY])
            .distinct()
            .withColumn(f"selected_for_{s}", F.lit(True))
        )
        out = out.join(used, ["symbol", *FILING_KEY], "left").withColumn(
            f"selected_for_{s}", F.coalesce(f"selected_for_{s}", F.lit(False))
        )
    any_stream = F.lit(False)
    for s in streams:
        any_stream = any_stream | F.col(f"selected_for_{s}")
    return out.withColumn("selected_for_daily", any_stream)


def running_max_states(market: DataFrame, observations: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Second formulation: the running maximum of (filing day, tie order) over all observations, as the column `oracle_<stream>` beside the market's."""
    key = F.struct(F.col("filing_date").alias("filed"), tie_order().alias("tie"), F.struct(*FILING_META).alias("row"))
    # the same maximum per day first, so the window sees at most one row per filing day
    best = [F.max(F.when(stream_member(s), key)).alias(f"oracle_{s}") for s in streams]
    days = eligible(observations).groupBy("symbol", F.col("filing_date").alias("_t")).agg(*best).withColumn("_k", F.lit(1))
    rows = market.withColumns({"_t": F.col("date"), "_k": F.lit(0)})
    w = W.partitionBy("symbol").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    u = rows.unionByName(days, allowMissingColumns=True).withColumns({f"oracle_{s}": F.max(f"oracle_{s}").over(w) for s in streams})
    return u.filter(F.col("_k") == 0).select(*market.columns, *[F.col(f"oracle_{s}.row").alias(f"oracle_{s}") for s in streams])


def state_violations(daily: DataFrame, observations: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Sessions whose attached state differs from the running maximum; daily is read once for all streams and, dealt by symbol, not shuffled."""
    keys = daily.select("symbol", "date", *[f"{_prefix(s)}_{c}" for s in streams for c in FILING_META])
    both = running_max_states(keys, observations, streams)
    rows = []
    for s in streams:
        bad = F.lit(False)
        for c in FILING_META:
            bad = bad | ~F.col(f"{_prefix(s)}_{c}").eqNullSafe(F.col(f"oracle_{s}.{c}"))
        rows.append(F.struct(F.lit(s).alias("stream"), F.count(F.lit(1)).alias("sessions_checked"), F.count_if(bad).alias("violations")))
    return both.groupBy("symbol").agg(F.array(*rows).alias("r")).select("symbol", F.inline("r"))


def timing_violations(daily: DataFrame, streams: tuple[str, ...] = ("q", "fy", "bs")) -> DataFrame:
    """Counts that must be zero: filings not before the session, future effective dates, negative ages,
    a stream holding the wrong basis, a growth reference filed after the state."""
    rows = []
    for s in streams:
        p = _prefix(s)

        def c(name: str, p: str = p) -> Column:
            return F.col(f"{p}_{name}")

        wrong = {"q": c("data_period_type") != "quarterly", "fy": c("data_period_type") != "annual"}.get(s, F.lit(False))
        late = c("yoy_reference_filing_date") > c("filing_date") if s in ("q", "fy") else F.lit(False)
        rows.append(
            F.struct(
                F.lit(s).alias("stream"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(c("accession").isNull()).alias("unmatched_rows"),
                F.count_if(c("filing_date") >= F.col("date")).alias("filing_not_before_session"),
                F.count_if(c("effective_date") > F.col("date")).alias("future_effective_date"),
                F.count_if((c("days_since_filing") < 0) | (c("days_since_effective_date") < 0)).alias("negative_age"),
                F.count_if(wrong).alias("wrong_basis"),
                F.count_if(late).alias("reference_after_state"),
                F.count_if(c("effective_date_is_sample_truncated")).alias("sample_truncated_rows"),
            )
        )
    return daily.groupBy("symbol").agg(F.array(*rows).alias("r")).select("symbol", F.inline("r"))


def state_changes(daily: DataFrame, stream: str) -> DataFrame:
    """Whether a session's state identity differs from the previous session's; NULL while unknown."""
    p = _prefix(stream)
    w = W.partitionBy("symbol").orderBy("date")
    ident = F.struct(*[f"{p}_{c}" for c in STATE_KEY])
    known = F.col(f"{p}_accession").isNotNull()
    prev_known = F.lag(known).over(w)
    return daily.select(
        "symbol",
        "date",
        F.when(known, F.to_json(ident)).alias("state_identifier"),
        F.lag("date").over(w).alias("previous_date"),
        F.when(known & prev_known, ident != F.lag(ident).over(w)).alias("state_changed"),
    )


def run_summary(daily: DataFrame, filings: DataFrame) -> DataFrame:
    """Counts that describe one alignment run per symbol."""
    first = daily.groupBy("symbol").agg(
        F.min("date").alias("first_session"),
        F.count(F.lit(1)).alias("market_rows"),
        F.count_if(F.col("fundamental_accession").isNull()).alias("unmatched_rows"),
        F.count_distinct("fundamental_accession").alias("matched_accessions"),
    )
    repeated = (
        filings.groupBy("symbol", "period_end", "data_period_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("symbol")
        .agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_period_observations"))
    )
    counted = (
        filings.join(first.select("symbol", "first_session"), "symbol")
        .groupBy("symbol")
        .agg(
            F.count_if(F.col("filing_date") < F.col("first_session")).alias("pre_window_observations"),
            F.count_if(F.col("data_period_type") == "ytd").alias("excluded_ytd"),
            F.count_if(is_amended("form") == 1).alias("amended_observations"),
        )
    )
    return first.join(counted, "symbol").join(repeated, "symbol")


def research_slice(daily: DataFrame, start, end) -> DataFrame:
    """Restrict to a window after all trailing and as-of work has seen the full history."""
    return daily.filter(F.col("date").between(F.lit(start), F.lit(end)))
