"""Purged chronological splits and calendar-quarter walk-forward folds.

Every count and boundary belongs to one symbol and comes from windows on the symbol's own sessions, so
the whole manifest is built on one partitioning without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.config import HORIZONS, PRIMARY_HORIZON, PRIMARY_TARGET, SplitConfig, WalkForwardConfig
from pitline.functions.dates import quarter_index
from pitline.functions.windows import ordinal

MANIFEST = (
    "symbol", "date", "target_name", "fold", "partition", "pre_test_gap", "nominal_role", "role", "is_usable", "exclusion_reason",
    "target_entry_date", "target_exit_date", "evaluation_start_date", "target_missing", "evaluation_locked",
    "final_train_candidate", "final_train_purged", "final_train_usable",
)


def history_complete(test_start: Column) -> Column:
    """All horizons labelled and realised before the test starts."""
    ok = F.col("target_entry_date").isNotNull()
    for h in HORIZONS:
        ok = ok & F.col(f"forward_return_{h}d").isNotNull() & (F.col(f"target_exit_date_{h}d") < test_start)
    return F.coalesce(ok, F.lit(False))


def layout(labels: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Per session: its block (development, test, tail), gap flag, validation fold and fold start dates."""
    s = W.partitionBy("symbol")
    need = cfg.folds * cfg.validation_size
    labelled = F.col(PRIMARY_TARGET).isNotNull()
    df = labels.withColumns({"pos": ordinal(), "_labelled": labelled})
    df = df.withColumn("n_labelled", F.count_if("_labelled").over(s))
    df = df.withColumn(
        "partition",
        F.when(~F.col("_labelled"), "unlabeled_tail")
        .when(F.col("pos") >= F.col("n_labelled") - cfg.test_size, "final_test")
        .otherwise("development"),
    )
    df = df.withColumn("test_start", F.min(F.when(F.col("partition") == "final_test", F.col("date"))).over(s))
    df = df.withColumn("_eligible", (F.col("partition") == "development") & history_complete(F.col("test_start")))
    back = W.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns(
        {
            "_from_end": F.when(F.col("_eligible"), F.count_if("_eligible").over(back)),
            "_n_eligible": F.count_if("_eligible").over(s),
            "_last_eligible": F.max(F.when(F.col("_eligible"), F.col("pos"))).over(s),
        }
    )
    block = F.floor((need - F.col("_from_end")) / cfg.validation_size).cast("int") + 1
    df = df.withColumn("validation_fold", F.when(F.col("_from_end") <= need, block))
    starts = [
        F.struct(*[F.min(F.when(F.col("validation_fold") == i, F.col(c))).over(s).alias(c) for c in ("pos", "date")])
        for i in range(1, cfg.folds + 1)
    ]
    test = F.struct(*[F.min(F.when(F.col("partition") == "final_test", F.col(c))).over(s).alias(c) for c in ("pos", "date")])
    df = df.withColumns({"starts": F.array(*starts, test), "pre_test_gap": (F.col("partition") == "development") & (F.col("pos") > F.col("_last_eligible"))})
    enough = (F.col("n_labelled") >= cfg.required_rows) & (F.col("_n_eligible") >= need) & (F.col("starts")[0]["pos"] >= cfg.min_train)
    return df.withColumn("sufficient", F.coalesce(enough, F.lit(False)))


def readiness(lay: DataFrame) -> DataFrame:
    """Which symbols carry enough labelled history for the split."""
    return lay.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.max("n_labelled").alias("labelled"),
        F.max("_n_eligible").alias("eligible"),
        F.max("sufficient").alias("sufficient"),
    )


def fold_names(cfg: SplitConfig) -> list[str]:
    return [*[f"cv_{i}" for i in range(1, cfg.folds + 1)], "final"]


def build_manifest(labels: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """One row per session, target and fold with its role; symbols without enough history are left to ``readiness``."""
    lay = layout(labels, cfg).filter("sufficient")
    folds = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(i).alias("i")) for i, n in enumerate(fold_names(cfg))])
    targets = F.array(
        *[
            F.struct(
                F.lit(f"forward_return_{h}d").alias("target_name"),
                F.col(f"target_exit_date_{h}d").alias("target_exit_date"),
                F.col(f"forward_return_{h}d").isNull().alias("target_missing"),
            )
            for h in HORIZONS
        ]
    )
    x = lay.select("*", F.explode(folds).alias("f")).select("*", F.explode(targets).alias("t")).select("*", "f.*", "t.*")
    final = F.col("fold") == "final"
    start = F.get(F.col("starts"), F.col("i"))
    tail = F.col("partition") == "unlabeled_tail"
    evaluated = F.when(final, F.col("partition") == "final_test").otherwise(
        F.coalesce(F.col("validation_fold") == F.col("i") + 1, F.lit(False))
    )
    candidate = (F.col("partition") == "development") & (F.col("pos") < start["pos"])
    nominal = (
        F.when(tail, "unlabeled_tail")
        .when(~final & F.col("pre_test_gap"), "pre_test_gap")
        .when(candidate, "train")
        .when(evaluated, F.when(final, "final_test").otherwise("validation"))
        .otherwise("not_candidate")
    )
    x = x.withColumns({"evaluation_start_date": start["date"], "nominal_role": nominal})
    matured = F.coalesce(~F.col("target_missing") & (F.col("target_exit_date") < F.col("evaluation_start_date")), F.lit(False))
    role = (
        F.when(F.col("nominal_role").isin("unlabeled_tail", "pre_test_gap"), F.col("nominal_role"))
        .when(F.col("target_missing"), "target_missing")
        .when((F.col("nominal_role") == "train") & ~matured, "purged")
        .otherwise(F.col("nominal_role"))
    )
    x = x.withColumn("role", role)
    reason = (
        F.when(F.col("role") == "unlabeled_tail", "primary_unlabeled_tail")
        .when(F.col("role") == "pre_test_gap", "reserved_for_registered_validation_label_maturation")
        .when(F.col("role") == "target_missing", "target_missing")
        .when(F.col("role") == "purged", "target_exit_at_or_after_evaluation_start")
        .when(F.col("role") == "not_candidate", "outside_this_training_and_evaluation_block")
        .otherwise("")
    )
    return x.withColumns(
        {
            "is_usable": F.col("role").isin("train", "validation", "final_test"),
            "exclusion_reason": reason,
            "evaluation_locked": F.col("partition") == "final_test",
            "final_train_candidate": final & (F.col("nominal_role") == "train"),
            "final_train_purged": final & (F.col("role") == "purged"),
            "final_train_usable": final & (F.col("role") == "train"),
        }
    ).select(*MANIFEST)


def fold_summaries(manifest: DataFrame) -> DataFrame:
    """Counts and date geometry of every symbol, target and fold."""
    cand, train = F.col("nominal_role") == "train", F.col("role") == "train"
    ev = F.col("nominal_role").isin("validation", "final_test")
    test_start = F.min(F.when(F.col("partition") == "final_test", F.col("date")))

    def d(cond: Column, c: str = "date") -> Column:
        return F.when(cond, F.col(c))

    m = manifest.withColumn("_test_start", test_start.over(W.partitionBy("symbol")))
    reach = ev & ~F.col("target_missing") & (F.col("target_exit_date") >= F.col("_test_start")) & (F.col("fold") != "final")
    return m.groupBy("symbol", "target_name", "fold").agg(
        F.min(d(cand)).alias("train_start_date"),
        F.max(d(cand)).alias("train_end_date_nominal"),
        F.max(d(train)).alias("train_end_date_effective"),
        F.count_if(cand).alias("train_count_nominal"),
        F.count_if(train).alias("train_count_effective"),
        F.count_if(cand & (F.col("role") == "purged")).alias("purged_count"),
        F.count_if(cand & (F.col("role") == "target_missing")).alias("train_missing_target_count"),
        F.min(d(ev)).alias("validation_start_date"),
        F.max(d(ev)).alias("validation_end_date"),
        F.count_if(ev).alias("validation_count"),
        F.count_if(ev & F.col("is_usable")).alias("validation_count_effective"),
        F.count_if(ev & F.col("target_missing")).alias("evaluation_missing_target_count"),
        F.max(d(ev, "target_exit_date")).alias("max_evaluation_target_exit_date"),
        F.count_if("pre_test_gap").alias("pre_test_gap_rows"),
        F.count_if(reach).alias("validation_labels_reaching_final_test"),
    )


def evaluation_windows(labels: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Per symbol and fold the dates its evaluation must span, from label dates and sizes alone, and where the gap before the test begins.

    The test is the last test_size labelled sessions. Development sessions whose labels all end before it, counted back from the
    last one, give each validation fold its block.
    """
    back = W.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0)
    labelled = F.col(PRIMARY_TARGET).isNotNull()
    df = labels.withColumn("_k", F.when(labelled, F.count_if(labelled).over(back)))
    df = df.withColumn("_test", F.min(F.when(F.col("_k") <= cfg.test_size, F.col("date"))).over(W.partitionBy("symbol")))
    done = F.coalesce(labelled & (F.col("date") < F.col("_test")) & history_complete(F.col("_test")), F.lit(False))
    df = df.withColumn("_r", F.when(done, F.count_if(done).over(back)))
    cuts = {"final": F.col("_k") <= cfg.test_size}
    for i in range(cfg.folds):
        newest = cfg.validation_size * i
        cuts[f"cv_{cfg.folds - i}"] = (F.col("_r") > newest) & (F.col("_r") <= newest + cfg.validation_size)
    ends = [
        F.struct(F.lit(f).alias("fold"), F.min(F.when(c, F.col("date"))).alias("_start"), F.max(F.when(c, F.col("date"))).alias("_end"))
        for f, c in cuts.items()
    ]
    per = df.groupBy("symbol").agg(
        F.array(*ends).alias("w"), F.max(F.when(done, F.col("date"))).alias("_gap_after"), F.max("_test").alias("_test")
    )
    return per.select("symbol", "_gap_after", "_test", F.inline("w"))


def _by_target(prefix: str) -> Column:
    """The column `prefix`_h of the horizon that a row's target_name names, null for other names."""
    name = F.col("target_name")
    return F.coalesce(*[F.when(name == f"forward_return_{h}d", F.col(f"{prefix}_{h}")) for h in HORIZONS])


def manifest_audit(manifest: DataFrame, labels: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Violation counts per symbol; windows, gap and roles come from label dates and sizes, none from the manifest's own columns.

    The manifest has a row for each session, target and fold, so it is streamed once past a hash table of its partition's sessions and
    one of its windows: it is neither sorted nor, dealt by symbol as `build_manifest` leaves it, shuffled. Counts are of (symbol, fold, target) first,
    where the size of the block is known, then of symbols. Rows without a symbol are left out; those without a known fold or target are counted.
    """
    sessions = labels.select(
        "symbol", "date", F.col(PRIMARY_TARGET).isNull().alias("_no_primary"),
        *[F.col(f"target_exit_date_{h}d").alias(f"_exit_{h}") for h in HORIZONS],
        *[F.col(f"forward_return_{h}d").isNull().alias(f"_missing_{h}") for h in HORIZONS],
    )
    j = (
        manifest.filter(F.col("symbol").isNotNull())
        .select("symbol", "date", "target_name", "fold", "nominal_role", "role", "target_exit_date", "evaluation_start_date")
        .join(sessions.hint("shuffle_hash"), ["symbol", "date"], "left")
        .join(evaluation_windows(labels, cfg).hint("shuffle_hash"), ["symbol", "fold"], "left")
        .withColumns({"_exit": _by_target("_exit"), "_missing": _by_target("_missing")})
    )
    tail = F.col("_missing").isNotNull() & F.col("_no_primary")
    usable = ~F.col("_missing") & (F.col("_exit") < F.col("_start"))
    final = F.col("fold") == "final"
    expected = (
        F.when(tail, "unlabeled_tail")
        .when(~final & (F.col("date") > F.col("_gap_after")) & (F.col("date") < F.col("_test")), "pre_test_gap")
        .when(F.col("_missing"), "target_missing")
        .when((F.col("date") < F.col("_start")) & usable, "train")
        .when(F.col("date") < F.col("_start"), "purged")
        .when(F.col("date").between(F.col("_start"), F.col("_end")), F.when(final, "final_test").otherwise("validation"))
        .otherwise("not_candidate")
    )
    train = F.col("role") == "train"
    counts = {
        "rows_checked": F.count(F.lit(1)),
        "role_violations": F.count_if(~expected.eqNullSafe(F.col("role"))),
        "exit_date_violations": F.count_if(~F.col("target_exit_date").eqNullSafe(F.col("_exit"))),
        "leakage_violations": F.count_if(train & (F.col("_exit") >= F.col("_start"))),
        "order_violations": F.count_if(train & (F.col("date") >= F.col("_start"))),
        "boundary_violations": F.count_if(~F.col("evaluation_start_date").eqNullSafe(F.col("_start"))),
        "block_size_violations": F.count_if(F.col("nominal_role").isin("validation", "final_test")),  # rows of the block so far
        "unknown_session_violations": F.count_if(F.col("_missing").isNull()),
    }
    per = j.groupBy("symbol", "fold", "target_name").agg(*[c.alias(n) for n, c in counts.items()])
    size = F.when(final, cfg.test_size).otherwise(cfg.validation_size)
    wrong = F.when(F.col("block_size_violations") != size, F.col("rows_checked")).otherwise(0)
    return per.withColumn("block_size_violations", wrong).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in counts])


def fold_overlap(manifest: DataFrame) -> DataFrame:
    """Sessions validated in more than one fold, and test sessions used for training, per symbol."""
    per = manifest.groupBy("symbol", "date", "target_name").agg(
        F.count_if(F.col("nominal_role") == "validation").alias("v"),
        F.max((F.col("partition") == "final_test") & F.col("role").isin("train", "validation")).alias("t"),
    )
    return per.groupBy("symbol").agg(
        F.count_if(F.col("v") > 1).alias("validation_overlaps"), F.count_if("t").alias("test_rows_in_development")
    )


def boundaries(manifest: DataFrame) -> DataFrame:
    """Locked dates of a split: test window and every fold start."""
    ev = F.col("nominal_role").isin("validation", "final_test")
    return manifest.groupBy("symbol", "fold").agg(
        F.min(F.when(ev, F.col("date"))).alias("evaluation_start"), F.max(F.when(ev, F.col("date"))).alias("evaluation_end")
    )


def boundary_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Folds whose locked dates moved, appeared or vanished against the stored table."""
    key = ["symbol", "fold"]
    old = stored.select(*key, F.col("evaluation_start").alias("_s"), F.col("evaluation_end").alias("_e"))
    j = current.join(old, key, "full_outer")
    same = F.col("evaluation_start").eqNullSafe(F.col("_s")) & F.col("evaluation_end").eqNullSafe(F.col("_e"))
    return j.filter(~same)


def cv_members(frame: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Model rows of the development folds: every input column plus fold and role (train or validation).

    Roles come straight from the layout of the same rows, so features never travel through a join.
    """
    lay = layout(frame, cfg).filter("sufficient")
    h = PRIMARY_HORIZON
    folds = []
    for i in range(1, cfg.folds + 1):
        start = F.col("starts")[i - 1]
        train = (F.col("pos") < start["pos"]) & F.col(PRIMARY_TARGET).isNotNull() & (F.col(f"target_exit_date_{h}d") < start["date"])
        role = F.when(train, "train").when(F.col("validation_fold") == i, "validation")
        folds.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"), start["date"].alias("fold_start"))))
    return lay.select("symbol", *[c for c in frame.columns if c != "symbol"], F.inline(F.array_compact(F.array(*folds))))


def cv_entries(frame: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Every session that trains a development fold, once: `entry`, the first such fold, and `folds`."""
    lay = layout(frame, cfg).filter("sufficient")
    trains = [
        F.when((F.col("pos") < F.col("starts")[i - 1]["pos"]) & (F.col(f"target_exit_date_{PRIMARY_HORIZON}d") < F.col("starts")[i - 1]["date"]), F.lit(i))
        for i in range(1, cfg.folds + 1)
    ]
    entry = F.when(F.col(PRIMARY_TARGET).isNotNull(), F.least(*trains) if len(trains) > 1 else trains[0])
    folds = F.array(*[F.lit(i) for i in range(1, cfg.folds + 1)])
    return lay.select(*frame.columns, entry.alias("entry"), folds.alias("folds")).filter("entry IS NOT NULL")


def cv_sessions(frame: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Every session that trains or validates a development fold, once: `entry` and `folds` of `cv_entries`, and `valid`, the fold that it validates."""
    lay = layout(frame, cfg).filter("sufficient")
    start = lambda i: F.col("starts")[i - 1]
    trains = [
        F.when((F.col("pos") < start(i)["pos"]) & (F.col(f"target_exit_date_{PRIMARY_HORIZON}d") < start(i)["date"]), F.lit(i))
        for i in range(1, cfg.folds + 1)
    ]
    entry = F.when(F.col(PRIMARY_TARGET).isNotNull(), F.least(*trains) if len(trains) > 1 else trains[0])
    folds = F.array(*[F.lit(i) for i in range(1, cfg.folds + 1)])
    return lay.select(*frame.columns, entry.alias("entry"), F.col("validation_fold").alias("valid"), folds.alias("folds")).filter(
        "entry IS NOT NULL OR valid IS NOT NULL"
    )


# ---- walk-forward ----------------------------------------------------------------------------------
def _fold_base(cfg: WalkForwardConfig) -> int:
    return cfg.first_year * 4 + cfg.first_quarter - 1


def _with_folds(frame: DataFrame, cfg: WalkForwardConfig) -> tuple[DataFrame, Column]:
    """The symbol's folds as an array `_folds` beside each row with its quarter `_q`, and whether a row is labelled within the lock."""
    s, h = W.partitionBy("symbol"), cfg.horizon
    label = F.col(f"forward_return_{h}d").isNotNull()
    if cfg.locked_from is not None:
        lock = F.lit(cfg.locked_from).cast("date")
        frame, label = frame.filter(F.col("date") < lock), label & (F.col(f"target_exit_date_{h}d") < lock)
    df = frame.withColumn("_q", quarter_index("date") - _fold_base(cfg))
    df = df.withColumns({"_from": F.min("date").over(W.partitionBy("symbol", "_q")), "_last": F.max(F.when(label, F.col("_q"))).over(s)})
    inside = (F.col("_q") >= 0) & (F.col("_q") <= F.col("_last"))
    if cfg.n_folds is not None:
        inside = inside & (F.col("_q") < cfg.n_folds)
    folds = F.collect_set(F.when(inside, F.struct(F.col("_q").alias("fold"), F.col("_from").alias("fold_start")))).over(s)
    df = df.withColumn("_folds", folds)
    if cfg.n_folds is not None:
        missing = F.raise_error(F.concat(F.lit("a declared fold has no labelled session: "), F.col("symbol")))
        df = df.withColumn("_folds", F.when(F.size("_folds") == cfg.n_folds, F.col("_folds")).otherwise(missing))
    return df.drop("_from", "_last"), label


def walk_forward_candidates(frame: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """Every (session, fold) pair a fold may see: its validation sessions and all earlier ones.

    Folds are the quarters with sessions from the first one of the calendar to the symbol's last labelled session, a partial last
    one included. They are a short array next to the symbol's rows; exploding multiplies rows by at most the number of quarters
    and keeps the symbol partitioning. A declared fold without sessions raises.
    """
    df, label = _with_folds(frame, cfg)
    seen = F.filter("_folds", lambda f: f["fold"] >= F.col("_q"))
    x = df.select(*[c for c in df.columns if c not in ("_folds",)], F.inline(seen))
    exits = F.col(f"target_exit_date_{cfg.horizon}d")
    role = (
        F.when((F.col("_q") == F.col("fold")) & label, "validation")
        .when(F.col("_q") == F.col("fold"), "unlabelled_validation")
        .when(label & (exits < F.col("fold_start")), "train")
        .when(label, "purged")
        .otherwise("unlabelled")
    )
    return x.withColumn("role", role).drop("_q")


def walk_forward_entries(frame: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """Every session that trains a fold, once: `entry`, the first fold that it trains, and the symbol's `folds`.

    Training sets only grow from fold to fold, so a session trains all folds from its entry on; rows are not copied to folds.
    """
    df, label = _with_folds(frame, cfg)
    trains = F.filter("_folds", lambda f: (f["fold"] > F.col("_q")) & (F.col(f"target_exit_date_{cfg.horizon}d") < f["fold_start"]))
    df = df.withColumns({"entry": F.when(label, F.array_min(F.transform(trains, lambda f: f["fold"]))), "folds": F.array_sort(F.transform("_folds", lambda f: f["fold"]))})
    return df.filter("entry IS NOT NULL").drop("_q", "_folds")


def walk_forward_sessions(frame: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """Every session that trains or validates a fold, once: `entry` and `folds` of `walk_forward_entries`, and `valid`, the fold that it validates."""
    df, label = _with_folds(frame, cfg)
    trains = F.filter("_folds", lambda f: (f["fold"] > F.col("_q")) & (F.col(f"target_exit_date_{cfg.horizon}d") < f["fold_start"]))
    df = df.withColumns(
        {
            "entry": F.when(label, F.array_min(F.transform(trains, lambda f: f["fold"]))),
            "valid": F.when(label & F.exists("_folds", lambda f: f["fold"] == F.col("_q")), F.col("_q")),
            "folds": F.array_sort(F.transform("_folds", lambda f: f["fold"])),
        }
    )
    return df.filter("entry IS NOT NULL OR valid IS NOT NULL").drop("_q", "_folds")


def walk_forward_starts(frame: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """symbol, fold and fold_start of all folds, from one row per symbol."""
    df, _ = _with_folds(frame, cfg)
    return df.groupBy("symbol").agg(F.first("_folds").alias("f")).select("symbol", F.inline("f"))


def walk_forward_members(frame: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    return walk_forward_candidates(frame, cfg).filter(F.col("role").isin("train", "validation"))


def fold_inventory(candidates: DataFrame) -> DataFrame:
    """One row per symbol and fold: windows, sizes, purged rows and order violations."""
    r = F.col("role")
    cand, train, val = r.isin("train", "purged", "unlabelled"), r == "train", r == "validation"

    def d(cond: Column) -> Column:
        return F.when(cond, F.col("date"))

    return candidates.groupBy("symbol", "fold").agg(
        F.min(d(val)).alias("validation_first_session"),
        F.max(d(val)).alias("validation_last_session"),
        F.min(d(cand)).alias("raw_train_candidate_start"),
        F.max(d(cand)).alias("raw_train_candidate_end"),
        F.count_if(cand).alias("raw_train_candidate_rows"),
        F.min(d(train)).alias("effective_train_start"),
        F.max(d(train)).alias("effective_train_end"),
        F.count_if(train).alias("effective_train_rows"),
        F.count_if(val).alias("validation_rows"),
        F.count_if(r == "purged").alias("target_purged_rows"),
        F.count_if(cand & (F.col("date") >= F.col("fold_start"))).alias("order_violations"),
    )


def nesting_violations(members: DataFrame) -> DataFrame:
    """Training sessions missing from the next fold's training set, and sessions validated twice.

    A training session must stay in every later fold, so its fold numbers form a gapless run that ends
    at its symbol's last fold; checked by counts instead of set differences between folds.
    """
    folds = members.select("symbol", "fold").distinct()
    total = folds.groupBy("symbol").agg(F.collect_set("fold").alias("folds"))
    per = members.groupBy("symbol", "date").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.min(F.when(F.col("role") == "train", F.col("fold"))).alias("from_fold"),
        F.count_if(F.col("role") == "validation").alias("n_val"),
    )
    j = per.join(total, "symbol")
    later = F.size(F.filter("folds", lambda f: f >= F.col("from_fold")))
    return j.groupBy("symbol").agg(
        F.count_if((F.col("n_train") > 0) & (F.col("n_train") != later)).alias("nesting_violations"),
        F.count_if(F.col("n_val") > 1).alias("validation_overlaps"),
    )


def lock_audit(members: DataFrame, locked_from, horizon: int = PRIMARY_HORIZON) -> DataFrame:
    """No training, validation or label date may reach the locked window."""
    lock = F.lit(locked_from).cast("date")
    exits = F.col(f"target_exit_date_{horizon}d")
    train, val = F.col("role") == "train", F.col("role") == "validation"
    return members.groupBy("symbol").agg(
        F.count_if(train & (F.col("date") >= lock)).alias("fit_rows_locked"),
        F.count_if(val & (F.col("date") >= lock)).alias("validation_rows_locked"),
        F.count_if(train & (exits >= F.col("fold_start"))).alias("unrealised_fit_labels"),
        F.count_if(exits >= lock).alias("labels_reaching_lock"),
    )
