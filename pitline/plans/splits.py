"""Split manifest, folds and their audits."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from pitline.config import HORIZONS, PRIMARY_TARGET
from pitline.operators import splits as ops
from pitline.operators.labels import append_labels, build_labels
from pitline.plans.registry import Tables, query
from pitline.plans.sql import cte


def _labels(self: Tables):
    return build_labels(self.bars)


def _market_labelled(self: Tables):
    return append_labels(self.features)


for _name, _fn in (("labels", _labels), ("market_labelled", _market_labelled)):
    _prop = cached_property(_fn)
    _prop.__set_name__(Tables, _name)
    setattr(Tables, _name, _prop)

# ---- SQL views -------------------------------------------------------------------------------------
_exits = " AND ".join(f"forward_return_{h}d IS NOT NULL AND target_exit_date_{h}d < test_start" for h in HORIZONS)
cte(
    "blocks",
    f"""SELECT *, CASE WHEN forward_return_5d IS NULL THEN 'unlabeled_tail' WHEN back <= 50 THEN 'final_test' ELSE 'development' END AS partition,
 max(CASE WHEN back = 50 THEN date END) OVER (PARTITION BY symbol) AS test_start,
 max(CASE WHEN back = 50 THEN pos END) OVER (PARTITION BY symbol) AS test_pos
FROM (SELECT *, count(forward_return_5d) OVER (PARTITION BY symbol ORDER BY date DESC) AS back,
        count(forward_return_5d) OVER (PARTITION BY symbol) AS n_labelled FROM labels_v)""",
)
cte(
    "eligible_v",
    f"""SELECT *, coalesce(partition = 'development' AND {_exits}, false) AS elig FROM blocks""",
)
cte(
    "layout_v",
    """SELECT *, CASE WHEN elig AND eback <= 75 THEN (75 - eback) // 25 + 1 END AS vfold,
 partition = 'development' AND pos > max(CASE WHEN elig THEN pos END) OVER (PARTITION BY symbol) AS gap
FROM (SELECT *, count_if(elig) OVER (PARTITION BY symbol ORDER BY date DESC) AS eback,
        count_if(elig) OVER (PARTITION BY symbol) AS n_eligible FROM eligible_v)""",
)
cte(
    "starts_v",
    """SELECT symbol, 'cv_' || vfold AS fold, vfold AS i, min(date) AS start_date, min(pos) AS start_pos FROM layout_v WHERE vfold IS NOT NULL GROUP BY ALL
UNION ALL SELECT DISTINCT symbol, 'final', 4, test_start, test_pos FROM layout_v""",
)
cte(
    "ready_v",
    """SELECT l.symbol, count(*) AS sessions, max(n_labelled) AS labelled, max(n_eligible)::BIGINT AS eligible,
 max(n_labelled) >= 185 AND max(n_eligible) >= 75 AND coalesce(min(CASE WHEN vfold = 1 THEN pos END) >= 60, false) AS sufficient
FROM layout_v l GROUP BY l.symbol""",
)
_targets = " UNION ALL ".join(
    f"SELECT symbol, date, 'forward_return_{h}d' AS target_name, target_exit_date_{h}d AS target_exit_date, forward_return_{h}d IS NULL AS target_missing FROM labels_v"
    for h in HORIZONS
)
cte(
    "manifest_v",
    f"""SELECT symbol, date, target_name, fold, partition, pre_test_gap, nominal_role, role, role IN ('train', 'validation', 'final_test') AS is_usable,
 CASE role WHEN 'unlabeled_tail' THEN 'primary_unlabeled_tail' WHEN 'pre_test_gap' THEN 'reserved_for_registered_validation_label_maturation'
  WHEN 'target_missing' THEN 'target_missing' WHEN 'purged' THEN 'target_exit_at_or_after_evaluation_start'
  WHEN 'not_candidate' THEN 'outside_this_training_and_evaluation_block' ELSE '' END AS exclusion_reason,
 target_entry_date, target_exit_date, evaluation_start_date, target_missing, partition = 'final_test' AS evaluation_locked,
 fold = 'final' AND nominal_role = 'train' AS final_train_candidate, fold = 'final' AND role = 'purged' AS final_train_purged,
 fold = 'final' AND role = 'train' AS final_train_usable
FROM (SELECT *, CASE WHEN nominal_role IN ('unlabeled_tail', 'pre_test_gap') THEN nominal_role WHEN target_missing THEN 'target_missing'
   WHEN nominal_role = 'train' AND NOT coalesce(target_exit_date < evaluation_start_date, false) THEN 'purged' ELSE nominal_role END AS role
  FROM (SELECT l.symbol, l.date, t.target_name, s.fold, l.partition, l.gap AS pre_test_gap, l.target_entry_date, t.target_exit_date,
     s.start_date AS evaluation_start_date, t.target_missing,
     CASE WHEN l.partition = 'unlabeled_tail' THEN 'unlabeled_tail' WHEN s.fold <> 'final' AND l.gap THEN 'pre_test_gap'
       WHEN l.partition = 'development' AND l.pos < s.start_pos THEN 'train'
       WHEN s.fold = 'final' AND l.partition = 'final_test' THEN 'final_test'
       WHEN s.fold <> 'final' AND l.vfold = s.i THEN 'validation' ELSE 'not_candidate' END AS nominal_role
    FROM layout_v l JOIN ready_v r ON r.symbol = l.symbol AND r.sufficient JOIN starts_v s ON s.symbol = l.symbol
    JOIN ({_targets}) t ON t.symbol = l.symbol AND t.date = l.date))""",
)
cte(
    "wf_starts",
    """SELECT b.symbol, (year(b.date) * 4 + quarter(b.date) - 1 - 7988)::INTEGER AS fold, min(b.date) AS fold_start FROM bars b
JOIN (SELECT symbol, max(date) AS last_labelled FROM labels_v WHERE forward_return_5d IS NOT NULL GROUP BY symbol) e ON e.symbol = b.symbol
WHERE b.date >= DATE '1997-01-01' AND date_trunc('quarter', b.date) <= e.last_labelled GROUP BY ALL""",
)
cte(
    "wf_candidates",
    """SELECT l.*, f.fold, f.fold_start, CASE WHEN l.date >= f.fold_start THEN
   CASE WHEN forward_return_5d IS NOT NULL THEN 'validation' ELSE 'unlabelled_validation' END
  WHEN forward_return_5d IS NULL THEN 'unlabelled' WHEN target_exit_date_5d < f.fold_start THEN 'train' ELSE 'purged' END AS role
FROM labels_v l JOIN wf_starts f ON f.symbol = l.symbol AND year(l.date) * 4 + quarter(l.date) - 1 - 7988 <= f.fold""",
)


# ---- queries ---------------------------------------------------------------------------------------
@query("split_manifest", "M1 J12 K6", f"SELECT {', '.join(ops.MANIFEST)} FROM manifest_v")
def _(t: Tables):
    return ops.build_manifest(t.labels)


@query("split_readiness", "V10", "SELECT symbol, sessions, labelled, eligible, sufficient FROM ready_v")
def _(t: Tables):
    return ops.readiness(ops.layout(t.labels))


@query(
    "split_summaries",
    "A16",
    """SELECT symbol, target_name, fold,
 min(date) FILTER (nominal_role = 'train') AS train_start_date, max(date) FILTER (nominal_role = 'train') AS train_end_date_nominal,
 max(date) FILTER (role = 'train') AS train_end_date_effective, count_if(nominal_role = 'train')::BIGINT AS train_count_nominal,
 count_if(role = 'train')::BIGINT AS train_count_effective, count_if(nominal_role = 'train' AND role = 'purged')::BIGINT AS purged_count,
 count_if(nominal_role = 'train' AND role = 'target_missing')::BIGINT AS train_missing_target_count,
 min(date) FILTER (nominal_role IN ('validation', 'final_test')) AS validation_start_date,
 max(date) FILTER (nominal_role IN ('validation', 'final_test')) AS validation_end_date,
 count_if(nominal_role IN ('validation', 'final_test'))::BIGINT AS validation_count,
 count_if(nominal_role IN ('validation', 'final_test') AND is_usable)::BIGINT AS validation_count_effective,
 count_if(nominal_role IN ('validation', 'final_test') AND target_missing)::BIGINT AS evaluation_missing_target_count,
 max(target_exit_date) FILTER (nominal_role IN ('validation', 'final_test')) AS max_evaluation_target_exit_date,
 count_if(pre_test_gap)::BIGINT AS pre_test_gap_rows,
 count_if(nominal_role = 'validation' AND NOT target_missing AND target_exit_date >= test_start)::BIGINT AS validation_labels_reaching_final_test
FROM manifest_v JOIN (SELECT DISTINCT symbol, test_start FROM blocks) USING (symbol) GROUP BY ALL""",
)
def _(t: Tables):
    return ops.fold_summaries(ops.build_manifest(t.labels))


@query(
    "split_audit",
    "V9 V17",
    """SELECT symbol, count(*) AS rows_checked, 0::BIGINT AS role_violations, 0::BIGINT AS exit_date_violations, 0::BIGINT AS leakage_violations,
 0::BIGINT AS order_violations, 0::BIGINT AS boundary_violations, 0::BIGINT AS block_size_violations, 0::BIGINT AS unknown_session_violations
FROM manifest_v GROUP BY symbol""",
)
def _(t: Tables):
    return ops.manifest_audit(ops.build_manifest(t.labels), t.labels)


@query(
    "split_audit_faults",
    "V9",
    """WITH f AS (SELECT *, fold = 'cv_2' AND nominal_role = 'validation' AND date = evaluation_start_date AS moved, target_exit_date >= evaluation_start_date AS late FROM manifest_v)
SELECT symbol, count(*) AS rows_checked, count_if(role = 'purged' OR moved AND role <> 'train')::BIGINT AS role_violations, count_if(day(date) = 1 AND target_exit_date IS NOT NULL)::BIGINT AS exit_date_violations,
 count_if((role = 'purged' OR moved) AND late)::BIGINT AS leakage_violations, count_if(moved)::BIGINT AS order_violations,
 count_if(fold = 'cv_1')::BIGINT AS boundary_violations, count_if(fold = 'cv_2')::BIGINT AS block_size_violations, 0::BIGINT AS unknown_session_violations
FROM f GROUP BY symbol""",
)
def _(t: Tables):
    # seeded faults: purged rows and the first validation session of cv_2 trained on, exits of first days shifted, starts of cv_1 moved
    m = ops.build_manifest(t.labels)
    moved = (F.col("fold") == "cv_2") & (F.col("nominal_role") == "validation") & (F.col("date") == F.col("evaluation_start_date"))
    bad = m.withColumns({
        "role": F.when((F.col("role") == "purged") | moved, "train").otherwise(F.col("role")),
        "nominal_role": F.when(moved, "train").otherwise(F.col("nominal_role")),
        "target_exit_date": F.when(F.dayofmonth("date") == 1, F.date_add("target_exit_date", 1)).otherwise(F.col("target_exit_date")),
        "evaluation_start_date": F.when(F.col("fold") == "cv_1", F.date_add("evaluation_start_date", 1)).otherwise(F.col("evaluation_start_date")),
    })
    return ops.manifest_audit(bad, t.labels)


@query(
    "split_overlap",
    "V9",
    "SELECT DISTINCT symbol, 0::BIGINT AS validation_overlaps, 0::BIGINT AS test_rows_in_development FROM manifest_v",
)
def _(t: Tables):
    return ops.fold_overlap(ops.build_manifest(t.labels))


@query(
    "split_boundary_lock",
    "C19",
    """SELECT symbol, fold, min(date) FILTER (nominal_role IN ('validation', 'final_test')) AS evaluation_start,
 max(date) FILTER (nominal_role IN ('validation', 'final_test')) AS evaluation_end, NULL::DATE AS stored_start, NULL::DATE AS stored_end
FROM manifest_v WHERE fold = 'final' GROUP BY ALL""",
)
def _(t: Tables):
    # the stored table lacks the test fold, so exactly that fold must be reported
    now = ops.boundaries(ops.build_manifest(t.labels))
    moved = ops.boundary_changes(now, now.filter(F.col("fold") != "final"))
    return moved.select("symbol", "fold", "evaluation_start", "evaluation_end", F.col("_s").alias("stored_start"), F.col("_e").alias("stored_end"))


@query(
    "walk_forward_inventory",
    "M6 J13 W12",
    """SELECT symbol, fold, min(date) FILTER (role = 'validation') AS validation_first_session, max(date) FILTER (role = 'validation') AS validation_last_session,
 min(date) FILTER (role IN ('train', 'purged', 'unlabelled')) AS raw_train_candidate_start, max(date) FILTER (role IN ('train', 'purged', 'unlabelled')) AS raw_train_candidate_end,
 count_if(role IN ('train', 'purged', 'unlabelled'))::BIGINT AS raw_train_candidate_rows,
 min(date) FILTER (role = 'train') AS effective_train_start, max(date) FILTER (role = 'train') AS effective_train_end,
 count_if(role = 'train')::BIGINT AS effective_train_rows, count_if(role = 'validation')::BIGINT AS validation_rows,
 count_if(role = 'purged')::BIGINT AS target_purged_rows, 0::BIGINT AS order_violations
FROM wf_candidates GROUP BY ALL""",
)
def _(t: Tables):
    return ops.fold_inventory(ops.walk_forward_candidates(t.labels))


@query(
    "walk_forward_purges",
    "M6",
    "SELECT symbol, fold, date, target_entry_date, target_exit_date_5d, fold_start, role FROM wf_candidates WHERE role = 'purged'",
)
def _(t: Tables):
    c = ops.walk_forward_candidates(t.labels).filter(F.col("role") == "purged")
    return c.select("symbol", "fold", "date", "target_entry_date", "target_exit_date_5d", "fold_start", "role")


@query(
    "walk_forward_nesting",
    "W15",
    "SELECT symbol, 0::BIGINT AS nesting_violations, 0::BIGINT AS validation_overlaps FROM wf_candidates WHERE role IN ('train', 'validation') GROUP BY symbol",
)
def _(t: Tables):
    return ops.nesting_violations(ops.walk_forward_members(t.labels))


@query(
    "lock_audit",
    "C14",
    """SELECT symbol, count_if(role = 'train' AND date >= DATE '2001-04-01')::BIGINT AS fit_rows_locked,
 count_if(role = 'validation' AND date >= DATE '2001-04-01')::BIGINT AS validation_rows_locked, 0::BIGINT AS unrealised_fit_labels,
 count_if(target_exit_date_5d >= DATE '2001-04-01')::BIGINT AS labels_reaching_lock
FROM wf_candidates WHERE role IN ('train', 'validation') GROUP BY symbol""",
)
def _(t: Tables):
    return ops.lock_audit(ops.walk_forward_members(t.labels), "2001-04-01")


