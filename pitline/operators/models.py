"""Fold-local preprocessing, linear fits and scoring.

Members are rows of (symbol, fold, role, y, features). One aggregate per (symbol, fold) yields every
feature's training statistics. Fits use a tree-reduced QR factorisation: each block of at most
``QR_BLOCK_ROWS`` training rows becomes a small triangular factor, factors of one fold are stacked and
reduced again. The factor of any feature subset follows from the factor of all features, so several
arms and both model families cost one pass, and nothing squares the condition number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.config import COVERAGE_MIN, PRIMARY_TARGET, QR_BLOCK_ROWS, RIDGE_ALPHA
from pitline.functions.numeric import finite
from pitline.operators.moments import correlation, matrix, pair_moments

KEY = ["symbol", "fold"]
FAMILIES = ("ols", "ridge")
FIT_SCHEMA = (
    "symbol string, fold int, arm string, family string, intercept double, coef array<double>, n_rows bigint, "
    "n_features int, rank int, sv_max double, sv_min double, design_rank int, design_condition double, "
    "whiten array<array<double>>"
)


def selection(coverage: Column, low: Column, high: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a feature is covered, constant and used, and why it is dropped, from its training values."""
    covered, constant = coverage >= COVERAGE_MIN, low == high
    used = F.coalesce(covered & ~constant, F.lit(False))
    reason = F.when(~F.coalesce(covered, F.lit(False)), "low_training_coverage").when(constant, "zero_training_variance").otherwise("used")
    return covered, constant, used, reason


def finished(p: Column) -> Column:
    """A feature's entry from its training statistics: mean and deviation of the median-filled column, and why it is dropped."""
    n, cnt = F.col("n_train").cast("double"), p["n"].cast("double")
    missing = n - cnt
    covered, constant, used, reason = selection(p["coverage"], p["lo"], p["hi"])
    mean = (p["avg"] * cnt + p["median"] * missing) / n
    var = (cnt * (p["var"] + (p["avg"] - mean) * (p["avg"] - mean)) + missing * (p["median"] - mean) * (p["median"] - mean)) / n
    std = F.when(constant, F.lit(0.0)).otherwise(F.sqrt(var))
    return F.struct(
        p["feature"].alias("feature"),
        p["n"].alias("n"),
        p["coverage"].alias("coverage"),
        F.when(covered, p["median"]).alias("median"),
        F.when(covered, mean).alias("mean"),
        F.when(covered, std).alias("std"),
        F.when(used, std).alias("scale"),
        used.alias("used"),
        reason.alias("drop_reason"),
        p["lo"].alias("train_min"),
        p["hi"].alias("train_max"),
    )


def fit_preprocessing(members: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """Training statistics per (symbol, fold): one struct per feature, plus row count and label mean.

    Mean and deviation are those of the median-filled column, composed from the observed moments so
    that one aggregate over the training rows suffices. The median comes from the sorted training values
    of one symbol, at most one per session, which is far cheaper than a hash of value counts.
    """
    train = F.col("role") == "train"
    n = F.count_if(train).cast("double")
    aggs: list[Column] = [F.count_if(train).alias("n_train"), F.avg(F.when(train, F.col(target))).alias("y_mean")]
    for i, name in enumerate(features):
        x = F.when(train, F.col(name))
        cnt = F.count(x).cast("double")
        aggs.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count(x).alias("n"),
                F.try_divide(cnt, n).alias("coverage"),
                F.sort_array(F.collect_list(x)).alias("sorted"),
                F.avg(x).alias("avg"),
                F.var_pop(x).alias("var"),
                F.min(x).alias("lo"),
                F.max(x).alias("hi"),
            ).alias(f"_p{i}")
        )
    s = members.groupBy(*KEY).agg(*aggs).filter(F.col("n_train") > 0)
    s = s.withColumn("p", F.array(*[F.col(f"_p{i}") for i in range(len(features))])).drop(
        *[f"_p{i}" for i in range(len(features))]
    )

    def median(v: Column, n: Column) -> Column:
        low, high = F.get(v, ((n - 1) / 2).cast("int")), F.get(v, (n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    s = s.withColumn(
        "p",
        F.transform("p", lambda p: p.withField("median", median(p["sorted"], p["n"])).dropFields("sorted")),
    )

    return s.withColumn("p", F.transform("p", finished))


def _prefix_statistics(x: np.ndarray, y: np.ndarray, entry: np.ndarray, folds: list[int]) -> Iterator[tuple[int, int, float, dict[str, np.ndarray]]]:
    """(fold, rows, label mean, statistics of each column) of the rows with entry <= fold, for each fold with rows.

    Each column is sorted once; the median of a fold is found by rank among the sorted values that have entered by then. Moments of
    the rows that enter with a fold are merged into those before.
    """
    order = np.argsort(x, axis=0, kind="stable")  # NaN last
    ranked, entered = np.take_along_axis(x, order, axis=0), entry[order]
    valued = ~np.isnan(ranked)
    k = x.shape[1]
    n, mean, square = np.zeros(k), np.zeros(k), np.zeros(k)
    low, high = np.full(k, np.inf), np.full(k, -np.inf)
    rows, total, last = 0, 0.0, None
    for fold in sorted(folds):
        new = (entry <= fold) if last is None else (entry <= fold) & (entry > last)
        last = fold
        block = x[new]
        here = ~np.isnan(block)
        m = here.sum(axis=0)
        centre = np.divide(np.where(here, block, 0).sum(axis=0), m, out=np.zeros(k), where=m > 0)
        step, both = centre - mean, n + m
        square += np.where(here, (block - centre) ** 2, 0).sum(axis=0) + step * step * np.divide(n * m, both, out=np.zeros(k), where=both > 0)
        mean += step * np.divide(m, both, out=np.zeros(k), where=both > 0)
        n = both
        low = np.minimum(low, np.where(here, block, np.inf).min(axis=0, initial=np.inf))
        high = np.maximum(high, np.where(here, block, -np.inf).max(axis=0, initial=-np.inf))
        rows, total = rows + int(new.sum()), total + float(y[new].sum())
        if not rows:
            continue
        inside = valued & (entered <= fold)
        rank = np.cumsum(inside, axis=0)
        at = lambda r: np.take_along_axis(ranked, (rank > r).argmax(axis=0)[None], axis=0)[0]  # noqa: B023, E731 - the value of rank r, from 0
        median = (at(np.maximum(n - 1, 0) // 2) + at(n // 2 - (n == 0))) / 2
        yield fold, rows, total / rows, {
            "n": n.copy(), "median": median, "avg": mean.copy(), "var": np.divide(square, n, out=np.zeros(k), where=n > 0),
            "lo": low.copy(), "hi": high.copy(),
        }


def fit_expanding(entries: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """The training statistics of `fit_preprocessing` for folds that only grow, from rows that name the first fold they train.

    One task reads a symbol's sessions once for all its folds: values are sorted once and never copied to folds.
    """
    statistics = ("median", "avg", "var", "lo", "hi")
    cell = "struct<feature: string, n: bigint, coverage: double, avg: double, var: double, lo: double, hi: double, median: double>"
    names = ["feature", "n", "coverage", "avg", "var", "lo", "hi", "median"]

    def of_symbol(table: pa.Table) -> pa.Table:
        x = matrix(table, [f"x{i}" for i in range(len(features))])
        rows = list(_prefix_statistics(x, table.column("y").to_numpy(), table.column("entry").to_numpy(), table.column("folds")[0].as_py()))
        some = lambda v, n: float(v) if n else None
        cells = [
            [{"feature": f, "n": int(s["n"][i]), "coverage": s["n"][i] / n} | {c: some(s[c][i], s["n"][i]) for c in statistics} for i, f in enumerate(features)]
            for _, n, _, s in rows
        ]
        kind = pa.struct([(c, pa.string() if c == "feature" else pa.int64() if c == "n" else pa.float64()) for c in names])
        return pa.table({
            "symbol": pa.array([table.column("symbol")[0].as_py()] * len(rows), pa.string()), "fold": pa.array([r[0] for r in rows], pa.int32()),
            "n_train": pa.array([r[1] for r in rows], pa.int64()), "y_mean": pa.array([r[2] for r in rows], pa.float64()), "p": pa.array(cells, pa.list_(kind)),
        })

    values = [finite(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)]
    slim = entries.select("symbol", F.col("entry").cast("int").alias("entry"), "folds", F.col(target).cast("double").alias("y"), *values)
    s = slim.groupBy("symbol").applyInArrow(of_symbol, f"symbol string, fold int, n_train bigint, y_mean double, p array<{cell}>")
    return s.withColumn("p", F.transform("p", finished))


def usage(params: DataFrame) -> DataFrame:
    """Preprocessing table: one row per symbol, fold and feature."""
    return params.select(*KEY, "n_train", "y_mean", F.posexplode("p").alias("position", "p")).select(
        *KEY, "n_train", "y_mean", "position", "p.*"
    )


def standardise(members: DataFrame, params: DataFrame, features: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Frozen transform: median fill, centre and scale with the fold's training statistics; unused features are zero."""
    # spelled per feature rather than with a lambda so that the projection is compiled
    cells = [
        F.expr(f"CASE WHEN p[{i}].used THEN (coalesce(CAST(`{c}` AS DOUBLE), p[{i}].median) - p[{i}].mean) / p[{i}].scale ELSE 0D END")
        for i, c in enumerate(features)
    ]
    return members.join(params, KEY).select(*KEY, *[c for c in keep if c not in KEY], "n_train", "y_mean", "p", F.array(*cells).alias("z"))


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _block_factor(table: pa.Table) -> pa.Table:
    """Triangular factor of [1, z, y] for every fold present in one block of a symbol's rows."""
    fold = table.column("fold").to_numpy()
    z = table.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
    a = np.column_stack([np.ones(len(fold)), z, table.column("y").to_numpy()])
    order = np.argsort(fold, kind="stable")
    folds, start = np.unique(fold[order], return_index=True)
    parts = np.split(a[order], start[1:])
    symbol = table.column("symbol")[0].as_py()
    return pa.table(
        {"symbol": pa.array([symbol] * len(folds), pa.string()), "fold": pa.array(folds, pa.int32()),
         "n": pa.array([len(x) for x in parts], pa.int64()),
         "r": pa.array([_triangle(x).ravel() for x in parts], pa.list_(pa.float64()))}
    )


def _solve(r: np.ndarray, n: int, cols: list[int], alpha: float, whiten: bool) -> Iterator[dict]:
    """Both families from the triangular factor of [1, z, y]; min-norm least squares and ridge, with ranks and conditions."""
    sub = _triangle(r[:, [0, *[1 + c for c in cols], r.shape[1] - 1]])
    p = len(cols)
    x, y = sub[1 : p + 1, 1 : p + 1], sub[1 : p + 1, p + 1]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    eps = np.finfo(float).eps * max(n, p)
    keep = s > eps * (s[0] if p else 0.0)
    uty = u.T @ y
    coefs = {
        "ols": vt.T[:, keep] @ (uty[keep] / s[keep]),
        "ridge": vt.T @ (s / (s * s + alpha) * uty),
    }
    lines = [(f, float((sub[0, p + 1] - sub[0, 1 : p + 1] @ beta) / sub[0, 0]), beta.tolist()) for f, beta in coefs.items()]
    live = np.flatnonzero(np.abs(sub[: p + 1, 1 : p + 1]).sum(axis=0) > 0)
    raw = np.linalg.svd(sub[: p + 1, 1 : p + 1][:, live], compute_uv=False) if len(live) else np.zeros(1)
    du, ds, dvt = np.linalg.svd(sub[: p + 1, [0, *(1 + live)]], full_matrices=False)
    dkeep = ds > np.finfo(float).eps * max(n, len(live) + 1) * ds[0]
    w = np.zeros((int(dkeep.sum()), p + 1))
    w[:, [0, *(1 + live)]] = dvt[dkeep] / ds[dkeep, None]
    for family, intercept, beta in lines:
        yield {
            "family": family,
            "intercept": intercept,
            "coef": beta,
            "n_rows": n,
            "n_features": len(live),
            "rank": int((raw > np.finfo(float).eps * max(n, len(live)) * raw[0]).sum()) if len(live) else 0,
            "sv_max": float(raw[0]),
            "sv_min": float(raw[-1]),
            "design_rank": int(dkeep.sum()),
            "design_condition": float(ds[0] / ds[-1]) if ds[-1] > 0 else float("inf"),
            "whiten": w.tolist() if whiten and family == "ols" else None,
        }


def _lines(r: np.ndarray, n: np.ndarray, subsets: list[list[int]], alpha: float) -> tuple[list[float], list[np.ndarray]]:
    """Intercepts and coefficients of `_solve` for a stack of factors, by fold, subset and family; subsets of one width are solved together."""
    found: dict[tuple[int, int], tuple] = {}
    for p in {len(cols) for cols in subsets}:
        alike = [i for i, cols in enumerate(subsets) if len(cols) == p]
        chosen = np.array([[0, *[1 + c for c in subsets[i]], r.shape[2] - 1] for i in alike])
        sub = _triangle(np.moveaxis(r[:, :, chosen], 1, 2))  # fold, subset, row, column
        y, head = sub[..., 1 : p + 1, p + 1], sub[..., 0, :]
        if p:
            u, s, vt = np.linalg.svd(sub[..., 1 : p + 1, 1 : p + 1], full_matrices=False)
            keep = s > np.finfo(float).eps * np.maximum(n, p)[:, None, None] * s[..., :1]
            uty = np.einsum("fari,far->fai", u, y)
            shares = (np.divide(uty, s, out=np.zeros_like(s), where=keep), s / (s * s + alpha) * uty)
            betas = [np.einsum("faij,fai->faj", vt, share) for share in shares]
        else:
            betas = [y, y]
        for k, beta in enumerate(betas):
            lines = (head[..., p + 1] - np.einsum("fai,fai->fa", head[..., 1 : p + 1], beta)) / head[..., 0]
            for j, i in enumerate(alike):
                found[i, k] = lines[:, j], beta[:, j]
    order = [(fold, i, k) for fold in range(len(r)) for i in range(len(subsets)) for k in range(len(FAMILIES))]
    return [float(found[i, k][0][fold]) for fold, i, k in order], [found[i, k][1][fold] for fold, i, k in order]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as the entries of one list column."""
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def fit_linear(
    z: DataFrame, arms: dict[str, tuple[str, ...]], features: tuple[str, ...], alpha: float = RIDGE_ALPHA, whiten: bool = False
) -> DataFrame:
    """OLS and ridge of every arm per (symbol, fold) from standardised training rows (columns z, y).

    Unused features are zero columns: their coefficient is zero under both families.
    """
    index = {f: i for i, f in enumerate(features)}
    subsets = {arm: [index[f] for f in cols] for arm, cols in arms.items()}
    width = len(features) + 2
    out_schema = pa.schema(
        [("symbol", pa.string()), ("fold", pa.int32()), ("arm", pa.string()), ("family", pa.string()), ("intercept", pa.float64()),
         ("coef", pa.list_(pa.float64())), ("n_rows", pa.int64()), ("n_features", pa.int32()), ("rank", pa.int32()),
         ("sv_max", pa.float64()), ("sv_min", pa.float64()), ("design_rank", pa.int32()), ("design_condition", pa.float64()),
         ("whiten", pa.list_(pa.list_(pa.float64())))]
    )

    def reduce(table: pa.Table) -> pa.Table:
        symbol = table.column("symbol")[0].as_py()
        per_fold: dict[int, list[tuple[int, np.ndarray]]] = {}
        for fold, n, r in zip(*(table.column(c).to_pylist() for c in ("fold", "n", "r"))):
            per_fold.setdefault(fold, []).append((n, np.asarray(r, dtype=float).reshape(-1, width)))
        rows = []
        for fold, blocks in sorted(per_fold.items()):
            r = _triangle(np.vstack([*[b for _, b in blocks], np.zeros((width, width))]))
            n = sum(k for k, _ in blocks)
            for arm, cols in subsets.items():
                rows += [{"symbol": symbol, "fold": fold, "arm": arm, **x} for x in _solve(r, n, cols, alpha, whiten)]
        return pa.Table.from_pylist(rows, schema=out_schema)

    # one call per symbol and block serves all its folds; a symbol's block stays below QR_BLOCK_ROWS rows per fold
    factors = (
        z.select(*KEY, "block", "z", "y")
        .groupBy("symbol", "block")
        .applyInArrow(_block_factor, "symbol string, fold int, n bigint, r array<double>")
    )
    return factors.groupBy("symbol").applyInArrow(reduce, FIT_SCHEMA)


def training_rows(members: DataFrame, params: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """Standardised training rows cut into blocks by a hash of the date, so that no fold is one unit of work."""
    blocks = F.ceil(F.col("n_train") / QR_BLOCK_ROWS).cast("int")
    z = standardise(members.filter(F.col("role") == "train"), params, features, ("date", target))
    return z.select(*KEY, F.pmod(F.xxhash64("date"), blocks).cast("int").alias("block"), "z", F.col(target).alias("y"))


class _Folds:
    """The folds of one symbol's sessions, each row held once: `entry` is the first fold that a row trains, `valid` the fold that it validates."""

    def __init__(self, table: pa.Table, k: int):
        table = table.sort_by("date")
        self.date, self.y = table.column("date"), table.column("y").to_numpy()
        self.x = matrix(table, [f"x{i}" for i in range(k)])
        whole = lambda c: table.column(c).fill_null(-1).to_numpy()  # noqa: E731 - folds count from 0 or 1
        self.entry, self.valid = whole("entry"), whole("valid")
        self.folds = table.column("folds")[0].as_py()
        self.trains = self.entry >= 0

    def each(self) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
        """(fold, training rows, their label mean, their row numbers, standardised rows of the fold: z of any rows) for folds that have training rows."""
        t = self.trains
        for fold, n, y_mean, s in _prefix_statistics(self.x[t], self.y[t], self.entry[t], self.folds):
            yield fold, n, y_mean, np.flatnonzero(t & (self.entry <= fold)), _frozen(s, n)


def _frozen(s: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, mean, scale) of the fold's transform; scale 0 where a column is not used. The rules of `finished`."""
    cnt, missing = s["n"], n - s["n"]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (s["avg"] * cnt + s["median"] * missing) / n
        var = (cnt * (s["var"] + (s["avg"] - mean) ** 2) + missing * (s["median"] - mean) ** 2) / n
    used = (cnt / n >= COVERAGE_MIN) & (s["lo"] != s["hi"])
    return s["median"], mean, np.where(used, np.sqrt(np.where(used, var, 1.0)), 0.0)


def _standardised(x: np.ndarray, frozen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    median, mean, scale = frozen
    used = scale > 0
    return np.where(used, (np.where(np.isnan(x), median, x) - np.where(used, mean, 0)) / np.where(used, scale, 1), 0.0)


def _factor(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangular factor of [1, z, y], from blocks of at most QR_BLOCK_ROWS rows that are stacked and reduced again."""
    a = np.column_stack([np.ones(len(y)), z, y])
    width = a.shape[1]
    blocks = [_triangle(a[i : i + QR_BLOCK_ROWS]) for i in range(0, len(a), QR_BLOCK_ROWS)]
    return _triangle(np.vstack([*blocks, np.zeros((width, width))]))


def slim_sessions(sessions: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """Of sessions with their folds (`entry`, `valid`, `folds`) what a fit reads; NaN and infinities as missing."""
    values = [finite(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)]
    return sessions.select(
        "symbol", "date", F.col("entry").cast("int").alias("entry"), F.col("valid").cast("int").alias("valid"), "folds",
        F.col(target).cast("double").alias("y"), *values,
    )


FOLD_FIT = pa.list_(pa.struct([
    ("arm", pa.string()), ("family", pa.string()), ("intercept", pa.float64()), ("coef", pa.list_(pa.float64())), ("n_rows", pa.int64()),
    ("n_features", pa.int32()), ("rank", pa.int32()), ("sv_max", pa.float64()), ("sv_min", pa.float64()), ("design_rank", pa.int32()),
    ("design_condition", pa.float64()), ("whiten", pa.list_(pa.list_(pa.float64()))),
]))


def fit_folds(
    sessions: DataFrame, arms: dict[str, tuple[str, ...]], features: tuple[str, ...], target: str = PRIMARY_TARGET, alpha: float = RIDGE_ALPHA,
    whiten: bool = False, diagnose: bool = True,
) -> DataFrame:
    """One row per (symbol, fold): `fits`, all arms and both families, and `date`, `actual` and `scores` (a list per model) of the validation rows.

    What `fit_preprocessing`, `fit_linear` and `predict` give from rows that are copied to folds, here from each session once: a task
    holds the sessions of one symbol, at most one a day, sorts their values once for all folds and factors each fold's rows. Nothing but
    the sessions is shuffled, and not even they where the frame lies by symbol already. `models_of` names the models of `scores`.
    """
    index = {f: i for i, f in enumerate(features)}
    subsets = {arm: [index[f] for f in cols] for arm, cols in arms.items()}
    schema = pa.schema([
        ("symbol", pa.string()), ("fold", pa.int32()), ("y_mean", pa.float64()), ("fits", FOLD_FIT), ("date", pa.list_(pa.date32())),
        ("actual", pa.list_(pa.float64())), ("scores", pa.list_(pa.list_(pa.float64()))),
    ])

    def of_symbol(table: pa.Table) -> pa.Table:
        f = _Folds(table, len(features))
        folds, sizes, means, factors, valid, z = [], [], [], [], [], []
        for fold, n, y_mean, train, frozen in f.each():
            folds.append(fold), sizes.append(n), means.append(y_mean)
            factors.append(_factor(_standardised(f.x[train], frozen), f.y[train]))
            valid.append(np.flatnonzero(f.valid == fold))
            z.append(_standardised(f.x[valid[-1]], frozen))
        if not folds:
            return schema.empty_table()
        if diagnose:
            fits = [{"arm": arm, **x} for r, n in zip(factors, sizes, strict=True) for arm, cols in subsets.items() for x in _solve(r, n, cols, alpha, whiten)]
            intercepts, coefs = [x["intercept"] for x in fits], [np.asarray(x["coef"], float) for x in fits]
            cells = pa.array(fits, FOLD_FIT.value_type)
        else:
            intercepts, coefs = _lines(np.stack(factors), np.array(sizes), list(subsets.values()), alpha)
            known = {
                "arm": pa.array([arm for arm in subsets for _ in FAMILIES] * len(folds), pa.string()), "family": pa.array(FAMILIES * (len(subsets) * len(folds)), pa.string()),
                "intercept": pa.array(intercepts, pa.float64()), "coef": _lists(coefs, pa.float64()),
            }
            cells = pa.StructArray.from_arrays([known[c.name] if c.name in known else pa.nulls(len(coefs), c.type) for c in FOLD_FIT.value_type], fields=list(FOLD_FIT.value_type))
        models = [cols for cols in subsets.values() for _ in FAMILIES]
        scores = []
        for i, rows in enumerate(z):
            beta, at = np.zeros((len(features), len(models))), i * len(models)
            for j, cols in enumerate(models):
                beta[cols, j] = coefs[at + j]
            scores += [np.zeros(len(rows)), np.full(len(rows), means[i]), *(rows @ beta + np.asarray(intercepts[at : at + len(models)])).T]
        every = np.concatenate(valid)
        grouped = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(len(folds) + 1) * n, pa.int32()), values)  # noqa: E731 - n a fold
        ends = pa.array(np.cumsum([0, *map(len, valid)]), pa.int32())
        return pa.table({
            "symbol": pa.array([table.column("symbol")[0].as_py()] * len(folds), pa.string()), "fold": pa.array(folds, pa.int32()), "y_mean": pa.array(means, pa.float64()),
            "fits": grouped(cells, len(models)), "date": pa.ListArray.from_arrays(ends, f.date.combine_chunks().take(pa.array(every))),
            "actual": pa.ListArray.from_arrays(ends, pa.array(f.y[every], pa.float64())), "scores": grouped(_lists(scores, pa.float64()), len(models) + 2),
        }, schema=schema)

    out = (
        "symbol string, fold int, y_mean double, fits array<struct<arm: string, family: string, intercept: double, coef: array<double>, n_rows: bigint, "
        "n_features: int, rank: int, sv_max: double, sv_min: double, design_rank: int, design_condition: double, whiten: array<array<double>>>>, "
        "date array<date>, actual array<double>, scores array<array<double>>"
    )
    return slim_sessions(sessions, features, target).groupBy("symbol").applyInArrow(of_symbol, out)


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged."""
    _, place, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    if not len(a) or a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def fold_associations(sessions: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """n, Pearson, Spearman and why they are undefined, of each used feature's frozen z with the label, by (symbol, fold), for training and validation rows.

    The sessions of one symbol are held once, as in `fit_folds`; no row is copied to a fold and a feature.
    """
    roles, cols = ("train", "validation"), [("n", pa.int64()), ("pearson", pa.float64()), ("spearman", pa.float64()), ("reason", pa.string())]
    schema = pa.schema([("symbol", pa.string()), ("fold", pa.int32()), ("feature", pa.string()), *[(f"{r}_{c}", t) for r in roles for c, t in cols]])

    def measured(z: np.ndarray, y: np.ndarray, y_ranks: np.ndarray) -> dict:
        reason = (
            "too_few_pairs" if len(y) < 2 else "constant_feature" if z.min() == z.max() else "constant_target" if y.min() == y.max() else "defined"
        )
        return {"n": len(y), "pearson": _correlation(z, y), "spearman": _correlation(_ranks(z), y_ranks), "reason": reason}

    def of_symbol(table: pa.Table) -> pa.Table:
        symbol, f = table.column("symbol")[0].as_py(), _Folds(table, len(features))
        rows = []
        for fold, _, _, train, frozen in f.each():
            sides = {r: (_standardised(f.x[at], frozen), f.y[at], _ranks(f.y[at])) for r, at in (("train", train), ("validation", np.flatnonzero(f.valid == fold))) if len(at)}
            for i in np.flatnonzero(frozen[2] > 0):
                cells = {f"{r}_{c}": v for r, (z, y, ranks) in sides.items() for c, v in measured(z[:, i], y, ranks).items()}
                rows.append({"symbol": symbol, "fold": fold, "feature": features[i], **cells})
        return pa.Table.from_pylist(rows, schema=schema)

    out = "symbol string, fold int, feature string, " + ", ".join(f"{r}_n bigint, {r}_pearson double, {r}_spearman double, {r}_reason string" for r in roles)
    return slim_sessions(sessions, features, target).groupBy("symbol").applyInArrow(of_symbol, out)


def fold_influence(
    sessions: DataFrame, arm: str, arms: dict[str, tuple[str, ...]], features: tuple[str, ...], target: str = PRIMARY_TARGET, alpha: float = RIDGE_ALPHA
) -> DataFrame:
    """The rows of `influence` from sessions held once by symbol: fits, hat diagonal and residuals of a fold come from one factor of its rows."""
    index = {f: i for i, f in enumerate(features)}
    cols = [index[c] for c in arms[arm]]
    numbers = pa.list_(pa.float64())
    schema = pa.schema([
        ("symbol", pa.string()), ("fold", pa.int32()), ("design_rank", pa.int32()), ("n_rows", pa.int64()), ("n_features", pa.int32()), ("sse", pa.float64()),
        ("ny", pa.float64()), ("nf", pa.float64()), ("date", pa.list_(pa.date32())), ("actual", numbers), ("fitted", numbers), ("leverage", numbers),
    ])

    def of_symbol(table: pa.Table) -> pa.Table:
        symbol, f = table.column("symbol")[0].as_py(), _Folds(table, len(features))
        rows = []
        for fold, n, _, train, frozen in f.each():
            z, y = _standardised(f.x[train], frozen), f.y[train]
            fit = next(x for x in _solve(_factor(z, y), n, cols, alpha, whiten=True) if x["family"] == "ols")
            fitted = z[:, cols] @ np.asarray(fit["coef"], float) + fit["intercept"]
            white = np.column_stack([np.ones(n), z[:, cols]]) @ np.asarray(fit["whiten"], float).T
            rest = y - fitted
            rows.append({
                "symbol": symbol, "fold": fold, "design_rank": fit["design_rank"], "n_rows": n, "n_features": fit["n_features"], "sse": float(rest @ rest),
                "ny": float(np.sqrt(y @ y)), "nf": float(np.sqrt(fitted @ fitted)), "date": f.date.take(train).to_pylist(), "actual": y.tolist(),
                "fitted": fitted.tolist(), "leverage": (white * white).sum(axis=1).tolist(),
            })
        return pa.Table.from_pylist(rows, schema=schema)

    out = (
        "symbol string, fold int, design_rank int, n_rows bigint, n_features int, sse double, ny double, nf double, date array<date>, actual array<double>, "
        "fitted array<double>, leverage array<double>"
    )
    folds = slim_sessions(sessions, features, target).groupBy("symbol").applyInArrow(of_symbol, out)
    rows = folds.select(*KEY, "design_rank", "n_rows", "n_features", "sse", "ny", "nf", F.inline(F.arrays_zip("date", "actual", "fitted", "leverage")))
    return _judged(rows.withColumn("residual", F.col("actual") - F.col("fitted")))


def models_of(arms: dict[str, tuple[str, ...]]) -> list[str]:
    """The models whose predictions `fit_folds` lists, in its order."""
    return ["zero_return", "historical_mean", *[f"{arm}_{family}" for arm in arms for family in FAMILIES]]


def fits_of(folds: DataFrame) -> DataFrame:
    """The rows of `fit_linear` from those of `fit_folds`."""
    return folds.select(*KEY, F.inline("fits"))


def predictions_of(folds: DataFrame, arms: dict[str, tuple[str, ...]]) -> DataFrame:
    """The rows of `predict` from those of `fit_folds`: symbol, fold, date, model, actual, prediction."""
    names = models_of(arms)
    cells = F.arrays_zip("date", "actual", *[F.col("scores")[i].alias(f"s{i}") for i in range(len(names))])
    rows = folds.select(*KEY, F.inline(cells))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"s{i}").alias("prediction")) for i, m in enumerate(names)])
    return rows.select(*KEY, "date", "actual", F.inline(models))


def parameters(fits: DataFrame, arms: dict[str, tuple[str, ...]]) -> DataFrame:
    """The fitted models as a table: one row per symbol, fold, arm, family and feature."""
    names = F.create_map(*[x for arm, cols in arms.items() for x in (F.lit(arm), F.array(*[F.lit(c) for c in cols]))])
    return fits.select(
        *KEY, "arm", "family", "intercept", F.explode(F.arrays_zip(names[F.col("arm")].alias("feature"), F.col("coef").alias("coefficient"))).alias("c")
    ).select(*KEY, "arm", "family", "intercept", "c.*")


def baseline_scores(members: DataFrame, params: DataFrame, target: str = PRIMARY_TARGET) -> DataFrame:
    """Zero and historical-mean predictions of the validation rows."""
    v = members.filter(F.col("role") == "validation").join(params.select(*KEY, "y_mean"), KEY)
    models = F.array(
        F.struct(F.lit("zero_return").alias("model"), F.lit(0.0).alias("prediction")),
        F.struct(F.lit("historical_mean").alias("model"), F.col("y_mean").alias("prediction")),
    )
    return v.select(*KEY, "date", F.col(target).alias("actual"), F.inline(models))


def predict(
    members: DataFrame, params: DataFrame, fits: DataFrame, arms: dict[str, tuple[str, ...]], features: tuple[str, ...],
    target: str = PRIMARY_TARGET, baselines: bool = True,
) -> DataFrame:
    """Out-of-fold predictions, long: symbol, fold, date, model, actual, prediction.

    All models of a fold travel as one array, so a validation row meets its fold's fits once.
    """
    index = {f: i for i, f in enumerate(features)}
    pick = F.create_map(*[x for a, cols in arms.items() for x in (F.lit(a), F.array(*[F.lit(index[c]) for c in cols]))])
    per_fold = fits.groupBy(*KEY).agg(F.collect_list(F.struct("arm", "family", "intercept", "coef")).alias("fits"))
    z = standardise(members.filter(F.col("role") == "validation"), params, features, ("date", target))

    def score(f: Column) -> Column:
        terms = F.zip_with(pick[f["arm"]], f["coef"], lambda i, c: F.get(F.col("z"), i) * c)
        return F.struct(
            F.concat_ws("_", f["arm"], f["family"]).alias("model"),
            (F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + f["intercept"]).alias("prediction"),
        )

    scored = F.transform("fits", score)
    if baselines:
        base = F.array(
            F.struct(F.lit("zero_return").alias("model"), F.lit(0.0).alias("prediction")),
            F.struct(F.lit("historical_mean").alias("model"), F.col("y_mean").alias("prediction")),
        )
        scored = F.concat(base, scored)
    return z.join(per_fold, KEY).select(*KEY, "date", F.col(target).alias("actual"), F.inline(scored))


def score_from_table(members: DataFrame, params: DataFrame, table: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """Predictions rebuilt from the stored parameter table alone: unpivoted features meet their coefficients.

    Rows meet the statistics and coefficients of their fold as arrays and are unpivoted where they lie, so what is shuffled is a row for each
    session that a fold validates, and a row for each fold.
    """
    v = members.filter(F.col("role") == "validation").select(*KEY, "date", F.col(target).alias("actual"), F.array(*[F.col(f).cast("double") for f in features]).alias("raw"))
    stats = params.select(*KEY, F.transform("p", lambda p: F.struct(p["feature"].alias("feature"), p["used"].alias("used"), p["median"].alias("median"), p["mean"].alias("mean"), p["scale"].alias("scale"))).alias("p"))
    lines = table.groupBy(*KEY).agg(F.collect_list(F.struct("feature", F.concat_ws("_", "arm", "family").alias("model"), "intercept", "coefficient")).alias("lines"))
    j = v.join(stats, KEY).join(lines, KEY)
    cells = F.filter(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("raw").alias("raw"), F.col("p").alias("p")), lambda c: c["p"]["used"])
    z = j.select(*KEY, "date", "actual", "lines", F.inline(cells)).withColumn("z", (F.coalesce("raw", "p.median") - F.col("p.mean")) / F.col("p.scale"))
    each = z.select(*KEY, "date", "actual", F.col("feature").alias("of"), "z", F.inline("lines")).filter(F.col("feature") == F.col("of"))
    return each.groupBy(*KEY, "date", "actual", "model").agg((F.sum(F.col("coefficient") * F.col("z")) + F.max("intercept")).alias("prediction"))


def conditioning(fits: DataFrame) -> DataFrame:
    """Rank and condition of each arm's standardised training matrix; infinite when rank deficient."""
    deficient = F.col("rank") < F.col("n_features")
    return fits.filter(F.col("family") == "ols").select(
        *KEY, "arm", F.col("n_rows").alias("training_rows"), F.col("n_features").alias("used_features"),
        F.try_divide(F.col("n_rows"), F.col("n_features")).alias("n_to_p_ratio"), F.col("rank").alias("matrix_rank"),
        deficient.alias("rank_deficient"), F.col("sv_max").alias("largest_singular_value"), F.col("sv_min").alias("smallest_singular_value"),
        F.when(~deficient, F.try_divide("sv_max", "sv_min")).alias("condition_number"),
        deficient.alias("condition_number_is_infinite"), "design_rank", "design_condition",
    )


def training_correlations(z: DataFrame, features: tuple[str, ...], threshold: float = 0.95) -> DataFrame:
    """Largest absolute pairwise correlation of the standardised training columns, and pairs above the cut-off."""
    columns = {f: F.col("z")[i] for i, f in enumerate(features)}
    per = pair_moments(z, KEY, columns).filter("i < j").select(*KEY, correlation().alias("r"))
    return per.groupBy(*KEY).agg(
        F.max(F.abs("r")).alias("max_abs_pairwise_correlation"),
        F.count_if(F.abs("r") >= threshold).alias("high_correlation_pairs"),
        F.count_if(F.col("r").isNull()).alias("undefined_pairs"),
    )


def influence(
    members: DataFrame, params: DataFrame, fits: DataFrame, arm: str, arms: dict[str, tuple[str, ...]], features: tuple[str, ...],
    target: str = PRIMARY_TARGET,
) -> DataFrame:
    """Leverage, studentised residual and Cook's distance of every training row of one arm's OLS fit.

    The fold's whitening matrix (rank x features, from the fit) rides along each row; the hat diagonal is
    the squared norm of the whitened row. Undefined cases carry a reason.
    """
    index = {f: i for i, f in enumerate(features)}
    cols = [index[c] for c in arms[arm]]
    f = fits.filter((F.col("arm") == arm) & (F.col("family") == "ols")).select(
        *KEY, "intercept", "coef", "design_rank", "n_rows", "n_features", "whiten"
    )
    z = standardise(members.filter(F.col("role") == "train"), params, features, ("date", target)).join(f, KEY)
    zs = F.array(*[F.col("z")[i] for i in cols])

    def plus(a: Column, b: Column) -> Column:
        return a + b

    fitted = F.aggregate(F.zip_with(zs, F.col("coef"), lambda a, b: a * b), F.lit(0.0), plus) + F.col("intercept")
    design = F.concat(F.array(F.lit(1.0)), zs)

    def squared(w: Column) -> Column:
        dot = F.aggregate(F.zip_with(w, design, lambda a, b: a * b), F.lit(0.0), plus)
        return dot * dot

    x = z.select(
        *KEY, "date", F.col(target).alias("actual"), fitted.alias("fitted"), "design_rank", "n_rows", "n_features",
        F.aggregate(F.transform("whiten", squared), F.lit(0.0), plus).alias("leverage"),
    ).withColumn("residual", F.col("actual") - F.col("fitted"))
    sse = x.groupBy(*KEY).agg(
        F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        F.sqrt(F.sum(F.col("actual") * F.col("actual"))).alias("ny"),
        F.sqrt(F.sum(F.col("fitted") * F.col("fitted"))).alias("nf"),
    )
    return _judged(x.join(sse, KEY))


def _judged(x: DataFrame) -> DataFrame:
    """Studentised residual, Cook's distance and undefined cases from fit, leverage and the fold's sums (sse, ny, nf)."""
    eps = float(np.finfo(float).eps)
    size = F.greatest(F.col("n_rows"), F.col("n_features") + 1).cast("double")
    df = F.col("n_rows") - F.col("design_rank")
    tiny = F.sqrt("sse") <= size * eps * F.greatest(F.lit(1.0), F.col("ny"), F.col("nf"))
    reason = (
        F.when(df <= 0, "nonpositive_residual_df").when(tiny, "zero_residual_variance")
        .when(1 - F.col("leverage") <= size * 16 * eps, "unit_leverage").otherwise("defined")
    )
    y = x.withColumns({"residual_df": df, "undefined_reason": reason})
    mse = F.try_divide(F.col("sse"), F.col("residual_df"))
    ok = F.col("undefined_reason") == "defined"
    room = 1 - F.col("leverage")
    return y.select(
        *KEY, "date", "actual", "fitted", "residual", "leverage", "design_rank", "residual_df",
        F.when(F.col("residual_df") > 0, mse).alias("residual_mse"),
        F.when(ok, F.try_divide(F.col("residual"), F.sqrt(mse * room))).alias("studentised_residual"),
        F.when(ok, F.try_divide(F.col("residual") * F.col("residual") * F.col("leverage"), F.col("design_rank") * mse * room * room)).alias("cooks_distance"),
        "undefined_reason",
    )


def zscores(members: DataFrame, params: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Long table of the frozen transform on validation rows: raw, imputed, statistics, z and |z| of used features."""
    v = members.filter(F.col("role") == "validation").join(params, KEY)
    x = F.array(*[F.col(f).cast("double") for f in features])
    long = v.select(*KEY, "date", F.explode(F.arrays_zip(x.alias("raw"), F.col("p").alias("p"))).alias("c")).select(
        *KEY, "date", "c.raw", "c.p.*"
    )
    z = (F.coalesce("raw", "median") - F.col("mean")) / F.col("scale")
    return long.filter("used").select(
        *KEY, "date", "feature", "raw", F.col("raw").isNull().alias("was_missing"), F.coalesce("raw", "median").alias("imputed"),
        "median", "mean", "scale", "train_min", "train_max", z.alias("z"), F.abs(z).alias("abs_z"),
    )


def train_validation_z(members: DataFrame, params: DataFrame, features: tuple[str, ...], target: str = PRIMARY_TARGET) -> DataFrame:
    """Frozen z of training and validation rows with the label, long."""
    v = members.join(params, KEY)
    x = F.array(*[F.col(f).cast("double") for f in features])
    long = v.select(*KEY, "date", "role", F.col(target).alias("y"), F.explode(F.arrays_zip(x.alias("raw"), F.col("p").alias("p"))).alias("c"))
    z = (F.coalesce("c.raw", "c.p.median") - F.col("c.p.mean")) / F.col("c.p.scale")
    return long.filter("c.p.used").select(*KEY, "date", "role", "y", F.col("c.p.feature").alias("feature"), z.alias("z"))
