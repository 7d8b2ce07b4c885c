"""Quality rules: base rules on word and line statistics, then robust multivariate outliers per language and source.

A text's statistics become a vector of five transformed numbers. For every (language, source) the minimum-covariance-determinant
estimate is searched: the subset of SHARE of its vectors whose covariance has the least determinant. Concentration steps lower the
determinant: distances from the present estimate, the distance that the nearest share has, and mean and covariance of those within it.
They begin at several robust first estimates, go on from the one of least determinant, and end when it falls no more. Each step is two
aggregations over all vectors that combine before their shuffle, so a group of any size is spread over all tasks. The subsets
merge into first estimates of languages and of all documents, which a few steps finish; a group's estimate leans on its language's
the more, the fewer rows it has. A document is rejected if its squared Mahalanobis distance exceeds the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.llm.common import at_most, by_batch, discard, parted, row_key, with_small, written

SPACE = " \t\n\r\x0b\x0c"  # fixed values: the characters between words
SYMBOLS = "#*$%&|<>"  # fixed values: the characters counted as symbols
WINDOW = 8
MIN_WORDS = 20
#: Share of a group's vectors that the estimate rests on.
SHARE = 0.75
#: Concentration steps from every start, most further steps from the best one, and the fall of the log-determinant that counts as one.
SHORT = 2
STEPS = 20
TOLERANCE = 1e-4
#: Rows that a parent group's estimate counts as beside a group's own.
PRIOR = 100
#: Least standard deviation of each transformed statistic, so that a statistic that hardly varies rejects nothing by itself. Repeats are none
#: or few in most texts, and one repeated line of a short text is 0.1 and 0.35 on their scales: their floors keep it inside the cut.
FLOOR = (0.25, 0.05, 0.05, 0.08, 0.15)
DIMS = len(FLOOR)
COUNTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def chi2_cdf(x: float, k: int) -> float:
    """For odd degrees of freedom, in closed form."""
    total, term = erf(sqrt(x / 2)), sqrt(2 * x / pi) * exp(-x / 2)
    for m in range(1, k, 2):
        total -= term
        term *= x / (m + 2)
    return total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


#: Cut on the squared Mahalanobis distance: the quantile that one normal vector in 10,000 exceeds, 25.7 for five dimensions.
CUT_QUANTILE = 0.9999
CUT = chi2_quantile(CUT_QUANTILE, DIMS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside word windows that occur twice or more in the text, first occurrences included.

    Windows are numbered exactly, by doubling their length: equal numbers of two neighbouring halves mean equal windows.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = codes[: len(codes) - step] * (int(codes.max()) + 1) + codes[step:]
        values, codes = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        size += step
    again = np.bincount(codes)[codes] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_counts(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        rows = [text_counts(t) for t in batch.column("llm_text").to_pylist()]
        return dict(zip(COUNTS.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in COUNTS.names}

    return by_batch(docs.select(*keep, F.col(text).cast("string").alias("llm_text")), run, keep, COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> Column:
    """Length, word length, symbols, repeated lines and repeated words, on scales that are about even."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return F.array(
        F.log(words),
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    )


def moments(rows: DataFrame, keys: list[str], x: Column | str = "x") -> DataFrame:
    """n, sums and products of x by group: sums that tasks combine before the shuffle."""
    rows = rows.select(*keys, (F.col(x) if isinstance(x, str) else x).alias("x"))
    x = [F.col("x")[i] for i in range(DIMS)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(DIMS) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *products)


SUMS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}_{j}" for i in range(DIMS) for j in range(i + 1)]]


def mean_and_scatter(r: dict) -> tuple[np.ndarray, np.ndarray]:
    n = max(r["n"], 1)
    mean = np.array([r[f"s{i}"] for i in range(DIMS)]) / n
    second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(DIMS)] for i in range(DIMS)]) / n
    return mean, second - np.outer(mean, mean)


def solved(rows: DataFrame, keys: list[str], solve: Callable[[dict], tuple[np.ndarray, np.ndarray]], keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, center, precision, logdet), row by row: the inverse of the floored scatter that `solve` finds with its location."""
    names = [*keys, *(keep or [])]
    lists = T.ArrayType(T.DoubleType())
    schema = T.StructType([rows.schema[k] for k in names] + [T.StructField("center", lists), T.StructField("precision", lists), T.StructField("logdet", T.DoubleType())])
    floor = np.diag(np.square(FLOOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, s + floor) for c, s in map(solve, batch.to_pylist())]
            doubles = pa.list_(pa.float64())
            columns = [
                pa.array([c.tolist() for c, _ in found], doubles),
                pa.array([np.linalg.inv(s).ravel().tolist() for _, s in found], doubles),
                pa.array([float(np.linalg.slogdet(s)[1]) for _, s in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], *columns], names=[*names, "center", "precision", "logdet"])

    return rows.mapInArrow(run, schema)


def distance() -> Column:
    """Squared Mahalanobis distance of x from (center, precision); null where there is no estimate."""
    d = [F.col("x")[i] - F.col("center")[i] for i in range(DIMS)]
    terms = [d[i] * d[j] * F.col("precision")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest `share` of normal vectors that of all of them.

    share / P(chi2 with dims + 2 degrees <= q), q the share quantile of chi2 with dims degrees.
    """
    return share / chi2_cdf(chi2_quantile(share, DIMS), DIMS + 2)


def starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """First estimates (keys, start, center, precision) of every group, START of them, all from medians m and quartile deviations s:

    0: location m and independent statistics of deviation s; 1: the correlation of tanh((x - m) / s), which bounds what a far vector
    adds; 2: the correlation of the signs of (x - m) / s as directions, its vectors all of length one.
    """
    quartiles = vectors.groupBy(*keys).agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMS)])
    # interquartile ranges as standard deviations of independent normal variables
    middle = F.array(*[F.col(f"q{i}")[1] for i in range(DIMS)])
    spread = F.array(*[F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2) for i in range(DIMS)])
    quartiles = written(quartiles.select(*keys, middle.alias("m"), spread.alias("s")), "quartiles")
    z = F.transform("x", lambda v, i: (v - F.col("m")[i]) / F.col("s")[i])
    placed = with_small(vectors, quartiles, keys, "inner").select(*keys, z.alias("z"))
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    forms = placed.select(*keys, F.explode(F.array(
        F.struct(F.lit(1).alias("start"), F.transform("z", lambda v: F.tanh(v)).alias("x")),
        F.struct(F.lit(2).alias("start"), F.when(length > 0, F.transform("z", lambda v: v / length)).otherwise(F.col("z")).alias("x")),
    )).alias("form"))
    sums = moments(forms.select(*keys, "form.start", "form.x"), [*keys, "start"])
    plain = quartiles.select(*keys, F.lit(0).alias("start"), *[F.lit(0 if c == "n" else 0.0).cast("long" if c == "n" else "double").alias(c) for c in SUMS])

    def solve(r: dict) -> tuple[np.ndarray, np.ndarray]:
        middle, s = np.array(r["m"]), np.array(r["s"])
        correlation = np.eye(DIMS)
        if r["start"]:
            scatter = mean_and_scatter(r)[1] + 1e-9 * np.eye(DIMS)
            correlation = scatter / np.sqrt(np.outer(np.diag(scatter), np.diag(scatter)))
        # s holds the floor already, which solved() adds
        return middle, correlation * np.outer(s, s) - np.diag(np.square(FLOOR))

    return solved(with_small(sums.unionByName(plain), quartiles, keys, "inner"), keys, solve, ["start"]).drop("logdet")


def concentrated(vectors: DataFrame, keys: list[str], present: DataFrame, few: bool = False) -> DataFrame:
    """One concentration step from every (keys, start): moments, location, scatter and log-determinant of the nearest SHARE.

    few: the groups are known to be few enough for a broadcast.
    """
    join = (lambda big, small, on: big.join(F.broadcast(small), on)) if few else (lambda big, small, on: with_small(big, small, on, "inner"))
    placed = join(vectors, present.select(*keys, "start", "center", "precision"), keys).select(*keys, "start", "x", distance().alias("d"))
    reach = placed.groupBy(*keys, "start").agg(F.percentile_approx("d", F.lit(SHARE), F.lit(10_000)).alias("reach"))
    inside = join(placed, written(reach, "reach"), [*keys, "start"]).where("d <= reach")
    return solved(moments(inside, [*keys, "start"]), [*keys, "start"], subset_estimate, SUMS)


def subset_estimate(r: dict) -> tuple[np.ndarray, np.ndarray]:
    mean, scatter = mean_and_scatter(r)
    return mean, scatter * consistency(SHARE)


def least(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the candidate of least determinant, of equal ones the first start."""
    every = F.struct(*candidates.columns)
    return candidates.groupBy(*keys).agg(F.min_by(every, F.struct("logdet", "start")).alias("best")).select("best.*")


def descended(vectors: DataFrame, keys: list[str], first: DataFrame, few: bool) -> DataFrame:
    """(keys, n, sums and products) of the subset of least determinant that steps from `first` find; each group has one start in it.

    A group takes steps until its log-determinant falls by TOLERANCE no more, at most STEPS of them.
    """
    best = going = first
    for _ in range(STEPS):
        after = written(concentrated(vectors, keys, going, few), "estimates")
        fell = after.join(going.select(*keys, F.col("logdet").alias("before")), keys).where(F.col("logdet") < F.col("before") - TOLERANCE).drop("before")
        going = written(fell, "estimates")
        best = written(least(best.unionByName(after), keys), "estimates")
        if not going.limit(1).count():
            break
    return best.select(*keys, *SUMS)


def least_determinant(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The subsets of least determinant of all groups of `vectors` (keys, x): SHORT steps from all starts, then on from the best one."""
    present = written(starts(vectors, keys), "estimates")
    few = at_most(present)
    for _ in range(SHORT):
        last, present = present, written(concentrated(vectors, keys, present, few), "estimates")
        discard(last)
    return descended(vectors, keys, written(least(present, keys), "estimates"), few)


def estimates(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates (keys, center, precision) of all groups of `vectors` (keys, x).

    The subsets of groups that share all keys but the last one are merged; from this first estimate of their parent group steps over its
    vectors find the parent's own subset, so that single outliers of small groups leave it. Likewise up to the first key alone. Location
    and scatter of a group of which n vectors are in its subset are its own with weight n / (n + PRIOR) and else those of its parent,
    which are made in the same way: no size switches from one to the other.
    """
    found = least_determinant(vectors, keys)
    levels = [found]
    for k in range(len(keys) - 1, 0, -1):
        on, above = keys[:k], vectors.select(*keys[:k], "x")
        merged = levels[-1].groupBy(*on).agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("start", F.lit(0))
        first = written(solved(merged, [*on, "start"], subset_estimate), "estimates")
        few = at_most(first)
        levels.append(descended(above, on, written(concentrated(above, on, first, few), "estimates"), few))
    chain = found.select(*keys, F.struct(*SUMS).alias("level0"))
    for k, level in enumerate(levels[1:], 1):
        on = keys[: len(keys) - k]
        chain = with_small(chain, level.select(*on, F.struct(*SUMS).alias(f"level{k}")), on, "inner")
    scale, depth = consistency(SHARE), len(levels)

    def solve(r: dict) -> tuple[np.ndarray, np.ndarray]:
        center, scatter = mean_and_scatter(r[f"level{depth - 1}"])
        for k in range(depth - 2, -1, -1):
            weight = r[f"level{k}"]["n"] / (r[f"level{k}"]["n"] + PRIOR)
            own_center, own_scatter = mean_and_scatter(r[f"level{k}"])
            center = weight * own_center + (1 - weight) * center
            scatter = weight * own_scatter + (1 - weight) * scatter
        return center, scatter * scale

    return written(solved(chain, keys, solve).drop("logdet"), "estimates")


def judged(rows: DataFrame) -> DataFrame:
    """rows (lang, source, the five counts, and anything else) with `base_failed` and `kept`."""
    rows = rows.withColumn("base_failed", base_failed())
    # null languages and sources are groups of their own; the marker keeps them apart from empty strings
    rows = rows.withColumn("g_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))).withColumn("g_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("x", vector())
    rows = rows.withColumn("g_all", F.lit(0))
    keys = ["g_all", "g_lang", "g_source"]
    est = estimates(rows.where(~F.col("base_failed")).select(*keys, "x"), keys)
    found = with_small(rows, est, keys, "left")
    kept = ~F.col("base_failed") & ~F.coalesce(distance() > CUT, F.lit(False))
    return found.withColumn("kept", kept).select(*[c for c in rows.columns if c not in (*keys, "x")], "kept")


def assess(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of docs: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A null text has no words and fails the base rules. Null languages and sources are groups of their own. Groups of any size are judged,
    small ones mostly by the estimates of their language and of all documents. Repeated rows stay repeated; ids may be null. An empty
    table gives an empty result.
    """
    slim = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("llm_in"))
    rows = written(with_counts(slim, ["id", "lang", "source"], "llm_in"), "counts")
    return judged(rows).select(F.col("id").alias(id), *COUNTS.names, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns of any name.

    A verdict follows from text, language and source, so it is taken over narrow rows that carry a key of the three; whole rows
    are shuffled only where their key may be that of a rejected one.
    """
    columns = [F.col(c).cast("string") for c in (text, lang, source)]
    key = row_key(*columns)
    slim = docs.select(*key, columns[1].alias("lang"), columns[2].alias("source"), columns[0].alias("llm_in"))
    rows = written(with_counts(slim, ["k1", "k2", "lang", "source"], "llm_in"), "counts")
    rejected = written(judged(rows).where(~F.col("kept")).select("k1", "k2").distinct(), "rejected")
    hit, rest = parted(docs, key, rejected)
    return rest.unionByName(hit.join(rejected, ["k1", "k2"], "left_anti").select("row.*"))
