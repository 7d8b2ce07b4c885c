"""Mixing sources to target weights by Poisson replication.

Every source s has a target share w of the result's rows; with n documents of the source and a result of N rows each of its
documents is to appear w N / n times on average. How often one does is the value at which the Poisson distribution of that mean
passes a uniform number made from a hash of seed and document, so any task finds the same number again and nothing is drawn.
A mean above PART is split into equal parts of at most PART whose counts add up, each with its own hash, which keeps the
distribution's table short. Documents are exploded by their counts and shuffled by another hash: within a partition they are
sorted by it, and the partition is chosen by it too, so the order of the result is a random one.

Everything is an expression of the DataFrame API. Sources are counted by sums that combine before their shuffle. Their tables are
broadcast when a count shows that there are few; beyond that the join is a shuffled one on source and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import at_most, carried, written

PART = 16.0
#: Entries of a part's table: the probability of more at mean 16 is under 2^-53.
TERMS = 80
SALTS = 64
DIGITS = 13  # hexadecimal digits of a hash that make a uniform number, 52 bits


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_table(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... for a Poisson distribution of a mean up to PART."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        F.concat(acc["upto"], F.array(F.element_at(acc["upto"], -1) + acc["p"] * mean / k)).alias("upto"),
    )
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS - 1)), lambda k: k.cast("double")), zero, step, lambda acc: acc["upto"])


def source_tables(docs: DataFrame, source: str, weights: DataFrame | None, rows: int | None, power: float) -> DataFrame:
    """(g, parts, upto) for each source: into how many parts its mean is split and the distribution of one.

    weights: (source, weight), weights of at least zero; sources that it lacks have weight zero. Without it a source weighs its count to
    the power `power`. rows: of the result; without it as many as docs has. Weights are brought to a sum of one over the sources there are.
    """
    counts = docs.groupBy(group(source).alias("g")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(power)))
    else:
        given = weights.groupBy(group(weights.columns[0]).alias("g")).agg(F.sum(F.col(weights.columns[1]).cast("double")).alias("w"))
        weighed = counts.join(given, "g", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    weighed = written(weighed, "weights")
    all_n, all_w = weighed.agg(F.sum("n"), F.sum("w")).first()
    wanted = float(rows) if rows is not None else all_n or 0.0
    mean = F.col("w") / F.lit(all_w) * F.lit(wanted) / F.col("n") if all_w else F.lit(0.0)
    parts = F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int")
    return weighed.select("g", mean.alias("mean")).select("g", parts.alias("parts"), poisson_table(F.col("mean") / parts).alias("upto"))


def group(source: str) -> Column:
    """The source as a join key: a null source is a source of its own, apart from an empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, power: float = 0.5, seed: int = 0, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs replicated to the target weights in random order: `row` (struct of all columns) and `copy` (int, from 1).

    The draw depends on seed and id alone, so repeated rows are drawn alike; a null id draws by the text instead, and a null text
    then counts as empty. Empty tables give empty results. Sources of weight zero are left out, which is what that weight asks for.
    """
    tables = source_tables(docs, source, weights, rows, power)
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.concat(F.lit("text|"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    wide = docs.select(carried(docs), group(source).alias("g"), F.md5(key).alias("key"))
    if at_most(tables):
        placed = wide.join(F.broadcast(tables), "g")
    else:
        salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = wide.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).join(salted, ["g", "salt"])
    times = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda sum_, part: sum_ + F.size(F.filter("upto", lambda p: p <= uniform(F.lit(str(seed)), part.cast("string"), F.col("key")))),
    )
    counted = placed.select("row", "key", times.alias("times")).where("times > 0")
    copies = counted.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), F.col("key"), F.col("copy"))
    return copies.withColumn("place", place).repartition("place").sortWithinPartitions("place").select("row", "copy")
