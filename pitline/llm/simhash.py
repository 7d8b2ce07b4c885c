"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Fingerprints within `radius` bits of each other have a common point within radius/2 bits of both. Every distinct
fingerprint therefore emits the points of its own half-radius ball; equal points meet in one shuffle. Documents with equal
fingerprints form a class first, so groups of exact copies emit one ball, and a point is shared by few classes
(at half radius 1 by no more than 65), whatever the size of the groups.

Within a point every member is linked to the smallest one instead of to all others. For an even radius this loses no
reachability: members of one half ball are all within `radius` of each other. Linked pairs are deduplicated and their
distance is verified. Components come from alternating large-star and small-star rounds over distinct fingerprints, each
round written to the shared folder; nothing is gathered on the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pitline.llm.common import by_batch, carried, written

SHINGLE = 3
RADIUS = 2
SEED = 42  # fixed value: seed of the shingle hash


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    last = ends.tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns `keep` of docs and `fingerprint` (long). A null text counts as empty."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"fingerprint": [fingerprint(t, shingle) for t in batch.column("llm_text").to_pylist()]}

    added = T.StructType([T.StructField("fingerprint", T.LongType(), False)])
    return by_batch(docs.select(*keep, F.col(text).cast("string").alias("llm_text")), run, keep, added)


def half_ball_masks(radius: int, bits: int = 64) -> list[int]:
    """XOR masks of at most ceil(radius / 2) bits, as signed 64-bit integers."""
    half = (radius + 1) // 2
    masks = (sum(1 << b for b in chosen) for k in range(half + 1) for chosen in combinations(range(bits), k))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b), a < b, between distinct fingerprints of the column `fingerprint`.

    Connects exactly what all links within `radius` connect when `radius` is even; it need not hold every link.
    """
    if radius % 2:
        raise ValueError("the radius must be even: half balls of an odd one hold pairs beyond it")
    masks = F.array(*[F.lit(m) for m in half_ball_masks(radius)])
    # a set number of partitions: adaptive merging would go by the few bytes of the fingerprints, not by the balls they become
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = prints.select("fingerprint").repartition(parts, "fingerprint").distinct().select(
        "fingerprint", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fingerprint")))).alias("point")
    )
    members = W.partitionBy("point").orderBy("fingerprint").rowsBetween(W.unboundedPreceding, 0)
    met = balls.select(F.first("fingerprint").over(members).alias("a"), F.col("fingerprint").alias("b")).where("a <> b")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Nodes without a link are absent."""
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    while True:
        # large star: every larger neighbour of x moves to the smallest node of x's neighbourhood
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # (the minima are written tables, so that both sides of the joins are shuffled alone and a hub's rows can be split)
        low = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "minima")
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: the smaller neighbours of x, and x, move to the smallest of them
        large = written(large, "links")
        least = written(large.groupBy("v").agg(F.min("u").alias("m")), "minima")
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        after = written(small.select("e.v", "e.u").where("u <> v").distinct(), "links")
        # equal sets: every node has one edge, to a node that has none
        if not after.groupBy("v").count().where("count > 1").limit(1).count() and not after.join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            return after.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(after.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        edges = after


def near_duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: its id, `fingerprint` (long) and `component_id`, the smallest id of its group.

    Null or empty texts and texts of white space have fingerprint zero and are linked like any other; a text with fewer words
    than a shingle is one shingle. Rows with a null id belong to groups but never name one; a group of null ids alone has a null
    component. Repeated rows stay repeated. An empty table gives an empty result.
    """
    rows = written(with_fingerprints(docs.select(F.col(id).alias("llm_id"), F.col(text).alias("llm_in")), ["llm_id"], "llm_in", shingle), "prints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("llm_id").alias("least_id")), "classes")
    roots = written(components(linked_fingerprints(classes, radius)), "roots")
    grouped = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = grouped.join(named, "root").select("fingerprint", "component_id")
    return rows.join(labels, "fingerprint").select(F.col("llm_id").alias(id), "fingerprint", "component_id")


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but one of each near-duplicate group: the row with the smallest id stays.

    A null id counts as larger than any other. Of rows that repeat the smallest id the first by text hash stays, of equal
    rows any one. Columns of any name pass through.
    """
    prints = with_fingerprints(docs.select(carried(docs), F.col(text).alias("llm_in")), ["row"], "llm_in", shingle)
    tie = F.struct(F.xxhash64(F.col("row")[text]).alias("hash"), F.monotonically_increasing_id().alias("at"))
    kept = written(prints.select("row", F.col("row")[id].alias("id"), tie.alias("tie"), "fingerprint"), "prints")  # written: the numbers hold
    slim = kept.select("id", "tie", "fingerprint")
    order = F.struct(F.col("id").isNull(), "id", "tie")
    classes = written(slim.groupBy("fingerprint").agg(F.min(order).alias("best")), "classes")
    roots = written(components(linked_fingerprints(classes, radius)), "roots")
    grouped = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "best", F.coalesce("root", "fingerprint").alias("root"))
    best = grouped.groupBy("root").agg(F.min_by("fingerprint", F.struct("best", "fingerprint")).alias("fingerprint"), F.min("best").alias("best"))
    chosen = kept.join(best.select("fingerprint", "best"), "fingerprint").where(order == F.col("best"))
    return chosen.select("row.*")
