"""Groups of equal texts by progressive refinement: length, then a hash of the first characters, then the hash of the whole text.

Each step looks only at rows that the one before could not tell apart, and reads no more of a text than it needs. What a step hands
to the next one is a bitmap of the keys that several rows share: BITS bits in words of 64, so at most BITS / 64 narrow rows are
broadcast, whatever the table holds. A bit that two keys share by chance costs a hash of a text that stands alone and changes no result,
because groups are made by the SHA-256 of whole texts alone. Texts are never shuffled; rows of groups are, with what is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import BITS, ascii_lowered, bitmap, carried, marked, text_of, with_small, written

#: Characters whose hash is the second step's key.
PREFIX = 128


def shared_bits(keys: DataFrame, bits: int) -> DataFrame:
    """The bitmap of every `key` that more than one row has. Keys are hashes or null."""
    return bitmap(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), bits)


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: Column | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: `row` (what is carried, by default the whole row), keep_id, group_size, kept.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty, and empty texts are one group. The row
    with the largest id stays; a null id is the smallest, and of rows that repeat the largest id exactly one stays. An empty table gives
    an empty result. `carry` is computed from the columns of docs while the text is at hand, whatever their names.
    """
    rows = docs.select((carried(docs) if carry is None else carry).alias("row"), F.col(f"`{id}`").alias("id"), text_of(text).alias("text"))
    length = F.xxhash64(F.octet_length("text"))
    lengths = shared_bits(rows.select(length.alias("key")), bits)
    long_shared = lambda df: marked(df, length, lengths, "same_length", bits)
    prefix = F.when(F.col("same_length"), F.xxhash64(F.octet_length("text"), ascii_lowered(F.substring("text", 1, PREFIX))))
    prefixes = shared_bits(long_shared(rows.select("text")).select(prefix.alias("key")), bits)
    survivors = marked(long_shared(rows), prefix, prefixes, "same_prefix", bits)
    full = F.when(F.col("same_prefix"), F.sha2(ascii_lowered(F.col("text")).cast("binary"), 256))
    hashed = written(survivors.select("row", "id", full.alias("full"), F.monotonically_increasing_id().alias("at")), "hashed")  # written: `at` holds
    alone = {"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    some = hashed.where("full IS NOT NULL")
    best = some.groupBy("full").agg(F.max(F.struct("id", "at")).alias("best"), F.count("*").alias("n")).where("n > 1")
    met = with_small(some, written(best, "groups"), ["full"])
    grouped = {
        "keep_id": F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")),
        "group_size": F.coalesce("n", F.lit(1).cast("long")),
        "kept": F.coalesce(F.col("at") == F.col("best.at"), F.lit(True)),
    }
    columns = lambda df, new: df.select("row", *[v.alias(k) for k, v in new.items()])
    return columns(hashed.where("full IS NULL"), alone).unionByName(columns(met, grouped))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the copies, with all their columns."""
    return groups(docs, id, text).where("kept").select("row.*")
