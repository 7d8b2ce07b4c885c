"""Helpers shared by the corpus operators: table reads, shared scratch tables, row carrying, small-side joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch where the session sets no number of its own: rows hold whole texts, and a worker holds a batch several times over.
BATCH_ROWS = 1_000
#: A side is broadcast explicitly only if a count shows that it has at most this many (narrow) rows.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, on one machine alone, a new folder in /tmp, kept in the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, lineage cut, readable after a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, their successors being written. Others are left alone."""
    for table in tables:
        if path := getattr(table, "scratch", None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def carried(df: DataFrame) -> Column:
    """The whole row as one struct, so that columns of any name pass through an operator untouched."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ascii_lowered(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; the fast built-in serves texts of ASCII alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], keep: list[str], added: T.StructType) -> DataFrame:
    """mapInArrow that keeps some columns as they are and appends those that fn computes for each batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) in (None, "10000"):  # unset reads as Spark's default
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    types = {f.name: f.type for f in to_arrow_schema(added)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            arrays = [batch.column(c) for c in keep]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v, types[n]) for n, v in ((n, new[n]) for n in types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *types])

    return df.mapInArrow(run, schema)


#: Bits of a bitmap of keys: 2 MB of bits, 262,144 words of 64, which is all that is broadcast, whatever the number of keys.
BITS = 1 << 24


def bitmap(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, mask): the bits of all values of `key`, a hash. Null keys have no bit."""
    bit = F.pmod(F.col("key"), F.lit(bits))
    placed = keys.where("key IS NOT NULL").select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(key, {bits}) % 64 AS INT))").alias("mask"))
    return written(placed.groupBy("word").agg(F.bit_or("mask").alias("mask")), "bits")


def marked(rows: DataFrame, key: Column, bits: DataFrame, name: str, size: int = BITS) -> DataFrame:
    """rows with a boolean column: whether the bit of their key is set. It is for all keys of the bitmap and by chance for a few others."""
    bit = F.pmod(key, F.lit(size))
    keyed = rows.withColumns({f"{name}_word": F.shiftright(bit, 6), f"{name}_bit": (bit % 64).cast("int")})
    found = keyed.join(F.broadcast(bits.select(F.col("word").alias(f"{name}_word"), F.col("mask").alias(f"{name}_mask"))), f"{name}_word", "left")
    is_set = F.coalesce(F.expr(f"bit_get({name}_mask, {name}_bit)") == 1, F.lit(False))
    return found.withColumn(name, is_set).drop(f"{name}_word", f"{name}_bit", f"{name}_mask")


def row_key(*columns: Column) -> list[Column]:
    """Columns k1 and k2: a 128-bit hash of values, in which nulls count."""
    values = [v for c in columns for v in (c, c.isNull())]
    return [F.xxhash64(F.lit(i), *values).alias(f"k{i}") for i in (1, 2)]


def parted(docs: DataFrame, key: list[Column], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hit, rest): (k1, k2, row) of all rows of docs that may have one of `keys` (k1, k2), and the rows of docs that have none.

    Rows are not shuffled for it; what is to be done with those of the keys then moves only these rows.
    """
    rows = docs.select(*key, carried(docs))
    rows = marked(rows, F.col("k1"), bitmap(keys.select(F.col("k1").alias("key"))), "hit")
    return rows.where("hit").drop("hit"), rows.where(~F.col("hit")).select("row.*")


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def with_small(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "left") -> DataFrame:
    """Join a side that is expected to be small: broadcast if its counted rows are few, else a shuffled join that AQE may split."""
    return big.join(F.broadcast(small) if at_most(small) else small, on, how)
