"""A trie of conversations' common beginnings, with aggregates of every node's subtree.

Turns become 128-bit ids (SHA-256 of role and text); a conversation is one narrow row: its turns' ids joined to one binary key and the byte
counts of their texts. Sorted by that key, the members of every node are neighbours. The rows are range-sharded by (key, conv_id), so that a
beginning that many conversations share, or many equal conversations, spread over shards.

A shard sorts its rows with numpy.lexsort over padded matrices of turn ids, STRIPE columns at a time and only for rows that are still
undecided. Changes against the row above, OR-accumulated over the columns, give the length of each pair's common beginning, hence where the
nodes of each depth start; numpy's reduceat aggregates each depth over the rows that reach it. Every aggregate is a sum or a minimum
over the rows of a node, provided that the first row of a shard knows what it has in common with the row before and the last row with the one
after. Nodes that cross the end of a shard are emitted with their key and recombined; all others are final.

Bound: the ids of one conversation (16 bytes a turn) fit in a task, and so do the ids of conversations that end at one node, whose digest needs them in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import with_small, written

ID = 16  # bytes of a turn id
STRIPE = 64
#: Turns of a shard, about; 24 bytes each before numpy's copies.
SHARD_TURNS = 500_000
NOTHING = hashlib.sha256(b"").hexdigest()

PARTS = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary, shard int, ends string"
)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids array of hex ids, sizes array of bytes) in the order of turn (null first), then role, then id. A null conv_id has no row."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(name, 1, 2 * ID).alias("id"), F.octet_length(text).alias("size")
    )
    whole = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size"))).alias("all"))
    return whole.select("conv_id", F.col("all.id").alias("ids"), F.col("all.size").alias("sizes"))


def forked(convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations that begin with the first h turns of the first of their family (conv_id - conv_id % family, rounded down) and go on
    with their own turns after h, where h = crc32(conv_id) % (most + 1)."""
    heads = convs.where(F.pmod("conv_id", F.lit(family)) == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    both = convs.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")

    def spliced(own: str, head: str, kind: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), h), F.expr(f"CAST(array() AS array<{kind}>)"))
        return F.concat(first, F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0))))

    return both.select("conv_id", spliced("ids", "head_ids", "string").alias("ids"), spliced("sizes", "head_sizes", "int").alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    n = min(len(a), len(b)) // ID
    x, y = (np.frombuffer(k[: n * ID], np.uint64).reshape(n, 2) for k in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def ranks(keys: bytes) -> np.ndarray:
    """For each id its place among the distinct ids in byte order."""
    pairs = np.frombuffer(keys, ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    changes = np.ones(len(pairs), bool)
    changes[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
    out = np.empty(len(pairs), np.int64)
    out[order] = np.cumsum(changes) - 1
    return out


def sorted_rows(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, conv: np.ndarray, stripe: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the rows sorted by their turns, then conv, and what each has in common with the row before it (the first: 0)."""
    order = np.lexsort((conv, lens > 0))
    group, lcp = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    place, done = np.flatnonzero(lens[order] > 0), 0  # places whose rows have turns left and a neighbour they may share them with
    while len(place):
        rows, width = order[place], min(stripe, int(lens[order[place]].max()) - done)
        column = done + np.arange(width)
        there = column < lens[rows][:, None]
        padded = np.full(there.shape, -1, np.int64)
        padded[there] = ids[(starts[rows][:, None] + column)[there]]
        k = np.lexsort((conv[rows], lens[rows] > done + width, *padded.T[::-1], group[place]))  # rows that end here come first
        rows, padded, g = rows[k], padded[k], group[place]  # groups are blocks of places, so they stay as they are
        order[place] = rows
        changed = np.logical_or.accumulate(padded[1:] != padded[:-1], axis=1)
        same = g[1:] == g[:-1]
        shared = np.minimum(done + (~changed).sum(axis=1), np.minimum(lens[rows[1:]], lens[rows[:-1]]))
        lcp[place[1:][same]] = shared[same]
        new = np.concatenate(([0], np.cumsum(~same | changed[:, -1])))
        done += width
        more = (lens[rows] > done) & (np.bincount(new)[new] > 1)
        group[place] = new
        place = place[more]
    return order, lcp


def shard_nodes(shard: int, conv: np.ndarray, keys: list[bytes], sizes: np.ndarray, before: int, after: int, stripe: int) -> pa.Table:
    """Nodes of one shard (columns of PARTS). before, after: turns that its first and last row share with their neighbours, -1: none there."""
    lens = np.array([len(k) // ID for k in keys], np.int64)
    order, lcp = sorted_rows(ranks(b"".join(keys)), np.concatenate(([0], np.cumsum(lens)[:-1])), lens, conv, stripe)
    tokens = np.concatenate(([0], np.cumsum(sizes)))
    first_token = np.concatenate(([0], np.cumsum(lens)[:-1]))[order]
    conv, lens, n = conv[order], lens[order], len(order)
    lcp[0] = before
    upto = lambda rows, turns: tokens[first_token[rows] + turns]  # noqa: E731 - bytes of a row's first turns, and a constant of the row
    end_of_leaf = np.append(lcp[1:], after) < lens  # nothing below goes on from here
    crosses = {0: before}
    crosses[n - 1] = max(crosses.get(n - 1, -1), after)  # turns up to which the paths of the two end rows go on outside
    ends = {row: (keys[order[row]], hashlib.sha256()) for row in crosses}
    found, rows = [], np.arange(n)
    parents, parent_conv, parent_key = np.zeros(n, np.int64), [None], [None]  # node of each row in the depth above
    for depth in range(int(lens.max()) + 1):
        reach = lens[rows] >= depth
        rows, parents = rows[reach], parents[reach]
        start = lcp[rows] < depth
        start[0] = True
        heads, node = np.flatnonzero(start), np.cumsum(start) - 1
        sums = lambda x: np.add.reduceat(x.astype(np.int64), heads)
        smallest, ending = np.minimum.reduceat(conv[rows], heads), sums(lens[rows] == depth)
        turns_above = max(depth - 1, 0)
        saved = upto(rows, np.maximum(lcp[rows], turns_above)) - upto(rows, turns_above)  # of turns the row shares with the one before
        key = [None] * len(heads)
        for row, most in crosses.items():
            path, so_far = ends[row]
            if depth <= lens[row]:
                so_far.update(path[turns_above * ID : depth * ID])
            if depth <= min(most, lens[row]):
                key[0 if row == 0 else -1] = so_far.digest()
        texts = [",".join(map(str, conv[r : r + e].tolist())) for r, e in zip(rows[heads].tolist(), ending.tolist(), strict=True)]
        above = parents[heads].tolist()
        found.append(
            {
                "conv_id": smallest,
                "depth": np.full(len(heads), depth),
                "parent_conv_id": [parent_conv[p] if parent_key[p] is None else None for p in above],
                "n_convs": np.diff(np.append(heads, len(rows))),
                "n_children": sums((lens[rows] > depth) & (lcp[rows] <= depth)),
                "n_leaves": sums(end_of_leaf[rows]),
                "saved_tokens": sums(saved),
                "ends_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else NOTHING for t in texts],
                "key": key,
                "parent_key": [parent_key[p] for p in above],
                "shard": np.full(len(heads), shard),
                "ends": [t if k is not None and t else None for t, k in zip(texts, key, strict=True)],
            }
        )
        parents, parent_conv, parent_key = node, smallest.tolist(), key
    column = lambda name: np.concatenate([f[name] for f in found]) if isinstance(found[0][name], np.ndarray) else [x for f in found for x in f[name]]
    types = {"ends_sha256": pa.string(), "ends": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "shard": pa.int32()}
    return pa.table({name: pa.array(column(name), types.get(name, pa.int64())) for name in found[0]})


def trie(convs: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """One row for each distinct beginning of the conversations (conv_id unique and not null, ids, sizes): conv_id, the smallest member;
    depth; parent_conv_id; n_convs, the members; n_children; n_leaves; saved_tokens, what the subtree's nodes save by being kept once, in bytes of text;
    ends_sha256, of the ids of the conversations that end at the node. No conversations give no rows.
    A padded matrix has `stripe` columns.
    """
    spark = convs.sparkSession
    keys = written(convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("ids"), "sizes"), "sequences")
    n_turns = keys.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))
    sharded = written(keys.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    # The ends of each shard, as many rows as there are shards; they are what range partitioning itself keeps on the driver.
    ends = sorted((r["shard"], bytes(r["low"]), bytes(r["high"])) for r in sharded.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high")).collect())
    gaps = [common(a[2], b[1]) for a, b in zip(ends, ends[1:], strict=False)]
    neighbours = {e[0]: (b, a) for e, b, a in zip(ends, [-1, *gaps], [*gaps, -1], strict=True)} if ends else {}

    def nodes(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return shard_nodes(shard, table.column("conv_id").to_numpy(), table.column("ids").to_pylist(), sizes, *neighbours[shard], stripe)

    parts = written(sharded.groupBy("shard").applyInArrow(nodes, PARTS), "nodes")
    own = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    crossing = parts.where("key IS NOT NULL").groupBy("key", "depth", "parent_key").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.array_sort(F.collect_list(F.when(F.col("ends").isNotNull(), F.struct("shard", "ends")))).alias("ends"),
    )
    ids = F.array_join(F.col("ends.ends"), ",").cast("binary")  # shards ascend by conv_id within equal sequences
    crossing = written(crossing.select("key", "parent_key", *own[:-1], F.sha2(ids, 256).alias("ends_sha256")), "crossing")
    parent = crossing.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = parts.where("key IS NULL")
    done = inner.where("parent_key IS NULL").select(*own, "parent_conv_id")
    below = inner.where("parent_key IS NOT NULL").select(*own, "parent_key").unionByName(crossing.select(*own, "parent_key"))
    met = with_small(below, parent, ["parent_key"])
    return done.unionByName(met.select(*own, "parent_conv_id"))
