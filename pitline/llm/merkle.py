"""A Merkle tree for each part of a dataset and one over the parts' roots, as a persistent tree whose versions copy paths.

Nodes are grouped by FANOUT into runs, level by level. A task holds an aligned block: FANOUT**LEVELS consecutive nodes of a tree and the LEVELS
levels over them. The tops of the blocks are the nodes of the next round, until each tree has one node; a round divides their number
by the size of a block. No group is larger than a block, however large a tree is, and places come from sorted ranges and their counts.

Changing a leaf makes a version: its ancestors within the block are copied with their new digests, all other nodes are those of
the original tree. The version goes on in the upper rounds by the path of its block's top, which every version of the block shares, so
versions are dealt by block and never meet at the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.llm.common import with_small, written

FANOUT = 16
LEVELS = 3  # of a block

STEP = "struct<before: string, after: string>"  # the siblings' digests left and right of a node, joined
PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool, height: int) -> list[list[str]]:
    """The levels from nodes up: to a single node if they are a whole tree, else `height` of them."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return levels


def path_of(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """(before, after) of a node and its ancestors, up to below the top."""
    steps = []
    for level in levels[:-1]:
        start = place - place % FANOUT
        steps.append(("".join(level[start:place]), "".join(level[place + 1 : start + FANOUT])))
        place //= FANOUT
    return steps


def copied_path(node: str, steps: list[tuple[str, str]]) -> list[str]:
    """The new digests of a node's ancestors if `node` stands at the foot of the path; the siblings are shared."""
    copies = []
    for before, after in steps:
        node = digest(before + node + after)
        copies.append(node)
    return copies


def record(columns: list[Column]) -> Column:
    """What is hashed for a row: for each value its UTF-8 byte count, a colon and the value, or - for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree and others) with pos, their place in their tree by `order`, and n, the rows of the tree. Equal rows get places of their own.

    Sorted ranges of the whole table give each row its number within the range; the counts of trees in ranges give the rest.
    """
    numbered = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    spread = numbered.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    spread = written(spread.withColumn("at", F.monotonically_increasing_id()), "ranges")  # partition << 33 | row of the partition
    part = F.shiftright("at", 33).alias("part")
    counts = spread.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    so_far = F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = written(counts.select("tree", "part", "first", (so_far - F.col("rows")).alias("start"), F.sum("rows").over(of_tree).alias("n")), "starts")
    met = with_small(spread.withColumn("part", part), starts, ["tree", "part"], "inner")
    return met.withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "first", "start")


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def block_levels(table: pa.Table, height: int) -> list[list[str]]:
    return levels_of(table.column("digest").to_pylist(), table.column("n")[0].as_py() <= FANOUT**height, height)


def block_of(height: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**height).alias("block")


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The next round's nodes (tree, n, pos, digest): the top of each block."""

    def top(table: pa.Table) -> pa.Table:
        table = in_order(table)
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        return pa.table({"tree": table.column("tree").slice(0, 1), "n": [-(-n // FANOUT**height)], "pos": [block], "digest": [block_levels(table, height)[-1][0]]})

    by_block = nodes.select("tree", "n", "pos", "digest", block_of(height)).groupBy("tree", "block")
    return by_block.applyInArrow(top, "tree string, n long, pos long, digest string")


def rounds_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The rounds from nodes (tree, n, pos, digest) up; the last one has one node for each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(written(tops(rounds[-1], height), "tops"))
    return rounds


def paths(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of nodes, from those of their blocks' tops."""

    def down(below: pa.Table, above: pa.Table) -> pa.Table:
        below = in_order(below)
        levels, more = block_levels(below, height), [(s["before"], s["after"]) for s in above.column("path")[0].as_py()]
        steps = [[{"before": b, "after": a} for b, a in path_of(levels, i) + more] for i in range(below.num_rows)]
        same = lambda name: pa.array([above.column(name)[0].as_py()] * below.num_rows, pa.string())
        return pa.table({"tree": below.column("tree"), "pos": below.column("pos"), "path": pa.array(steps, PATH), "subroot": same("subroot"), "root": same("root")})

    blocks = nodes.select("tree", "n", "pos", "digest", block_of(height)).groupBy("tree", "block")
    above = upper.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    return blocks.cogroup(above).applyInArrow(down, f"tree string, pos long, path array<{STEP}>, subroot string, root string")


def upper_paths(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of the blocks of nodes: through the rounds of their tree, then through the tree of subroots."""
    rounds = rounds_of(written(tops(nodes, height), "tops"), height)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("part_of"), "digest")
    top = written(placed(subroots, ["part_of"]), "subroots")
    top_rounds = rounds_of(top, height)
    at_root = top_rounds[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.expr(f"CAST(array() AS array<{STEP}>)").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    upper = at_root
    for each in reversed(top_rounds):
        upper = written(paths(each, upper, height), "paths")
    joined = with_small(top.select("pos", "part_of", F.col("digest").alias("sub")), upper.select("pos", "path", "root"), ["pos"], "inner")
    upper = joined.select(F.col("part_of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("sub").alias("subroot"), "root")
    for each in reversed(rounds):
        upper = written(paths(each, upper, height), "paths")
    return upper


PATH_TYPE = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
VERSION = [
    *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
    T.StructField("verified", T.BooleanType()),
    T.StructField("copies", T.ArrayType(T.StringType())),
    T.StructField("proof", PATH_TYPE),
]


def manifest(docs: DataFrame, columns: list[Column], id: str = "doc_id", tree: str = "source", changed: Column | None = None, proofs: bool = False, height: int = LEVELS) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified, copies and, if asked for, proof.

    A leaf is the SHA-256 of the row's `columns`. `tree` names the column whose values have a tree each (null has one too and comes first);
    leaves ascend by id (null first), equal ids by leaf. `changed` is the record of a tampered row, or null where a row is untouched. folded_root is
    the root that the tampered, else the original leaf gives with the original siblings, `copies` the digests of the nodes that this version copies,
    from the leaf's parent to the root; for an untouched row there are none. An empty table gives an empty result. Digests are lowercase hex.
    A task holds FANOUT**height leaves. Only the id, the tree's name and 64 bytes a row are shuffled, never the texts.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{tree}`").cast("string")), F.lit("0"))
    other = F.lit(None).cast("string") if changed is None else changed
    hashed = lambda text: F.unhex(F.sha2(text.cast("binary"), 256))
    leaves = docs.select(key.alias("tree"), F.col(f"`{id}`").alias("id"), hashed(record(columns)).alias("leaf"), hashed(other).alias("other"))
    nodes = written(placed(leaves, ["id", "leaf"]), "placed")
    digests = nodes.select("tree", "n", "pos", F.lower(F.hex("leaf")).alias("digest"))
    upper = upper_paths(digests, height)

    def finish(below: pa.Table, above: pa.Table) -> pa.Table:
        below = in_order(below)
        levels = block_levels(below, height)
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        more = [(s["before"], s["after"]) for s in above.column("path")[0].as_py()]
        upper_text = "".join(b + a for b, a in more)
        out = {name: [] for name in ("proof_sha256", "folded_root", "copies", "proof")}
        for i, (leaf, new) in enumerate(zip(levels[0], below.column("other").to_pylist(), strict=True)):
            inside = path_of(levels, i)
            out["proof_sha256"].append(digest("".join(b + a for b, a in inside) + upper_text))
            foot = leaf if new is None else new.hex()
            copies = copied_path(foot, inside)  # the block's copied ancestors, then those of the upper rounds
            copies += copied_path(copies[-1] if copies else foot, more)
            out["folded_root"].append(copies[-1] if copies else foot)
            out["copies"].append([] if new is None else copies)
            out["proof"].append([{"before": b, "after": a} for b, a in inside + more] if proofs else None)
        return pa.table(
            {
                "id": below.column("id"),
                "leaf": pa.array(levels[0], pa.string()),
                "subroot": pa.array([subroot] * below.num_rows, pa.string()),
                "root": pa.array([root] * below.num_rows, pa.string()),
                "proof_sha256": out["proof_sha256"],
                "folded_root": out["folded_root"],
                "verified": [f == root for f in out["folded_root"]],
                "copies": pa.array(out["copies"], pa.list_(pa.string())),
                "proof": pa.array(out["proof"], PATH),
            }
        )

    blocks = nodes.select("tree", "n", "pos", "id", "other", F.lower(F.hex("leaf")).alias("digest"), block_of(height))
    above = upper.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *VERSION])
    found = blocks.groupBy("tree", "block").cogroup(above).applyInArrow(finish, schema)
    return found if proofs else found.drop("proof")
