"""Exact top-k by integer inner product with a pivot-distance index.

With M the largest squared norm, a vector x becomes (x, sqrt(M - |x|^2)) and a query q becomes (q, 0): their squared distance
|q|^2 + M - 2 q.x falls as the inner product rises, so the largest products are the nearest points and distances obey the
triangle inequality. Every vector is keyed by its nearest pivot and its distance r from it, in cells of one pivot and an annulus
of fixed width. A cell with more rows than BLOCK is split by a hash of the id, so equal vectors never pile up in one task.

First every block answers for the queries that lie in it: the k-th best product found there bounds the radius t within which
anything better must be. A query then goes to the blocks of those annuli that meet [d - t, d + t], d being its distance from the
pivot, and within a block, sorted by r, the scan expands from the query's own annulus to these bounds and stops. Queries travel in
groups; a block is read once and queries stream past it. What beats the bound is ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitline.llm.common import with_small, written

SCALE = 256
PIVOTS = 32
SAMPLE = 512  # vectors that pivots are chosen from
ANNULI = 64  # of equal width up to the largest possible distance
BLOCK = 1024
GROUP = 512  # queries that travel together
SLACK = 1e-6  # relative, far above rounding and far below a step of the integer product at usual sizes


def quantised(vectors: DataFrame, id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components floor(scale * x) as longs; rows with a null id, a null vector or null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """Up to k different points of a sample, each the farthest from those before."""
    chosen = [0]
    d = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


class Space:
    """Dimension, largest squared norm and pivots of an index; turns packed integers into points."""

    def __init__(self, dims: int, most: float, largest: int, pivots: np.ndarray):
        self.dims, self.most, self.pivots = dims, most, pivots
        self.type = "<i4" if largest < 1 << 31 else "<i8"
        self.exact = float(largest) ** 2 * max(1, dims) < 1 << 53  # products are exact in doubles
        self.width = 2 * np.sqrt(most) / ANNULI or 1.0

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.dims), np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def points(self, m: np.ndarray) -> np.ndarray:
        x = m.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))[:, None]])

    def queries(self, m: np.ndarray) -> np.ndarray:
        return np.hstack([m.astype(np.float64), np.zeros((len(m), 1))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From every point to every pivot."""
        d = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0.0, d))

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if self.exact else q @ x.T

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.type).reshape(-1, self.dims).astype(np.int64) if self.dims else np.zeros((0, 0), np.int64)

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a product equals `score`, with slack."""
        return np.sqrt(np.maximum(0.0, (q.astype(np.float64) ** 2).sum(axis=1) + self.most - 2 * score)) + SLACK * (1 + np.sqrt(self.most))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids, each id once."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    order = some[np.lexsort((ids[some], -scores[some]))]
    _, first = np.unique(ids[order], return_index=True)
    if len(first) < k and len(some) < len(ids):  # repeated rows filled the places
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def top_k(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query with all other rows.

    Queries are the rows whose id is divisible by `every`. Ties go to smaller ids; a query with fewer candidates returns all. Rows with a
    null id, a null vector, or null or non-finite components take no part. A vector that is shorter than others counts as ending in
    zeros. Rows that repeat an id are one candidate, with their best score, and one query each, ranked together; a row is never a
    candidate for its own id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id, vector, scale), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    dims, most, largest = rows.agg(F.max(F.size("v")), F.max(squares), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)))).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(dims, float(most), int(largest), np.zeros((1, dims + 1)))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]  # at most SAMPLE vectors
    space.pivots = farthest_first(space.points(space.matrix(sample)), PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = space.matrix(batch.column(1).to_pylist())
            d = space.distances(space.points(m))
            pivot = d.argmin(axis=1)
            r = d[np.arange(len(m)), pivot]
            packed = [x.tobytes() for x in m.astype(space.type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(pivot, pa.int32()), pa.array(r), pa.array((r // space.width).astype(np.int32))], names=["id", "v", "pivot", "r", "annulus"])

    keyed = written(rows.mapInArrow(key, "id long, v binary, pivot int, r double, annulus int"), "keyed")
    # at most PIVOTS * (ANNULI + 1) cells
    cells = written(keyed.groupBy("pivot", "annulus").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "cells")
    places = [(c["pivot"], c["annulus"], c["salts"]) for c in cells.collect()]
    block = F.concat_ws("/", "pivot", "annulus", F.pmod(F.xxhash64("id"), F.col("salts")).cast("string")).alias("block")
    placed = with_small(keyed, cells, ["pivot", "annulus"], "inner").select(block, "id", "v", "r", (F.pmod("id", F.lit(every)) == 0).alias("asks"))

    def answer(table: pa.Table) -> pa.Table:
        """One block: its vectors sorted by r (kind 0) and its queries with the bound found here (kind 1)."""
        table = table.sort_by("r")
        ids, m = table.column("id").to_numpy(), space.unpack(b"".join(table.column("v").to_pylist()))
        name = table.column("block")[0].as_py()
        out = [{"block": name, "kind": 0, "ids": ids.astype("<i8").tobytes(), "v": m.astype(space.type).tobytes(), "extra": table.column("r").to_numpy().tobytes()}]
        asking = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        if len(asking):
            scores, bounds = space.products(m[asking], m), np.full(len(asking), np.nan)
            for n, q in enumerate(asking):
                others = np.flatnonzero(ids != ids[q])
                top = others[best(ids[others], scores[n, others], k)] if len(others) else others
                if len(top) == k:
                    bounds[n] = scores[n, top[-1]]
            out.append({"block": name, "kind": 1, "ids": ids[asking].astype("<i8").tobytes(), "v": m[asking].astype(space.type).tobytes(), "extra": bounds.tobytes()})
        return pa.Table.from_pylist(out, BLOCKS)

    blocks = written(placed.groupBy("block").applyInArrow(answer, "block string, kind int, ids binary, v binary, extra binary"), "blocks")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of queries to the blocks that may hold something better than their bounds."""
        ids, m, bounds = [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            i, q, b = np.concatenate(ids), np.concatenate(m), np.concatenate(bounds)
            ids.clear(), m.clear(), bounds.clear()
            t = np.where(np.isnan(b), np.inf, space.radius(q, np.nan_to_num(b)))
            d = space.distances(space.queries(q))
            for pivot, annulus, salts in places:
                low, high = annulus * space.width, (annulus + 1) * space.width
                goes = (d[:, pivot] - t <= high) & (d[:, pivot] + t >= low)
                if goes.any():
                    extra = np.column_stack([b[goes], t[goes], d[goes, pivot]]).tobytes()
                    row = {"kind": 1, "ids": i[goes].astype("<i8").tobytes(), "v": q[goes].astype(space.type).tobytes(), "extra": extra}
                    for at in range(0, salts, 256):
                        yield pa.RecordBatch.from_pylist([row | {"block": f"{pivot}/{annulus}/{s}"} for s in range(at, min(salts, at + 256))], BLOCKS)

        for batch in batches:
            for r in batch.to_pylist():
                ids.append(np.frombuffer(r["ids"], "<i8"))
                m.append(space.unpack(r["v"]) if space.dims else np.zeros((len(ids[-1]), 0), np.int64))
                bounds.append(np.frombuffer(r["extra"]))
                if sum(map(len, ids)) >= GROUP:
                    yield from out()
        if ids:
            yield from out()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks in order, each followed by the groups of queries that it must answer."""
        name = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    name, ids, r = row["block"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["extra"])
                    x = space.unpack(row["v"]) if space.dims else np.zeros((len(ids), 0), np.int64)
                    continue
                if row["block"] != name:
                    continue  # a salt that no row fell to
                asked = np.frombuffer(row["ids"], "<i8")
                q = space.unpack(row["v"]) if space.dims else np.zeros((len(asked), 0), np.int64)
                b, t, d = np.frombuffer(row["extra"]).reshape(-1, 3).T
                low, high = np.searchsorted(r, d - t, "left"), np.searchsorted(r, d + t, "right")
                a, z = int(low.min()), int(high.max())
                scores = space.products(q, x[a:z])
                found = []
                for n in np.flatnonzero((high > low) & (np.isnan(b) | (scores.max(axis=1, initial=np.iinfo(np.int64).min) >= b))):
                    part = scores[n, low[n] - a : high[n] - a]
                    some = np.flatnonzero((ids[low[n] : high[n]] != asked[n]) & ((part >= b[n]) | np.isnan(b[n])))
                    top = some[best(ids[low[n] + some], part[some], k)] if len(some) else some
                    found.append((np.full(len(top), asked[n]), ids[low[n] + top], part[top]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    columns = "block string, kind int, ids binary, v binary, extra binary"
    asked = blocks.where("kind = 1").mapInArrow(probe, columns)
    met = blocks.where("kind = 0").unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(scan, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


BLOCKS = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("extra", pa.binary())])
