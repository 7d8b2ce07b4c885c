"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged on its own. The possible merges of a pre-token wait in buckets, one per merge rank, that hold the
positions of their left parts in a linked list of parts. A bitmap with one bit per rank and two summary levels above it finds
the lowest waiting rank by three find-first-set steps, however many ranks there are. Pre-tokens that a worker has not met lately
share one queue, so that finding a bucket is paid once for all places where its rank waits. A merge changes its two neighbours'
ranks by pushing new entries; entries whose position no longer has the bucket's rank are stale and skipped when they come up.
A pre-token of n bytes so costs O(n log n) instead of the O(n^2) of scanning all parts for each merge.

Workers keep the ids of recent pre-tokens in a bounded cache of two generations: a full one becomes the old one, and pre-tokens met again
move from there to the new one without a merge. The ranks travel as one broadcast of the rank file, whose size is checked.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.llm.common import by_batch, carried

#: Largest vocabulary file that is sent to all workers.
MAX_FILE_BYTES = 64 << 20
#: Pre-tokens and their characters that each of the two generations of a worker's cache holds; memory bounds without effect on results.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 4_000_000
#: Characters of text that are split and looked up together.
BLOCK_CHARS = 250_000


class RankQueue:
    """Waiting merges: a bucket of positions for each rank, and a three-level bitmap of the ranks that have one."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        w, m = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, leftmost first; the queue must not be empty (`top` is then non-zero)."""
        m = (self.top & -self.top).bit_length() - 1
        x = self.mid[m]
        w = (m << 6) + (x & -x).bit_length() - 1
        x = self.low[w]
        rank = (w << 6) + (x & -x).bit_length() - 1
        self.low[w] = x = x & (x - 1)
        if not x:
            self.mid[m] = x = self.mid[m] & (self.mid[m] - 1)
            if not x:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Merge ranks of one vocabulary and a cache of packed ids (little-endian unsigned 32-bit) by pre-token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token. A byte without a rank of its own raises KeyError.

        All pre-tokens share one queue: they lie in one buffer, each followed by a gap that no merge crosses, so a bucket serves
        every place where its rank waits.
        """
        if not pieces:
            return []
        buffer = b"\0".join(pieces) + b"\0"
        raw = np.frombuffer(buffer, np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        gaps = np.cumsum(sizes + 1) - 1
        is_gap = np.zeros(len(raw) + 1, bool)
        is_gap[gaps] = True
        first = self.bytes[raw]
        if (first[~is_gap[:-1]] < 0).any():
            raise KeyError("a byte has no rank")
        pair = np.full(len(raw) + 1, -1, np.int64)
        pair[:-2] = self.pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        pair[:-1][is_gap[:-1] | is_gap[1:]] = -1
        gap = is_gap.tobytes()
        after, before = array("q", range(1, len(raw) + 2)), array("q", range(-1, len(raw)))
        waiting, part = array("q", pair.tobytes()), array("q", first.tobytes())  # part: -1 when merged into the one before
        queue, rank_of, buckets = self.queue, self.ranks.get, self.queue.buckets
        starts = np.flatnonzero(pair >= 0)
        starts = starts[np.argsort(pair[starts], kind="stable")]
        cuts = np.flatnonzero(np.diff(pair[starts])) + 1
        for group in np.split(starts, cuts) if len(starts) else ():
            queue.push(int(pair[group[0]]), group.tolist())
        while queue.top:
            rank, bucket = queue.pop()
            for at, i in enumerate(bucket):
                if waiting[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i] = k
                waiting[j] = part[j] = -1
                part[i] = rank
                lowest = rank
                new = None
                if not gap[k]:
                    before[k] = i
                    new = rank_of(buffer[i : after[k]])
                if new is None:
                    waiting[i] = -1
                else:
                    waiting[i] = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        queue.push(new, [i])
                    lowest = min(lowest, new)
                h = before[i]
                if h >= 0 and not gap[h]:
                    new = rank_of(buffer[h:k])
                    if new is None:
                        waiting[h] = -1
                    else:
                        waiting[h] = new
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            queue.push(new, [h])
                        lowest = min(lowest, new)
                if lowest < rank:  # a merge made possible just now comes first
                    queue.push(rank, bucket[at + 1 :] or [i])
                    break
        ids = np.frombuffer(part, np.int64)
        alive = (ids >= 0) & ~is_gap[:-1]
        ends = (np.cumsum(alive)[gaps] * 4).tolist()
        packed = ids[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pre-tokens into the cache. Before it passes its bounds it becomes the old generation and a new one begins."""
        missing = pieces.difference(self.cache)
        size = sum(map(len, missing))
        if len(self.cache) + len(missing) > CACHE_ENTRIES or self.chars + size > CACHE_CHARS:
            self.old, self.cache, self.chars = self.cache, {}, 0
            missing, size = pieces, sum(map(len, pieces))
        self.chars += size
        merged = []
        for piece in missing:
            known = self.old.get(piece)
            if known is not None:
                self.cache[piece] = known
                continue
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)  # a pre-token that is a token is not merged at all
            if whole is None:
                merged.append((piece, raw))
            else:
                self.cache[piece] = whole.to_bytes(4, "little")
        self.cache.update(zip((p for p, _ in merged), self.merge([raw for _, raw in merged]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text. Texts are worked through in blocks of about BLOCK_CHARS; a longer one alone, in parts."""
        out: list[bytes] = []
        block: list[list[str]] = []
        size = 0

        def flush() -> None:
            self.learn(set().union(*block))
            out.extend(b"".join(map(self.cache.__getitem__, pieces)) for pieces in block)
            block.clear()

        for text in texts:
            if size and size + len(text) > BLOCK_CHARS:
                flush()
                size = 0
            if len(text) <= BLOCK_CHARS:
                block.append(self.pattern.findall(text))
                size += len(text)
                continue
            flush()
            size = 0
            parts, matches = [], (m.group() for m in self.pattern.finditer(text))
            while pieces := list(islice(matches, BLOCK_CHARS // 4)):
                self.learn(set(pieces))
                parts += map(self.cache.__getitem__, pieces)
            out.append(b"".join(parts))
        flush()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


_ENCODERS: dict[tuple[int, str], Encoder] = {}


class Vocabulary:
    """A rank file and a splitting pattern, built once in every worker process."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            raw = f.read(MAX_FILE_BYTES + 1)
        if len(raw) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is too large to be sent to all workers")
        self.raw, self.pattern = spark.sparkContext.broadcast(raw), pattern

    def encoder(self) -> Encoder:
        key = (hash(self.raw.value), self.pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(read_ranks(self.raw.value), self.pattern)
        return _ENCODERS[key]


def as_lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as lists of 32-bit integers."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", packed: bool = True) -> DataFrame:
    """docs as one struct `row`, with `ids` of the whole text and `n_tokens` (long).

    ids: binary, little-endian unsigned 32-bit, or array<int> if packed is False. A null text counts as empty: no ids. Repeated rows,
    null ids and columns of any name pass through inside `row`.
    """

    def run(batch: pa.RecordBatch) -> dict:
        ids = vocabulary.encoder().encode([t or "" for t in batch.column("llm_text").to_pylist()])
        return {"ids": ids if packed else as_lists(ids), "n_tokens": [len(x) // 4 for x in ids]}

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    added = T.StructType([T.StructField("ids", kind, False), T.StructField("n_tokens", T.LongType(), False)])
    return by_batch(docs.select(carried(docs), F.col(text).cast("string").alias("llm_text")), run, ["row"], added)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns `keep` and `decoded` (binary): the bytes of the packed ids. Null ids give no bytes; unknown ids raise KeyError."""

    def run(batch: pa.RecordBatch) -> dict:
        encoder = vocabulary.encoder()
        return {"decoded": [encoder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("llm_ids").to_pylist()]}

    added = T.StructType([T.StructField("decoded", T.BinaryType(), False)])
    return by_batch(encoded.select(*keep, F.col(ids).alias("llm_ids")), run, keep, added)
