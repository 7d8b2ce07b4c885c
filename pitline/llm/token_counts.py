"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

The first tier is a table of frequent pre-tokens and their token counts. It is made from a bounded sample of documents and sent
to all workers; it only saves work, and no count depends on which pre-tokens it holds. The second tier is each worker's bounded
cache: a pre-token missing from both is encoded by the library and remembered. A text costs one split and one sum of lookups.

The tokenizer's special strings inside a text are, as in the library's default, one token each, and split the text.
The split itself is done by a pattern whose character classes are older in the library than here for recently assigned
characters; a text with characters beyond the ranges of `STABLE` is split by the library itself.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pitline.llm.bpe import MAX_FILE_BYTES
from pitline.llm.common import by_batch, carried

#: Pre-tokens that a worker's cache holds before it starts anew; a memory bound without effect on results.
CACHE_ENTRIES = 150_000
#: Longer pre-tokens are not kept.
CACHE_LENGTH = 256
#: Documents that the frequent table is made from, about; and its largest number of entries.
SAMPLE_DOCS = 2_000
FREQUENT = 65_536

#: Fixed value: the split of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges in which all versions of the Unicode tables agree on letters, numbers and white space.
STABLE = "\x00-ԯ -⁯₠-₵　-〩ぁ-ゔァ-ヺ一-龥가-힣！-～"

_find_unstable = re.compile(f"[^{STABLE}]").search
_split = regex.compile(SPLIT).findall


class Counts(dict):
    """Token counts of pre-tokens: the frequent table, then a bounded cache in front of the library."""

    def __init__(self, raw: str, frequent: dict[str, int] | None = None):
        super().__init__(frequent or {})
        tokenizer = Tokenizer.from_str(raw)
        settings = json.loads(raw)
        pre = settings.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or settings.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer, self.cache = tokenizer, {}
        special = sorted((t["content"] for t in settings.get("added_tokens", [])), key=len, reverse=True)
        if any(t[k] for t in settings.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take white space along are not handled")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def encoded(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.encoded(piece)
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not _find_unstable(text):
            return _split(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_COUNTS: dict[int, Counts] = {}


class CountTable:
    """The tokenizer file and the frequent pre-tokens with their counts, as broadcasts."""

    def __init__(self, spark: SparkSession, path: str, docs: DataFrame | None = None, text: str = "text"):
        with open(path, encoding="utf-8") as f:
            raw = f.read(MAX_FILE_BYTES + 1)
        if len(raw) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is too large to be sent to all workers")
        self.raw = spark.sparkContext.broadcast(raw)
        self.frequent = None
        if docs is not None:
            self.frequent = spark.sparkContext.broadcast(self.make(docs, text))

    def make(self, docs: DataFrame, text: str) -> pa.Table:
        """Frequent pre-tokens of about SAMPLE_DOCS documents chosen by a hash of their text.

        Every task of the sample sends its own FREQUENT most frequent pre-tokens; their sums are cut to FREQUENT again.
        """
        one_in = max(1, docs.count() // SAMPLE_DOCS)
        sample = docs.select(F.col(text).cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(one_in)) == 0)
        raw = self.raw

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = Counts(raw.value), Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    seen.update(p for p in counts.pieces(t or "") if len(p) <= CACHE_LENGTH)
            top = heapq.nlargest(FREQUENT, ((n, p) for p, n in seen.items() if n > 1))
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p for _, p in top], pa.string()), "n": pa.array([n for n, _ in top], pa.int64())})

        per_task = sample.mapInArrow(run, "piece string, n long")
        best = per_task.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).toArrow()
        pieces = best.column("piece").to_pylist()
        counts = Counts(raw.value)
        lengths = [len(e.ids) for e in counts.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        special = counts.special
        keep = [i for i, p in enumerate(pieces) if special is None or not special.search(p)]
        return pa.table({"piece": pa.array([pieces[i] for i in keep], pa.string()), "n": pa.array([lengths[i] for i in keep], pa.uint16())})

    def counts(self) -> Counts:
        key = self.raw.id if hasattr(self.raw, "id") else hash(self.raw.value)
        if key not in _COUNTS:
            table = self.frequent.value if self.frequent is not None else None
            _COUNTS.clear()
            _COUNTS[key] = Counts(self.raw.value, dict(zip(*(c.to_pylist() for c in table.columns), strict=True)) if table else None)
        return _COUNTS[key]


def count_tokens(docs: DataFrame, table: CountTable, text: str = "text") -> DataFrame:
    """docs as one struct `row`, with `n_bytes` (UTF-8) and `n_tokens` of the whole text, both long.

    A null text counts as empty: zero of both. Repeated rows, null ids and columns of any name pass through inside `row`.
    """

    def run(batch: pa.RecordBatch) -> dict:
        counts = table.counts()
        return {"n_tokens": [counts.count(t) if t else 0 for t in batch.column("llm_text").to_pylist()]}

    added = T.StructType([T.StructField("n_tokens", T.LongType(), False)])
    rows = docs.select(carried(docs), F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("llm_text"))
    return by_batch(rows, run, ["row", "n_bytes"], added)
