"""Moments of every pair of columns on the rows where both have a value, as one mergeable aggregate.

A block of rows becomes a matrix; columns that are missing in the same rows share a mask. For two masks the rows that both keep are
centred on their own means and one matrix product gives the sums of all pairs of their columns at once, so no row is copied to
a pair and no large square is subtracted from another. Blocks of one key merge by the pairwise update of means and centred sums.
Each task keeps one running state for a key while its rows come in, so what is shuffled is a state for each key and task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.functions.numeric import finite

#: Keys whose running states a task keeps at once before it hands them on.
OPEN_KEYS = 32


class PairMoments:
    """n, and for column i on the rows where j has a value too (i, j): mean, centred square sum, least and largest value; cross: centred products.

    seen: for each pair and side the states (any 64-bit names) of the first column on those rows, where columns have states.
    """

    def __init__(self, k: int):
        self.n = np.zeros((k, k), np.int64)
        self.mean, self.square, self.cross = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        self.seen: dict[tuple[int, int], set[int]] = {}

    @classmethod
    def of(cls, x: np.ndarray, states: dict[int, np.ma.MaskedArray] = {}) -> PairMoments:  # noqa: B006 - only read
        """Of a block: a row for each row, NaN or infinity where a value is missing. states: of the columns that have them."""
        self = cls(x.shape[1])
        valid = np.isfinite(x)
        groups: dict[bytes, list[int]] = {}
        for i, bits in enumerate(np.packbits(valid, axis=0).T):
            groups.setdefault(bits.tobytes(), []).append(i)
        columns = [np.array(g) for g in groups.values()]
        for a, left in enumerate(columns):
            for right in columns[a:]:
                rows = valid[:, left[0]] & valid[:, right[0]]
                n = int(rows.sum())
                if n:
                    self._fill(x[rows], rows, left, right, n, states)
        return self

    def _fill(self, x: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, states: dict) -> None:
        centred = {}
        for own, other in ((left, right), (right, left)):
            values = x[:, own]
            mean = values.mean(axis=0)
            centred[id(own)] = c = values - mean
            at = np.ix_(own, other)
            self.n[at] = n
            for target, value in ((self.mean, mean), (self.square, (c * c).sum(axis=0)), (self.low, values.min(axis=0)), (self.high, values.max(axis=0))):
                target[at] = value[:, None]
            for i in (i for i in own if i in states):
                names = set(states[i][rows].compressed().tolist())
                for j in other:
                    self.seen[int(i), int(j)] = names
        product = centred[id(left)].T @ centred[id(right)]
        self.cross[np.ix_(left, right)] = product
        self.cross[np.ix_(right, left)] = product.T

    def merge(self, more: PairMoments) -> PairMoments:
        n = self.n + more.n
        weight = np.divide(self.n * more.n.astype(float), n, out=np.zeros(n.shape), where=n > 0)
        step = more.mean - self.mean
        self.square += more.square + weight * step * step
        self.cross += more.cross + weight * step * step.T
        self.mean += step * np.divide(more.n, n, out=np.zeros(n.shape), where=n > 0)
        self.low, self.high, self.n = np.minimum(self.low, more.low), np.maximum(self.high, more.high), n
        for pair, names in more.seen.items():
            self.seen[pair] = self.seen.get(pair, set()) | names
        return self

    ARRAYS = ("mean", "square", "cross", "low", "high")

    def packed(self) -> dict[str, object]:
        seen = [(i, j, name) for (i, j), names in self.seen.items() for name in names]
        return {"n": self.n.ravel()} | {a: getattr(self, a).ravel() for a in self.ARRAYS} | {
            "seen_i": [s[0] for s in seen], "seen_j": [s[1] for s in seen], "seen_name": [s[2] for s in seen],
        }

    @classmethod
    def unpacked(cls, row: dict, k: int) -> PairMoments:
        self = cls(k)
        self.n = np.array(row["n"], np.int64).reshape(k, k)
        for a in cls.ARRAYS:
            setattr(self, a, np.array(row[a], float).reshape(k, k))
        for i, j, name in zip(row["seen_i"], row["seen_j"], row["seen_name"], strict=True):
            self.seen.setdefault((i, j), set()).add(name)
        return self


_STATE = [T.StructField(n, T.ArrayType(t)) for n, t in (
    ("n", T.LongType()), *((a, T.DoubleType()) for a in PairMoments.ARRAYS), ("seen_i", T.IntegerType()), ("seen_j", T.IntegerType()), ("seen_name", T.LongType()),
)]
_PAIR = [T.StructField(n, t) for n, t in (
    ("i", T.IntegerType()), ("j", T.IntegerType()), ("n", T.LongType()), ("mean_i", T.DoubleType()), ("mean_j", T.DoubleType()), ("square_i", T.DoubleType()),
    ("square_j", T.DoubleType()), ("cross", T.DoubleType()), ("varies", T.BooleanType()), ("states_i", T.IntegerType()), ("states_j", T.IntegerType()),
)]


def matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Columns of doubles as a matrix, NaN for null."""
    return np.column_stack([np.asarray(batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy(), float) for n in names])


def runs_of(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers) for each key of a batch."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        each = batch.column(key).dictionary_encode()
        code = code * (len(each.dictionary) + 1) + np.asarray(each.indices.fill_null(len(each.dictionary)))
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
        yield tuple(batch.column(key)[int(rows[0])].as_py() for key in keys), rows


def pair_moments(wide: DataFrame, keys: list[str], columns: dict[str, Column], states: dict[str, str] | None = None) -> DataFrame:
    """One row for each key and pair i <= j of the named columns: n, mean, centred sums, whether both vary, distinct states of each side.

    NaN and infinities count as missing. Every pair of every key has a row. `states` gives for some of them the column of
    `wide` that numbers (64 bits) the state a value belongs to.
    """
    names, k = [f"x{i}" for i in range(len(columns))], len(columns)
    state_of = {i: states[c] for i, c in enumerate(columns) if c in states} if states else {}
    rows = wide.select(*keys, *[finite(c.cast("double")).alias(n) for n, c in zip(names, columns.values(), strict=True)], *sorted(set(state_of.values())))
    key_fields = [rows.schema[c] for c in keys]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_states: dict[tuple, PairMoments] = {}

        def hand_on(some: dict[tuple, PairMoments]) -> pa.RecordBatch:
            packed = [m.packed() for m in some.values()]
            arrays = [pa.array([key[i] for key in some], t) for i, t in enumerate(key_types)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([p[f] for p in packed], pa.list_(t)) for f, t in fields], names=[*keys, *[f for f, _ in fields]])

        for batch in batches:
            x = matrix(batch, names) if k else np.zeros((batch.num_rows, 0))
            named = {}
            for s in set(state_of.values()):
                column = batch.column(s)
                named[s] = np.ma.MaskedArray(column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False))
            for key, at in runs_of(batch, keys):
                block = PairMoments.of(x[at], {i: named[s][at] for i, s in state_of.items()})
                open_states[key] = open_states[key].merge(block) if key in open_states else block
            if len(open_states) > OPEN_KEYS:
                last = key
                yield hand_on({a: m for a, m in open_states.items() if a != last})
                open_states = {last: open_states[last]}
        if open_states:
            yield hand_on(open_states)

    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(f.dataType) for f in key_fields]
    fields = [(f.name, to_arrow_type(f.dataType.elementType)) for f in _STATE]
    upper = np.triu_indices(k)

    def finish(table: pa.Table) -> pa.Table:
        parts = [PairMoments.unpacked(r, k) for r in table.select([f for f, _ in fields]).to_pylist()]
        m = parts[0]
        for more in parts[1:]:
            m.merge(more)
        i, j = upper
        moving = m.high > m.low
        out = {
            "i": i, "j": j, "n": m.n[upper], "mean_i": m.mean[i, j], "mean_j": m.mean[j, i], "square_i": m.square[i, j], "square_j": m.square[j, i],
            "cross": m.cross[upper], "varies": moving[i, j] & moving[j, i],
            "states_i": [len(m.seen.get(p, ())) for p in zip(i.tolist(), j.tolist(), strict=True)],
            "states_j": [len(m.seen.get(p, ())) for p in zip(j.tolist(), i.tolist(), strict=True)],
        }
        same = {key: pa.array([table.column(key)[0].as_py()] * len(i), t) for key, t in zip(keys, key_types, strict=True)}
        return pa.table(same | {f.name: pa.array(out[f.name], to_arrow_type(f.dataType)) for f in _PAIR})

    parts = rows.mapInArrow(fold, T.StructType([*key_fields, *_STATE]))
    return parts.groupBy(*keys).applyInArrow(finish, T.StructType([*key_fields, *_PAIR]))


def correlation() -> Column:
    """Pearson's coefficient of a row of pair_moments; null where a side is constant."""
    return F.when(F.col("varies"), F.try_divide(F.col("cross"), F.sqrt("square_i") * F.sqrt("square_j")))
