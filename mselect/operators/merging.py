"""Weighted sums of long vectors in levels: inside each partition, then over salted groups, then over salts.

Vectors travel as chunks of packed numbers. Each level sorts its partitions by (key, chunk) and streams, so a task holds one sum, however
many vectors a key has, and no group ever has one chunk of every vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
SALTS = 16


def _vector(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """A row's numbers, nulls as zeros, and which are there."""
    own = column.slice(row, 1).flatten()
    there = np.asarray(own.is_valid())
    return own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), there


class _Sum:
    """Weighted sum and weight of each place of one key's vectors, which may differ in length."""

    def __init__(self):
        self.s, self.n = np.zeros(0), np.zeros(0)

    def add(self, s: np.ndarray, n: np.ndarray) -> None:
        if len(s) > len(self.s):
            self.s, self.n = (np.pad(x, (0, len(s) - len(x))) for x in (self.s, self.n))
        self.s[: len(s)] += s
        self.n[: len(n)] += n


def merged_chunks(states: DataFrame, keys: Sequence[str] = (), n: str = "n", w: str = "w", chunk: int = CHUNK, salts: int = SALTS) -> DataFrame:
    """(keys, chunk, s, m): for each chunk of places the sums of n * w and of n.

    A null weight adds nothing. A null number adds to the weights alone, a null vector nothing at all. Vectors may differ in length; each place
    has the sums of the vectors that reach it.
    """
    ship = [f"{k} {states.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*ship, "chunk int, salt int, s array<double>, m array<double>"])
    names = [*keys, "chunk", "salt", "s", "m"]

    def rows(kinds: list[pa.DataType], key: tuple, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        size = len(parts)
        numbers, salt, s, m = zip(*parts)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k] * size, t) for k, t in zip(key, kinds)), pa.array(numbers, pa.int32()), pa.array(salt, pa.int32()),
             pa.array(s, pa.list_(pa.float64())), pa.array(m, pa.list_(pa.float64()))], names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, at, total, kinds = TaskContext.get().partitionId() % salts, None, _Sum(), []

        def done() -> Iterator[pa.RecordBatch]:
            for c, i in enumerate(range(0, len(total.s), chunk)):
                yield rows(kinds, at, [(c, salt, total.s[i: i + chunk], total.n[i: i + chunk])])
        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(keys)]
            own_keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * batch.num_rows
            weights = batch.column(len(keys)).fill_null(0).to_pylist()
            for row, key in enumerate(own_keys):
                if key != at:
                    if at is not None:
                        yield from done()
                    at, total = key, _Sum()
                v, there = _vector(batch.column(len(keys) + 1), row)
                total.add(weights[row] * np.where(there, v, 0), np.full(len(v), float(weights[row])))
        if at is not None:
            yield from done()

    def level(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total, kinds = None, _Sum(), []
            width = len(keys)
            for batch in batches:
                kinds = [f.type for f in batch.schema][:width]
                for row, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(width + 2)))):
                    key = key[: width + 1] if last else key
                    if key != at:
                        if at is not None:
                            yield rows(kinds, at[:width], [(at[width], 0 if last else at[width + 1], total.s, total.n)])
                        at, total = key, _Sum()
                    total.add(*(_vector(batch.column(i), row)[0] for i in (width + 2, width + 3)))
            if at is not None:
                yield rows(kinds, at[:width], [(at[width], 0 if last else at[width + 1], total.s, total.n)])
        return run

    bare = states.select(*keys, F.col(n).cast("double").alias("_n"), F.col(w).cast("array<double>").alias("_w"))
    out = (bare.sortWithinPartitions(*keys) if keys else bare).mapInArrow(within, schema)
    out = out.repartition(*keys, "chunk", "salt").sortWithinPartitions(*keys, "chunk", "salt").mapInArrow(level(False), schema)
    out = out.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk").mapInArrow(level(True), schema)
    return out.drop("salt")


def merged_vectors(states: DataFrame, keys: Sequence[str], n: str = "n", w: str = "w") -> DataFrame:
    """(keys, w): the weighted mean of each key's vectors as floats; places without weight are null. A key's vector comes together only here."""
    mean = F.zip_with("s", "m", lambda s, m: (s / F.nullif(m, F.lit(0.0))).cast("float"))
    return merged_chunks(states, keys, n, w).select(*keys, "chunk", mean.alias("part")).groupBy(*keys).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda c: c["part"])).alias("w"))
