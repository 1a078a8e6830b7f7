"""Small helpers of the operators: written tables, Arrow maps, numbers for rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mselect.session import ensure_checkpoint_dir


def shared_path(df: DataFrame, what: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there when executors are lost."""
    path = shared_path(df, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the table that ``parted`` sends: at most 2**18 words of 64, whatever the input.
PLACE_BITS = 24


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` is surely not in ``ids``, and those whose key may be; null keys are among the first.

    A table of hashed bits tells them apart where they lie, so that only the second, those of ``ids`` and few others, need a join that moves them.
    """
    place = f"(xxhash64(`{key}`) & {(1 << PLACE_BITS) - 1})"
    word, bit = F.expr(f"shiftright({place}, 6)"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))")
    table = ids.select(F.col(key).cast(rows.schema[key].dataType)).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    told = rows.join(F.broadcast(table), word == F.col("_word"), "left")
    may = F.col(key).isNotNull() & (F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(bit) != 0)
    return told.where(~may).select(*rows.columns), told.where(may).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``ids``; null keys stay. Rows that are surely not there aren't moved."""
    clear, doubtful = parted(rows, ids, key)
    return clear.unionByName(doubtful.join(ids.select(key), key, "left_anti"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Run ``fn`` on each Arrow batch; it returns the columns of ``schema`` by name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, keys: Sequence[str], spread: Column, order: Sequence[str | Column], blocks: int,
             name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, however many a key has.

    Rows are dealt over ``blocks`` blocks a key by the hash of ``spread``; a block is numbered by itself, and the counts of
    the blocks before it are added. No task sees more than a block of a key. The order is (block, ``order``): the same in
    every run, if ``order`` tells rows apart or rows that it doesn't tell apart are interchangeable.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(spread), F.lit(blocks)))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (df.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, [*keys, "_block"])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_inside", "_before"))


def blocks_for(rows: int, each: int = 50_000) -> int:
    """Blocks of about ``each`` rows."""
    return max(1, -(-rows // each))
