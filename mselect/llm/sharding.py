"""Shards of nearly equal size by longest processing time: groups go, largest first, to the shard with the least load.

Groups of one size are interchangeable, so scheduling sees sizes with their numbers of groups. Different sizes that add up to
B bytes are fewer than the square root of 2 B, whatever the number of rows; these alone come to the driver. Which group of a size goes where
follows from its number among them, and Spark numbers groups and rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mselect.llm.common import blocks_for, numbered, written


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first, end): groups number ``first`` up to ``end`` of a size go to a shard. ``classes``: (size, groups).

    The same loads as putting group after group on the least loaded shard. Of many groups of one size, all those that come before some
    load level are placed at once, and the heap places the rest.
    """
    loads, out = [0] * shards, []
    for size, groups in sorted(classes, reverse=True):
        def below(level: int) -> list[int]:
            return [(level - load) // size + 1 if load <= level else 0 for load in loads]

        low, high = min(loads) - 1, max(loads) + size * groups
        while low < high:  # the highest level below which no more than ``groups`` find their place
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(below(level)) <= groups else (low, level - 1)
        given = below(low)
        heap = [(load + size * k, shard) for shard, (load, k) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(groups - sum(given)):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            given[shard] += 1
        first = 0
        for shard, k in enumerate(given):
            if k:
                out.append((size, shard, first, first + k))
                loads[shard] += size * k
                first += k
    return out


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; rows of equal texts stay together.

    ``size`` is the text's UTF-8 bytes plus 1; ``slot`` numbers the rows of a shard from 0 without gaps. Null texts are one group of
    size 1 a row with no checksum but 0's (that of no bytes); rows with null or repeated keys are rows like others. Other columns
    aren't read.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = written(docs.select(
        F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("_group")), "rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    sizes = groups.groupBy("_total").agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).collect()
    chosen = rows.sparkSession.createDataFrame(
        schedule([(r["_total"], r["n"]) for r in sizes], shards), "_size long, shard int, _first long, _end long")
    blocks = blocks_for(max((r["n"] for r in sizes), default=0))
    ranked = numbered(groups.select("_group", "_total"), ["_total"], F.col("_group"), ["_group"], blocks, "_rank")
    where = ranked.join(chosen, (F.col("_total") == F.col("_size")) & (F.col("_rank") >= F.col("_first"))
                        & (F.col("_rank") < F.col("_end"))).select("_group", "shard")
    placed = written(rows.join(written(where, "groups"), "_group").drop("_group"), "placed")
    return numbered(placed, ["shard"], F.struct(key, "text_crc32"), [key, "text_crc32", "size"],
                    blocks_for(sum(r["rows"] for r in sizes) // shards), "slot")
