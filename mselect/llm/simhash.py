"""Near-duplicates: SimHash fingerprints of word shingles, linked through multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in at most ``distance`` bits differ in at most
``distance // segments`` bits of one of them, so looking up a small Hamming ball around each segment value in a table of
segment values finds every such pair; the full distance is then verified inside the join. Equal fingerprints are one
entry of the tables, whatever the number of their documents.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mselect.llm.common import arrow_map, written


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half of the shingles' XXH64 values. No word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit values."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        bits = np.unpackbits(hashes[i: i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp) for every row; ``fp`` is the fingerprint as a signed long. Null texts have no words."""
    def run(batch: pa.RecordBatch) -> dict:
        values = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
        return {key: batch.column(0), "fp": pa.array(values.view(np.int64))}
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"{key} {kind}, fp long")


def _balls(bits: int, segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(segment, mask, highest bit of the mask): the differences to look up in each segment."""
    width, masks = bits // segments, [(0, 0)]
    for k in range(1, distance // segments + 1):
        masks += [(sum(1 << b for b in at), 1 << at[-1]) for at in combinations(range(width), k)]
    return [(s, m, t) for s in range(segments) for m, t in masks]


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints in ``fps`` (a column ``fp`` of distinct longs) within ``distance`` bits.

    A pair may come once for each segment that finds it. Of two values that differ by a mask just one has the mask's
    highest bit set, and only that one looks up the other.
    """
    if segments < 2 or 64 % segments:
        raise ValueError("segments must divide 64 and be two at least")
    width = 64 // segments
    low = F.lit((1 << width) - 1)

    def value(segment: str):
        return F.expr(f"shiftrightunsigned(fp, cast({segment} * {width} AS int))").bitwiseAND(low)

    balls = ", ".join(f"struct({s} AS seg, {m}L AS mask, {t}L AS top)" for s, m, t in _balls(64, segments, distance))
    asked = fps.select("fp", F.explode(F.expr(f"array({balls})")).alias("ball")).select(
        F.col("fp").alias("a"), F.col("ball.seg").alias("seg"), F.col("ball.mask").alias("mask"),
        F.col("ball.top").alias("top"), value("ball.seg").alias("value")
    ).where((F.col("mask") == 0) | (F.col("value").bitwiseAND(F.col("top")) != 0)).select(
        "a", "mask", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    table = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[F.lit(s) for s in range(segments)])).alias("seg"), "fp").select(
        "b", "seg", value("seg").alias("value"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (
        (F.col("mask") != 0) | (F.col("a") < F.col("b")))
    cond = (asked.seg == table.seg) & (asked.value == table.value) & near
    return asked.join(table, cond).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): the smallest node that each can reach.

    Large-star and small-star steps in turn: each moves edges to smaller neighbours until only stars are left. The edges
    are written after every round; nothing but their count and checksum comes to the driver.
    """
    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            moved.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, segments: int = 2,
                    shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key that links lead to, its own included.

    Rows with equal fingerprints are linked, also those with fingerprint zero (no words). Null keys are passed over when
    the smallest is sought; a component without any other key has a null. Rows stay as many as they are. Other columns of
    ``docs`` are not read.
    """
    rows = written(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    stars = components(links(classes.select("fp"), distance, segments))
    joined = classes.join(stars, classes.fp == stars.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "labels")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = written(joined.join(smallest, "root").select("fp", "component"), "labels")
    return rows.join(labels, "fp").select(key, "fp", "component")
