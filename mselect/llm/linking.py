"""Components of a similarity join from candidate keys, without the pairs of a group.

Candidates are nodes that share a key. First each node meets the smallest node of its keys, then the smallest of every key, and
last whatever still has different components under a key; each round's links are decided on the whole sets and merged before
the next. So a group of near copies costs a few comparisons a node, and only what stands apart from it is compared further.
Sets are read once, for nodes with a shared key alone, which a bit table of fixed size lets pass; false hits cost time, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from mselect.llm import words
from mselect.llm.common import written
from mselect.llm.simhash import components

#: Bits of a bit table: 2 MB, whatever the input.
TABLE_BITS = 24
#: Tasks that one node's comparisons are dealt over at most.
SALTS = 16


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits that the longs in column ``h`` set, as bytes; the driver sees at most 2**18 words of them."""
    place = F.col("h").bitwiseAND((1 << TABLE_BITS) - 1)
    parts = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for batch in parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.view(np.uint8)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.int64((1 << TABLE_BITS) - 1)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(column: pa.Array, powers: words.Powers, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted different shingle hashes of each text) of slices of a column."""
    for row, data, offsets in words.slices(column):
        starts, ends, first = words.word_spans(data, offsets)
        hashes = words.word_hashes(data, starts, ends, powers)
        yield row, [words.distinct_shingles(hashes[a:b], shingle) for a, b in zip(first[:-1], first[1:])]


def node_of(own: np.ndarray) -> int:
    """64 bits that tell sets apart: the node of all texts with this set."""
    total = words.mix(own + words._BASE).sum(dtype=np.uint64, keepdims=True)
    return int(words.mix(total + np.uint64(len(own))).view(np.int64)[0])


def sets_by_node(docs: DataFrame, chosen: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(node, shingles): the sets of ``chosen`` (node, h: the hash of the key of a row that has the set), as the bytes of sorted hashes."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(chosen.select("h")).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = words.Powers(), np.frombuffer(table.value, np.uint8)
        for batch in batches:
            own = batch.filter(pa.array(may_hold(bits, batch.column(0).to_numpy())))
            for row, sets in sets_of(own.column(1), powers, shingle):
                nodes, hashes = np.array([node_of(s) for s in sets], np.int64), own.column(0).to_numpy()[row: row + len(sets)]
                first = np.unique(nodes ^ (hashes * 3), return_index=True)[1]  # repeated rows once
                yield pa.RecordBatch.from_arrays([pa.array(nodes[first]), pa.array(hashes[first]),
                                                  pa.array([sets[i].tobytes() for i in first], pa.binary())], ["node", "h", "shingles"])
    rows = docs.select(F.xxhash64(key).alias("h"), F.col(text).alias("_text"))
    # joined on the node alone, so that the sets are dealt once for the join and the groups
    found = rows.mapInArrow(run, "node long, h long, shingles binary").join(chosen.withColumnRenamed("h", "_h"), "node").where("(h ^ _h) = 0")
    return written(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


#: Words of an odd sketch.
ODD_WORDS = 8
ODD = [f"k{i}" for i in range(ODD_WORDS)]


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """512 bits: which cells an odd number of values falls in. Sketches of two sets differ in no more bits than values are in one set alone."""
    cells = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=64 * ODD_WORDS)
    return np.packbits(cells & 1, bitorder="little").view(np.int64)


def room_for(similar: int, p: str, q: str) -> Column:
    """Whether sizes and odd sketches, in columns with the prefixes p and q, leave room for a Jaccard similarity of ``similar`` hundredths.

    No pair of that similarity fails.
    """
    n, m = F.col(f"{p}n"), F.col(f"{q}n")
    apart = reduce(add, [F.bit_count(F.col(p + k).bitwiseXOR(F.col(q + k))) for k in ODD])
    return (100 * F.least(n, m) >= similar * F.greatest(n, m)) & ((100 + similar) * apart <= (100 - similar) * (n + m))


def same_part(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def _verified(pairs: DataFrame, sets: DataFrame, similar: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The pairs (a, b) whose sets are similar. The set of ``a`` is sent once to each of ``SALTS`` tasks at most, that of ``b`` once a pair."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    none = F.lit(None).cast("long")
    hubs = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", none.alias("b"), "shingles")
    members = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            firsts, seconds = [], []
            for a, salt, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if b is None:
                    at, hub = (a, salt), own.copy()
                elif at == (a, salt) and similar(hub, own):
                    firsts.append(a)
                    seconds.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64())], ["a", "b"])
    both = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long")


def settle(keys: DataFrame, sketches: DataFrame, possible: Callable[[str, str], Column], sets: Callable[[DataFrame], DataFrame],
           similar: Callable[[np.ndarray, np.ndarray], bool], first: Callable[[str, str], Column] | None = None,
           before: DataFrame | None = None) -> DataFrame:
    """(node, root): every node that shares a key or is in a pair of ``before``, with the smallest node that links lead to.

    keys: (node, key) longs. before: (a, b), different nodes that are compared before all others. sketches: (node, ...) of all nodes. possible(p, q): whether the sketches of two nodes, whose columns have the
    prefixes p and q, leave room for a link. sets(nodes): (node, shingles) of ``nodes``. similar(x, y): the verdict on two sets. first(p, q):
    whether ``key`` is the first that two nodes share, so that they are compared under it alone.
    """
    # keys are dealt once, for their smallest and largest node and for the entries themselves
    group = Window.partitionBy("key")
    hubs = keys.select("key", "node", F.min("node").over(group).alias("hub"), F.max("node").over(group).alias("last"))
    entries = written(hubs.where("hub <> last").drop("last"), "entries")
    met = entries.select("node")
    if before is not None:
        before = written(before, "before")
        met = met.unionByName(before.select(F.col("a").alias("node"))).unionByName(before.select(F.col("b").alias("node")))
    nodes = written(met.distinct(), "nodes")
    held, own = sets(nodes), written(sketches.join(nodes, "node", "left_semi"), "sketches")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(own.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in own.columns]), side)
        return pairs

    def merged(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        links = _verified(written(pairs, "pairs"), held, similar)
        for side in "ab":
            links = links.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")), side)
        found = components(links.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
        found = written(found, "roots").withColumnRenamed("node", "comp")
        return written(labels.join(found, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")), side)
        return pairs.where("a_comp <> b_comp").select("a", "b")

    labels = nodes.withColumn("comp", F.col("node"))
    if before is not None:
        labels = merged(with_sketches(before).where(possible("a_", "b_")).select("a", "b"), labels)
    nearest = entries.groupBy("node").agg(F.min("hub").alias("a")).where("a <> node").select("a", F.col("node").alias("b"))
    nearest = nearest if before is None else apart(nearest, labels)
    labels = merged(with_sketches(nearest).where(possible("a_", "b_")).select("a", "b"), labels)
    stars = entries.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    labels = merged(with_sketches(apart(stars, labels)).where(possible("a_", "b_")).select("a", "b"), labels)

    # what is left: different components under a key, all but the pairs inside its commonest one
    marked = entries.join(labels, "node").select("key", "node", "comp")
    sizes = marked.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    some = written(marked.join(several.select("key", "top"), "key").join(own, "node"), "others")
    side_a, side_b = (some.select("key", "top", *[F.col(c).alias(f"{s}_{c}") for c in some.columns if c not in ("key", "top")]) for s in "ab")
    rest = side_a.where("a_comp <> top").join(side_b.drop("top"), "key").where(F.expr("a_comp <> b_comp AND (b_comp = top OR a_comp < b_comp)") & possible("a_", "b_"))
    rest = rest.where(first("a_", "b_")) if first else rest
    labels = merged(rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), labels)
    return labels.select("node", F.col("comp").alias("root"))


def smallest_keys(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, component): every row of ``rows`` (key, node, n) with the smallest key of its component. Without words (n = 0) that is its own.

    Null keys are passed over; a component of null keys alone has a null.
    """
    full = rows.where("n > 0")
    least = full.groupBy("node").agg(F.min(key).alias("least"))
    joined = written(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "joined")
    labels = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    bare = rows.where("n = 0").select(key, "n", F.col(key).alias("component"))
    return full.join(written(labels, "labels"), "node").select(key, "n", "component").unionByName(bare)
