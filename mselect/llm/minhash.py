"""MinHash near-duplicates through a multi-index Hamming join of b-bit signatures.

A signature holds, for each of ``PLACES`` hash functions, the low eight bits of the smallest value over a text's shingles. Two sets of
Jaccard similarity J differ in a place with a probability of (1 - J) * 255 / 256. The places are cut into ``CHUNKS`` chunks; signatures
that differ in at most ``distance`` places differ in at most ``distance // CHUNKS`` places of one of them (pigeonhole), so each
chunk is entered once for every choice of the places that may be wrong, with those left out, and such a pair shares an entry for certain. The
distance is then counted on the signatures, odd sketches drop what can't be similar enough, and the sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.llm import linking, words
from mselect.llm.common import written

PLACES = 64
CHUNKS = 12
#: Two sets at 0.85 differ in more of 64 places with a probability of 2e-5; above 0.9, of less than 1e-9.
DISTANCE = 23
_Q = [f"q{i}" for i in range(PLACES // 8)]  # the signature as longs
_SKETCH = ["n", *_Q, *linking.ODD]
_SALTS = words.mix(np.arange(1, PLACES + 1, dtype=np.uint64) * words._BASE)[:, None]
_FACTORS = words.mix(_SALTS) | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """The bytes of one set's signature."""
    least = np.full(PLACES, ~np.uint64(0))
    for i in range(0, len(own), 1000):
        values = (own[i: i + 1000] ^ _SALTS) * _FACTORS
        least = np.minimum(least, (values ^ (values >> np.uint64(29))).min(axis=1))
    return (words.mix(least) & np.uint64(255)).astype(np.uint8)


def chunk_choices(distance: int = DISTANCE, chunks: int = CHUNKS) -> list[tuple[int, ...]]:
    """For every entry the places that it keeps: each chunk, without each choice of ``distance // chunks`` places."""
    edges = np.linspace(0, PLACES, chunks + 1).round().astype(int)
    wrong = distance // chunks
    return [tuple(p for p in range(a, b) if p not in out) for a, b in zip(edges[:-1], edges[1:]) for out in combinations(range(a, b), wrong)]


def entry_keys(signatures: np.ndarray, choices: list[tuple[int, ...]]) -> np.ndarray:
    """A hash for each signature and choice, of the kept places' bytes; the last ten bits are the choice's number."""
    out = np.empty((len(signatures), len(choices)), np.uint64)
    for n, places in enumerate(choices):
        h = np.full(len(signatures), np.uint64(n + 1))
        for p in places:
            h = words.mix(h * words._BASE + signatures[:, p])
        out[:, n] = h & ~np.uint64(1023) | np.uint64(n)
    return out.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, node, n, q0 to q7, k0 to k7) of every row: the set's node and size, signature and odd sketch. Null texts have no words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            for row, sets in linking.sets_of(batch.column(1), powers, shingle):
                cells = np.array([[linking.node_of(own), len(own), *signature(own).view(np.int64), *linking.odd_sketch(own)] for own in sets], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), *(pa.array(c) for c in cells.T.copy())], [key, "node", *_SKETCH])
    kinds = ", ".join(f"{c} long" for c in ("node", *_SKETCH))
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {kinds}")


def entries(classes: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """(node, key): the entries of every signature of ``classes``."""
    choices = chunk_choices(distance, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                own = np.stack([part.column(1 + q).to_numpy() for q in range(len(_Q))], axis=1)
                keys = entry_keys(np.ascontiguousarray(own).view(np.uint8), choices)
                nodes = np.repeat(part.column(0).to_numpy(), len(choices))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.ravel())], ["node", "key"])
    return classes.select("node", *_Q).mapInArrow(run, "node long, key long")


def differing(p: str, q: str) -> Column:
    """In how many places the signatures differ whose columns have the prefixes p and q."""
    total = F.lit(0)
    for name in _Q:
        x = F.col(p + name).bitwiseXOR(F.col(q + name))
        for by in (4, 2, 1):  # the lowest bit of a byte becomes one if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total + F.bit_count(x.bitwiseAND(0x0101010101010101))
    return total


def first_shared(p: str, q: str, choices: list[tuple[int, ...]]) -> Column:
    """Whether ``key`` is of the first choice whose places are the same in the signatures in columns with the prefixes p and q."""
    at = F.lit(None)
    for n, places in reversed(list(enumerate(choices))):
        kept = np.zeros(PLACES, np.uint8)
        kept[list(places)] = 255
        same = [F.col(p + name).bitwiseXOR(F.col(q + name)).bitwiseAND(int(mask)) == 0 for name, mask in zip(_Q, kept.view(np.int64)) if mask]
        at = F.when(reduce(and_, same), n).otherwise(at)
    return at == F.col("key").bitwiseAND(1023)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = 85, shingle: int = 3,
                    distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """(key, n_shingles, component, kept): every row with the smallest key that links lead to, its own included.

    Rows are linked if 100 * intersection >= ``similar`` * union of their sets of shingles (lower-cased, of 64-bit hashes), counted on
    the whole sets, and their signatures differ in at most ``distance`` places, which hardly any pair of that similarity fails. Rows with
    equal sets are one node. Rows without words are linked with nothing. Null keys are passed over when the smallest is
    sought; a component of null keys alone has a null. Rows stay as many as they are; other columns aren't read.
    """
    rows = written(signatures(docs, key, text, shingle), "signatures")
    classes = written(rows.where("n > 0").groupBy("node", *_SKETCH).agg(F.min(key).alias("least")), "classes")
    # a set with fewer shingles than this has no similar one but itself
    smallest = -(-similar // max(1, 100 - similar))
    apart = classes.where(F.col("n") >= smallest)

    def possible(p: str, q: str) -> Column:
        return linking.room_for(similar, p, q) & (differing(p, q) <= distance)

    def sets(nodes: DataFrame) -> DataFrame:
        chosen = apart.join(nodes, "node", "left_semi").select("node", F.xxhash64("least").alias("h"))
        return linking.sets_by_node(docs, chosen, key, text, shingle)

    def verdict(x: np.ndarray, y: np.ndarray) -> bool:
        same = linking.same_part(x, y)
        return 100 * same >= similar * (len(x) + len(y) - same)

    roots = linking.settle(entries(apart, distance, chunks), apart.select("node", *_SKETCH), possible, sets, verdict,
                           lambda p, q: first_shared(p, q, chunk_choices(distance, chunks)))
    out = linking.smallest_keys(rows, roots, key)
    return out.select(key, F.col("n").alias("n_shingles"), "component", (F.col(key) == F.col("component")).alias("kept"))
