"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring tokens; the tokens at its ones are hashed and those between are ignored, so a passage with a
replaced token still hits. Hashes of test items and of documents are joined, and around each hit the tokens of both are compared
along the hit's diagonal: an overlap counts if it has enough equal tokens and few replaced ones. Tokens are case-folded runs of
bytes without white space and ASCII punctuation; folding is Unicode's, in which ``ß`` is ``ss`` as in its upper case.

Documents are many and hits are few. A bit table of a fixed size, made of the test hashes, tells each task which of its
positions may hit; only those leave it, together with the tokens around them. The join is exact, so the bit table never
decides anything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mselect.llm import words
from mselect.llm.common import written

MASKS = ("111011011", "111101111", "1101100101011", "11100100110111")  # for every period from 5 on one of them misses all tokens replaced at it
BITS = 1 << 23  # of the bit table: a megabyte
LEAST = 13  # equal tokens of an overlap with a longer item
AROUND = 64  # tokens kept on either side of a hit

_INK = words._INK.copy()
_INK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False


def seed_hashes(tokens: np.ndarray, firsts: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the tokens at the mask's ones, for each first position."""
    out = np.zeros(len(firsts), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ tokens[firsts + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return words.mix(out + np.uint64(len(mask)))


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice without case in any language. Bytes that aren't UTF-8 stay."""
    if not len(data) or data.max() < 128:
        return data, offsets
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    texts = [t if t.isascii() else t.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _tokens(column: pa.Array, powers: words.Powers, size: int = words.SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, first token of each text and the total) of slices of a column."""
    for row, data, offsets in words.slices(column, size):
        data, offsets = _folded(data, offsets)
        starts, ends, first = words.word_spans(data, offsets, _INK)
        yield row, words.word_hashes(data, starts, ends, powers), first


def _firsts(first: np.ndarray, span: int) -> np.ndarray:
    """Positions from which ``span`` tokens lie in one text."""
    total = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(total)
    return at[at + span <= ends]


def item_tokens(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens) of every test item with a token."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            out = []
            for _, tokens, first in _tokens(batch.column(1), powers):
                out += [tokens[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], [key, "tokens"])
    return items.select(key, text).mapInArrow(run, f"{key} {kind}, tokens array<long>").where("size(tokens) > 0")


def own_masks(masks: Sequence[str], n: int, least: int = LEAST) -> set[str]:
    """The masks of an item of ``n`` tokens: those that fit and, below ``least`` tokens, those of its length without one token.

    So one replaced token doesn't lose an item of four tokens or more; a shorter one must be equal.
    """
    fit = {m for m in masks if len(m) <= n}
    if n >= least:
        return fit
    if n < 4:
        return fit | {"1" * n}
    return fit | {"1" * (n - 1)} | {"1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)}


def item_seeds(items: DataFrame, masks: Sequence[str], key: str, least: int = LEAST) -> DataFrame:
    """(seed, hash, key, place) for every position of every item and each of its masks."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, cell in enumerate(batch.column(1)):
                tokens = cell.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for mask in own_masks(masks, len(tokens), least):
                    at = np.arange(len(tokens) - len(mask) + 1)
                    rows += [(mask, h, i, p) for h, p in zip(seed_hashes(tokens, at, mask).view(np.int64).tolist(), at.tolist())]
            if rows:
                mask, h, i, p = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(h, pa.int64()), batch.column(0).take(pa.array(i)),
                                                  pa.array(p, pa.int32())], ["seed", "hash", key, "place"])
    return items.select(key, "tokens").mapInArrow(run, f"seed string, hash long, {key} {kind}, place int")


def bit_table(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table of ``bits`` bits in which two bits of every hash are set. Its size doesn't depend on the input."""
    spots = hashes.select(F.explode(F.array(F.pmod("hash", F.lit(bits)), F.pmod(F.shiftright("hash", 32), F.lit(bits)))).alias("bit"))
    cells = spots.groupBy(F.shiftright("bit", 5).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int)))").alias("set")).collect()
    table = np.zeros(bits // 32, np.uint32)
    for cell, value in cells:
        table[cell] = value
    return table


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits, h = np.int64(len(table) * 32 - 1), hashes.view(np.int64)
    a, b = h & bits, (h >> np.int64(32)) & bits

    def one(x):
        return (table[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1) != 0
    found = np.flatnonzero(one(a))
    return found[one(b[found])]


def passages(docs: DataFrame, masks: Sequence[str], table, key: str, text: str, around: int = AROUND) -> DataFrame:
    """(key, start, tokens, hits): stretches of documents around positions that may hit, and the (seed, hash, place) in each.

    ``table`` is a broadcast bit table. A stretch goes on while the next hit is within twice ``around`` tokens.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        hit = pa.struct([("seed", pa.string()), ("hash", pa.int64()), ("place", pa.int32())])
        for batch in batches:
            for row, tokens, first in _tokens(batch.column(1), powers):
                places, hashes, seeds = [], [], []
                for n, mask in enumerate(masks):
                    at = _firsts(first, len(mask))
                    h = seed_hashes(tokens, at, mask)
                    found = _held(table.value, h)
                    places.append(at[found])
                    hashes.append(h[found].view(np.int64))
                    seeds.append(np.full(len(found), n))
                place, value, seed = map(np.concatenate, (places, hashes, seeds))
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, value, seed = place[order], value[order], seed[order]
                text_of = np.searchsorted(first, place, "right") - 1
                cuts = np.flatnonzero((np.diff(place) > 2 * around) | (np.diff(text_of) > 0)) + 1
                rows, starts, own, hits = [], [], [], []
                for p, v, s, t in zip(*(np.split(x, cuts) for x in (place, value, seed, text_of))):
                    low = max(first[t[0]], p[0] - around)
                    high = min(first[t[0] + 1], p[-1] + around + max(map(len, masks)))
                    rows.append(row + int(t[0]))
                    starts.append(int(low - first[t[0]]))
                    own.append(tokens[low:high].view(np.int64))
                    hits.append([{"seed": masks[a], "hash": int(b), "place": int(c - low)} for a, b, c in zip(s, v, p)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(own, pa.list_(pa.int64())),
                     pa.array(hits, pa.list_(hit))], [key, "start", "tokens", "hits"])
    return docs.select(key, text).mapInArrow(
        run, f"{key} {kind}, start long, tokens array<long>, hits array<struct<seed: string, hash: long, place: int>>")


def overlap(a: np.ndarray, b: np.ndarray, shift: int, penalty: float = 3.0) -> tuple[int, int, int]:
    """(first token of ``b``, tokens, equal tokens) of the best overlap of ``a`` with ``b`` moved by ``shift`` places.

    An equal token counts 1 and a replaced one ``-penalty``; the best is the stretch of the highest sum.
    """
    low, high = max(0, -shift), min(len(b), len(a) - shift)
    equal = a[low + shift: high + shift] == b[low:high]
    if not equal.any():
        return 0, 0, 0
    sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -penalty))))
    lowest = np.minimum.accumulate(sums[:-1])
    end = int((sums[1:] - lowest).argmax()) + 1
    start = int(sums[:end].argmin())
    return low + start, end - start, int(equal[start:end].sum())


def whole_overlap(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """As ``overlap``, from the first equal token to the last, however many between them are replaced."""
    low, high = max(0, -shift), min(len(b), len(a) - shift)
    at = np.flatnonzero(a[low + shift: high + shift] == b[low:high])
    return (low + int(at[0]), int(at[-1] - at[0]) + 1, len(at)) if len(at) else (0, 0, 0)


def contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", masks: Sequence[str] = MASKS, least: int = LEAST, similar: float = 0.75) -> DataFrame:
    """(doc_key, item_key, n_equal, n_overlap, doc_start, item_start, n_item): a row for each document and test item it overlaps with.

    An overlap has at least ``least`` equal tokens, or as large a part of a shorter item as ``similar``, and at least that part of
    its tokens are equal. An item shorter than ``least`` is compared as a whole, a longer one by its best stretch. Of several overlaps of a pair the one with most equal tokens is given. Null texts have no token
    and overlap with nothing; rows with null keys come out with the null; repeated rows give one. Other columns aren't read.
    """
    own = written(item_tokens(items.withColumnRenamed(item_key, "_item"), "_item", item_text), "items")
    seeds = written(item_seeds(own, masks, "_item", least), "seeds")
    short = [r[0] for r in seeds.select("seed").distinct().where(~F.col("seed").isin(list(masks))).collect()]  # at most ``least`` for each length below it
    every = [*masks, *sorted(short)]
    table = docs.sparkSession.sparkContext.broadcast(bit_table(seeds))
    found = passages(docs.withColumnRenamed(doc_key, "_doc"), every, table, "_doc", doc_text)
    found = written(found.withColumn("_passage", F.xxhash64("_doc", "start", "tokens")), "passages")
    hits = found.select("_passage", F.explode("hits").alias("hit")).select(
        "_passage", "hit.seed", "hit.hash", F.col("hit.place").alias("at")).distinct()
    lines = hits.join(seeds, ["seed", "hash"]).select("_passage", "_item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = lines.join(found.select("_passage", "_doc", "start", F.col("tokens").alias("a")), "_passage").join(
        own.select("_item", F.col("tokens").alias("b")), "_item")
    kinds = {n: pairs.schema[n].dataType.simpleString() for n in ("_doc", "_item")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            shift, start = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                first, n, equal = (overlap if len(b) >= least else whole_overlap)(a, b, shift[i])
                if n and equal >= similar * n and (equal >= least or equal >= similar * len(b)):
                    keep.append(i)
                    rows.append((equal, n, start[i] + first + shift[i], first, len(b)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                    ["_doc", "_item", "n_equal", "n_overlap", "doc_start", "item_start", "n_item"])
    made = pairs.select("_doc", "_item", "shift", "start", "a", "b").mapInArrow(
        run, f"_doc {kinds['_doc']}, _item {kinds['_item']}, n_equal long, n_overlap long, doc_start long, item_start long, n_item long")
    best = made.groupBy("_doc", "_item").agg(F.max_by(
        F.struct("n_equal", "n_overlap", "doc_start", "item_start", "n_item"), F.struct("n_equal", F.negative("n_overlap"), F.negative("doc_start"))).alias("o"))
    return best.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "o.*")
