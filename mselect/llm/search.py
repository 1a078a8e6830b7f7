"""Ranked lexical search with range-maximum tables over posting lists.

Documents are cut into segments of bounded size. In a segment every term's posting list has its impacts, and a sparse table that names the
posting of the highest impact in any range. An item's search keeps a heap of document intervals. An interval's bound is the sum over
terms of the highest impact inside it; the best interval is split at the document of its largest impact, which is scored, and both halves
go back with their own bounds, until no bound reaches the last of the best documents so far. The best go on to the task's next segment.

Items come in blocks, so that what is sent to the tasks is bounded; a block needs one pass to count and one to search.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mselect.llm import words
from mselect.llm.common import written

BLOCK_TERMS = 200_000  # terms of a block of items
SEGMENT_POSTINGS = 400_000
SEGMENT_ROWS = 8_192
TOP = 10
#: Intervals that are split in one step, so that numpy has something to do; bounds decide as if they came one by one.
STEP = 32

#: Terms are runs of ASCII letters, ASCII digits and all other characters beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_hashes(column: pa.Array, powers: words.Powers) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, hashes of each text's terms) of slices of a column; a null text has none."""
    for row, data, offsets in words.slices(column):
        starts, ends, first = words.word_spans(data, offsets, _TERM)
        hashes = words.word_hashes(data, starts, ends, powers)
        yield row, [hashes[a:b] for a, b in zip(first[:-1], first[1:])]


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term) once each, ``term`` as a hash. Texts with equal keys are one item; a null key is a key."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            for row, own in term_hashes(batch.column(1), powers):
                own = [np.unique(h) for h in own]
                at = np.repeat(np.arange(row, row + len(own)), [len(h) for h in own])
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(own).view(np.int64))], ["item", "term"])
    return items.select(key, text).mapInArrow(run, f"item {kind}, term long").distinct()


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats: two numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            sizes = [len(h) for _, own in term_hashes(batch.column(0), powers) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)]), pa.array([sum(sizes)])], ["n", "l"])
    row = docs.select(text).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind)).tobytes())


def _unpacked(frame: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), kind)


def segments(docs: DataFrame, terms: np.ndarray, key: str, text: str, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of documents: keys, numbers of terms, and the postings (term, document, times) of ``terms`` (sorted), by term and document."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(terms.tobytes())
    names = ["keys", "lengths", "terms", "rows", "times", "term", "df", "n", "l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = np.frombuffer(sent.value, np.uint64), words.Powers()
        keys, lengths, found = [], [], []
        postings = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal postings
            if lengths:
                key_list = pa.chunked_array(keys).combine_chunks()
                sizes = [len(t) for t, _ in found]
                term, times = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                rows = np.repeat(np.arange(len(found)), sizes)
                order = np.argsort(term, kind="stable")
                term, times, rows = term[order], times[order], rows[order]
                own, count = np.unique(term, return_counts=True)
                n = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(key_list)], pa.int32()), key_list), pa.array([_packed(n, "<i8")]), pa.array([_packed(term, "<i4")]),
                     pa.array([_packed(rows, "<i4")]), pa.array([_packed(times, "<i8")]), pa.array([own.tolist()], pa.list_(pa.int32())),
                     pa.array([count.tolist()], pa.list_(pa.int64())), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names)
            keys.clear(), lengths.clear(), found.clear()
            postings = 0

        for batch in batches:
            for row, own in term_hashes(batch.column(1), powers):
                first = 0
                for i, h in enumerate(own):
                    at = np.searchsorted(known, h)
                    at = at[known[np.minimum(at, len(known) - 1)] == h] if len(known) else at[:0]
                    found.append(np.unique(at, return_counts=True))
                    lengths.append(len(h))
                    postings += len(found[-1][0])
                    if postings >= SEGMENT_POSTINGS or len(lengths) >= most_rows or i == len(own) - 1:
                        keys.append(batch.column(0).slice(row + first, i + 1 - first))
                        first = i + 1
                        if postings >= SEGMENT_POSTINGS or len(lengths) >= most_rows:
                            yield from flushed()
        yield from flushed()
    schema = (f"keys array<{kind}>, lengths binary, terms binary, rows binary, times binary, term array<int>, df array<long>, n long, l long")
    return docs.select(key, text).mapInArrow(run, schema)


class Postings:
    """A segment's posting lists with their impacts, and the sparse table over all of them. Documents are in the order in which ties rank."""

    def __init__(self, term: np.ndarray, rows: np.ndarray, impacts: np.ndarray, size: int):
        self.size, self.impacts = size, np.append(impacts, 0)
        self.places = term.astype(np.int64) * size + rows  # ascending: by term, then by document
        self.rows = rows
        levels, width = [np.arange(len(impacts), dtype=np.int32)], 1
        while 2 * width <= min(len(impacts), size):
            x, y = levels[-1][:-width], levels[-1][width:]
            levels.append(np.where(impacts[x] >= impacts[y], x, y).astype(np.int32))
            width *= 2
        self.levels = levels

    def highest(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The posting of the highest impact for every term (rows) in every interval of documents [lo, hi) (columns); -1 without one."""
        i = np.searchsorted(self.places, terms[:, None] * self.size + lo)
        j = np.searchsorted(self.places, terms[:, None] * self.size + hi)
        out = np.full(i.shape, -1, np.int64)
        level = np.frexp(j - i)[1] - 1
        for k in np.unique(level[j > i]):
            at = (level == k) & (j > i)
            x, y = self.levels[k][i[at]], self.levels[k][j[at] - (1 << int(k))]
            out[at] = np.where(self.impacts[x] >= self.impacts[y], x, y)
        return out

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The whole score of each document."""
        asked = terms[:, None] * self.size + docs
        at = np.minimum(np.searchsorted(self.places, asked), len(self.places) - 1)
        return np.where(self.places[at] == asked, self.impacts[at], 0).sum(axis=0)

    def best(self, terms: np.ndarray, top: int, known: list[int]) -> list[tuple[int, int]]:
        """The (score, document) of all that can be among the ``top``, as equal scores rank by document. ``known``: scores that others have already."""
        best = heapq.nlargest(top, known)[::-1]  # the least first: a heap
        out: list[tuple[int, int]] = []
        if not len(self.places):
            return out
        heap: list[tuple[int, int, int, int]] = []

        def push(lo: np.ndarray, hi: np.ndarray) -> None:
            some = lo < hi
            lo, hi = lo[some], hi[some]
            if not len(lo):
                return
            at = self.highest(terms, lo, hi)
            values = self.impacts[at]
            bounds = values.sum(axis=0)
            split = self.rows[at[values.argmax(axis=0), np.arange(len(lo))]]
            for row in zip((-bounds).tolist(), lo.tolist(), hi.tolist(), split.tolist()):
                if row[0] < 0 and (len(best) < top or -row[0] >= best[0]):
                    heapq.heappush(heap, row)

        push(np.array([0]), np.array([self.size]))
        while heap and (len(best) < top or -heap[0][0] >= best[0]):
            step = [heapq.heappop(heap) for _ in range(min(STEP, len(heap)))]
            step = [s for s in step if len(best) < top or -s[0] >= best[0]]
            lo, hi, split = (np.array([s[i] for s in step], np.int64) for i in (1, 2, 3))
            for score, doc in zip(self.scores(terms, split).tolist(), split.tolist()):
                if len(best) < top or score >= best[0]:
                    out.append((score, doc))
                    heapq.heappush(best, score)
                    if len(best) > top:
                        heapq.heappop(best)
            push(np.concatenate((lo, split + 1)), np.concatenate((split, hi)))
        return sorted(out, key=lambda x: (-x[0], x[1]))[:top]


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, first within parts of it, so that no task holds more of an item than its parts leave."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    parts = rows.withColumn("part", F.pmod(F.monotonically_increasing_id() / 8_589_934_592, F.lit(64)).cast("int"))
    inside = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def _search(docs: DataFrame, asked: DataFrame, size: tuple[int, int], key: str, text: str, top: int, segment_rows: int) -> DataFrame:
    """(item, rank, key, score) of one block of items' terms."""
    items: dict = {}
    for r in asked.toLocalIterator():
        items.setdefault(r["item"], []).append(r["term"])
    known = np.unique(np.array([t for own in items.values() for t in own], np.int64).view(np.uint64))
    cut = written(segments(docs, known, key, text, segment_rows), "segments")
    frequency = np.zeros(len(known), np.int64)
    for r in cut.select(F.explode(F.arrays_zip("term", "df"))).groupBy("col.term").agg(F.sum("col.df").alias("df")).collect():  # one a term of the block
        frequency[r["term"]] = r["df"]
    n_docs, n_terms = size
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
    names = list(items)
    of_item = [np.searchsorted(known, np.sort(np.array(items[i], np.int64).view(np.uint64))) for i in names]
    del items
    flat = array("i", (int(t) for own in of_item for t in own)).tobytes()
    ends = np.cumsum([len(own) for own in of_item]).tolist()
    sent = docs.sparkSession.sparkContext.broadcast((flat, ends, weights.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends, w = sent.value
        asked_terms = np.split(np.frombuffer(flat, np.int32).astype(np.int64), ends[:-1]) if ends else []
        w = np.frombuffer(w, np.int64)
        kept: list[list[tuple[int, bool, object]]] = [[] for _ in asked_terms]
        kind = None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for keys, *columns in zip(*(batch.column(i) for i in range(5))):
                keys = keys.as_py()
                n, term, rows, times = (_unpacked(c.as_py(), k) for c, k in zip(columns, ("<i8", "<i4", "<i4", "<i8")))
                order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
                place = np.empty(len(keys), np.int64)
                place[order] = np.arange(len(keys))
                m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
                rows = rows.astype(np.int64)
                impacts = w[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[rows]))
                rows = place[rows]
                by = np.lexsort((rows, term))
                lists = Postings(term[by], rows[by], impacts[by], len(keys))
                for i, own in enumerate(asked_terms):
                    found = lists.best(own, top, [s for s, _, _ in kept[i]])
                    if found:
                        more = [(s, keys[order[d]] is None, keys[order[d]]) for s, d in found]
                        kept[i] = sorted([*kept[i], *more], key=lambda x: (-x[0], x[1], 0 if x[1] else x[2]))[:top]
        rows = [(i, s, k) for i, own in enumerate(kept) for s, _, k in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows])],
                                             ["number", "key", "score"])
    kind = docs.schema[key].dataType.simpleString()
    found = cut.select("keys", "lengths", "terms", "rows", "times").mapInArrow(run, f"number int, key {kind}, score long").withColumnRenamed("number", "item")
    numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), f"number int, item {asked.schema['item'].dataType.simpleString()}")
    ranked = _first(found, top).withColumnRenamed("item", "number")
    return ranked.join(numbers, "number").select("item", "rank", "key", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(item key, rank, key, score): the ``top`` documents of each item by falling score, then by rising key (nulls last), with a score above 0.

    Texts of items with equal keys are taken together; an item without terms, or whose terms no document has, has no rows. Null texts have no
    terms. A document with a null key counts and ranks as any other; rows with equal keys are documents of their own. Other columns
    aren't read.
    """
    terms = written(item_terms(items, item_key, item_text), "terms")
    size = totals(docs, text)
    count = terms.count()
    many = max(1, -(-count // block_terms))
    out = None
    for n in range(many):
        block = terms.where(F.pmod(F.xxhash64("item"), F.lit(many)) == n)
        found = written(_search(docs, block, size, key, text, top, segment_rows), "found")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
