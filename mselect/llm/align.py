"""Alignment of two tokenizers, with pair counts by external spilling and merging.

Each task encodes its texts with both tokenizers, links tokens whose byte ranges overlap, and spills what it has gathered in runs of bounded
size: the pairs that each document holds, sorted by (side A, side B), cut by the radix of the A id, and packed with zstd. A k-way
heap merge adds the runs' counts of each pair, a few runs a task, in as many rounds as it takes to have one run a radix. As the A id is the
major order, a pass over the merged run knows each A id's highest count. The counts then meet the runs' postings again, radix by radix, and
what every pair contributes goes back to the documents. A run's slice is bounded, and a merged slice holds different pairs of ids alone,
so a pair that every document holds weighs no more than another.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mselect.llm import tokens
from mselect.llm.common import written

RADIX = 16  # slices of a run
FAN_IN = 64  # runs that one task merges
SPILL = 1_500_000  # pair-document records of a run, give or take one document's
BLOCK = 16_384  # pairs of a compressed block


class Aligner:
    """Both tokenizers in one Python worker. Special strings inside a text are plain text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.fast = tokens.encoder(path_a)
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = tokens._byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for word, i in self.a.get_vocab().items():
            known = all(c in letters for c in word)
            self.bytes_a[i] = bytes(letters[c] for c in word) if known else word.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    def _ids_a(self, text: str) -> list[int]:
        if self.fast.fast and not tokens._UNSTEADY.search(text):
            return self.fast.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text by both tokenizers; none if it is empty or either doesn't give back its bytes."""
        if not text:
            return None
        whole = (" " + text).encode("utf-8")
        a, b = self._ids_a(" " + text), self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


@cache
def _names(after: str) -> np.ndarray:
    """The decimal names of ids with what comes after them."""
    return np.array([f"{i}{after}" for i in range(1 << 17)], object)


def overlaps(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, int, str]:
    """The links, how many groups there are, and the groups as ``a1,a2|b1;a3|b2,b3``.

    A link is the A id times 2**32 plus the B id, for each pair of tokens whose byte ranges overlap: each piece of the text between two ends of
    either side is what just one pair shares. Groups end where both sides do.
    """
    marks = np.zeros((2, int(ends_a[-1]) + 1), bool)
    marks[0, ends_a] = marks[1, ends_b] = True
    ends = np.flatnonzero(marks[0] | marks[1])
    at_a, at_b = marks[0, ends], marks[1, ends]
    both = at_a & at_b
    upto_a, upto_b, done = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(both)
    links = a[upto_a - at_a] << 32 | b[upto_b - at_b]
    group, count = done - both, int(done[-1])
    cuts_a, cuts_b = upto_a[both], upto_b[both]
    place_a = np.arange(len(a)) + np.concatenate(([0], cuts_b))[group[at_a]]
    place_b = np.arange(len(b)) + cuts_a[group[at_b]]
    words = np.empty(len(a) + len(b), object)
    words[place_a], words[place_b] = _names(",")[a], _names(",")[b]
    words[place_a[cuts_a - 1]], words[place_b[cuts_b - 1]] = _names("|")[a[cuts_a - 1]], _names(";")[b[cuts_b - 1]]
    return links, count, "".join(words.tolist())[:-1]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one zstd frame: equal bytes of neighbouring numbers side by side."""
    flat = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(c) for c in columns], "<i8").tobytes() + b"".join(flat))


def unpack(frame: bytes, columns: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    out, at = [], 8 * columns
    for n in np.frombuffer(data[:at], "<i8"):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * int(n)
    return out


def blocks(pairs: np.ndarray, *others: np.ndarray) -> list[bytes]:
    """Sorted pairs with what belongs to them, in blocks that are read one at a time; pairs as steps from the one before."""
    return [pack(np.diff(pairs[i: i + BLOCK], prepend=0), *(o[i: i + BLOCK] for o in others)) for i in range(0, len(pairs), BLOCK)]


def read_blocks(frames: list[bytes], columns: int) -> Iterator[list[np.ndarray]]:
    for frame in frames:
        steps, *others = unpack(frame, columns)
        yield [np.cumsum(steps), *others]


@dataclass
class _Head:
    """A run's block that the merge has reached."""
    pairs: np.ndarray
    counts: np.ndarray
    rest: Iterator[list[np.ndarray]]


def merge(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (pairs, counts) of all runs in order, counts of equal pairs added; one block of each run is unpacked at a time.

    The heap holds the last pair of every run's block. All pairs up to the smallest of these are in the blocks that are there.
    """
    heads: dict[int, _Head] = {}
    heap: list[tuple[int, int]] = []

    def load(i: int, rest: Iterator[list[np.ndarray]]) -> None:
        block = next(rest, None)
        if block is None:
            heads.pop(i, None)
        else:
            heads[i] = _Head(block[0], block[1], rest)
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i, frames in enumerate(runs):
        load(i, read_blocks(frames, 2))
    while heap:
        upto, i = heapq.heappop(heap)
        pairs, counts = [], []
        for head in heads.values():
            n = int(np.searchsorted(head.pairs, upto, "right"))
            if n:
                pairs.append(head.pairs[:n])
                counts.append(head.counts[:n])
                head.pairs, head.counts = head.pairs[n:], head.counts[n:]
        load(i, heads[i].rest)
        if pairs:
            every, where = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, where, np.concatenate(counts))
            yield every, total


def spilled(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, spill: int) -> DataFrame:
    """Rows of two kinds: a document's own numbers (radix null), and a run's slice for one radix with its pairs and postings.

    A run is named by (part, seq); ``row`` is a document's place in it.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["part", "seq", "row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "pairs", "postings"]
    types = [pa.int32(), pa.int32(), pa.int32(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(),
             pa.list_(pa.binary()), pa.list_(pa.binary())]
    schema = (f"part int, seq int, row int, {key} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "radix int, pairs array<binary>, postings array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = row = 0

        def slices() -> dict[str, list]:
            """The gathered records as a run's slices."""
            pairs = np.concatenate([p for p, _ in held])
            times = np.concatenate([t for _, t in held])
            rows = np.repeat(np.arange(len(held)), [len(p) for p, _ in held])
            order = np.lexsort((rows, pairs, (pairs >> 32) % RADIX))
            pairs, times, rows = pairs[order], times[order], rows[order]
            edges = np.searchsorted((pairs >> 32) % RADIX, np.arange(RADIX + 1))
            out: dict[str, list] = {"radix": [], "pairs": [], "postings": []}
            for r, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                if i < j:
                    every, counts = np.unique(pairs[i:j], return_counts=True)
                    out["radix"].append(r)
                    out["pairs"].append(blocks(every, counts))
                    out["postings"].append(blocks(pairs[i:j], rows[i:j], times[i:j]))
            return out

        def batch_of(n: int, columns: dict) -> pa.RecordBatch:
            def column(name, kind):
                if name not in columns:
                    return pa.nulls(n, kind or key_type)
                return columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind)
            return pa.RecordBatch.from_arrays([column(n_, k) for n_, k in zip(names, types)], names)

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal size, row, seq
            if size:
                out = slices()
                n = len(out["radix"])
                yield batch_of(n, {"part": [part] * n, "seq": [seq] * n, **out})
            held.clear()
            size, row, seq = 0, 0, seq + 1

        for batch in batches:
            key_type = batch.column(0).type
            first, found = 0, []
            for at, value in enumerate(batch.column(1)):
                ids = own.ids(value.as_py())
                if ids is None:
                    found.append((row, 0, 0, 0, 0, ""))
                    held.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                else:
                    ends = own.ends(*ids)
                    links, count, said = overlaps(*ids, *ends)
                    digest = hashlib.sha256(said.encode()).hexdigest()
                    found.append((row, len(ids[0]), len(ids[1]), count, len(links), digest))
                    held.append(np.unique(links, return_counts=True))
                size, row = size + len(held[-1][0]), row + 1
                if size >= spill or at == batch.num_rows - 1:
                    columns = dict(zip(["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], map(list, zip(*found))))
                    n = len(found)
                    yield batch_of(n, {"part": [part] * n, "seq": [seq] * n, key: batch.column(0).slice(first, n), **columns})
                    first, found = at + 1, []
                    if size >= spill:
                        yield from flushed()
        yield from flushed()
    return docs.select(key, text).mapInArrow(run, schema)


def merged(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, counts): for each radix one run of all pairs with the documents that hold them, and whether that is the highest of the A id."""
    def level(slices: DataFrame, many: int, last: bool) -> DataFrame:
        dealt = slices.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(many))).select("radix", "group", "pairs")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done() -> pa.RecordBatch:
                out, tail = [], None
                for pairs, counts in merge(held):
                    if not last:
                        out.extend(blocks(pairs, counts))
                        continue
                    if tail is not None:  # an A id is judged once its last pair is there
                        pairs, counts = np.concatenate((tail[0], pairs)), np.concatenate((tail[1], counts))
                    cut = int(np.searchsorted(pairs >> 32, pairs[-1] >> 32))
                    tail = pairs[cut:], counts[cut:]
                    out.extend(judged(pairs[:cut], counts[:cut]))
                if tail is not None:
                    out.extend(judged(*tail))
                return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([f"{at[0]}/{at[1]}"]),
                                                   pa.array([out], pa.list_(pa.binary()))], ["radix", "name", "pairs"])
            at, held = None, []
            for batch in batches:
                for r, g, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if at != (r, g):
                        if at is not None:
                            yield done()
                        at, held = (r, g), []
                    held.append([f.as_py() for f in frames])
            if at is not None:
                yield done()
        groups_ = dealt.repartition("radix", "group").sortWithinPartitions("radix", "group")
        return written(groups_.mapInArrow(run, "radix int, name string, pairs array<binary>"), "merged")

    slices = runs.select("radix", F.concat_ws("/", "part", "seq").alias("name"), "pairs")
    while True:
        most = slices.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
        many = -(-most // fan_in)
        slices = level(slices, max(1, many), many <= 1)
        if many <= 1:
            return slices.select("radix", F.col("pairs").alias("counts"))


def judged(pairs: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Blocks of pairs of whole A ids, with counts and whether they are their A id's highest."""
    if not len(pairs):
        return []
    a = pairs >> 32
    first = np.flatnonzero(np.diff(a, prepend=-1))
    most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
    return blocks(pairs, counts, (counts == most).astype(np.int64))


def contributions(runs: DataFrame, counts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(part, seq, row, n_best, count_sum): what the pairs of one radix give each document."""
    most = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    many = max(1, -(-most // fan_in))
    group = F.pmod(F.xxhash64("part", "seq"), F.lit(many)).cast("int")
    rows = runs.select("radix", group.alias("group"), "part", "seq", F.col("postings").alias("frames"))
    none = F.lit(None).cast("int")
    sent = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("group"), none.alias("part"), none.alias("seq"),
                         F.col("counts").alias("frames"))
    both = rows.unionByName(sent).repartition("radix", "group").sortWithinPartitions("radix", "group", F.col("part").asc_nulls_first(), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = found = best = None
        for batch in batches:
            for part, seq, frames in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                frames = [f.as_py() for f in frames]
                if part is None:  # the counts of the next runs' radix
                    pairs, found, best = map(np.concatenate, zip(*read_blocks(frames, 3)))
                    continue
                every = list(read_blocks(frames, 3))
                size = 1 + max(int(rows.max()) for _, rows, _ in every)
                n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
                for own, rows, times in every:
                    at = np.searchsorted(pairs, own)
                    np.add.at(n_best, rows, times * best[at])
                    np.add.at(count_sum, rows, times * found[at])
                rows = np.flatnonzero(count_sum)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), pa.array(np.full(len(rows), seq, np.int32)), pa.array(rows.astype(np.int32)),
                     pa.array(n_best[rows]), pa.array(count_sum[rows])], ["part", "seq", "row", "n_best", "count_sum"])
    return both.mapInArrow(run, "part int, seq int, row int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", spill: int = SPILL, fan_in: int = FAN_IN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A encodes a space and the text, B the text. Null and empty texts, and those that one of the tokenizers doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. A pair's count is the number of rows that hold it, so repeated rows count each; keys may be null or repeat.
    Other columns aren't read.
    """
    out = written(spilled(docs, path_a, path_b, key, text, spill), "runs")
    runs = out.where("radix IS NOT NULL").select("part", "seq", "radix", "pairs", "postings")
    sums = contributions(runs, merged(runs, fan_in), fan_in).groupBy("part", "seq", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = out.where("radix IS NULL").select("part", "seq", "row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(sums, ["part", "seq", "row"], "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
