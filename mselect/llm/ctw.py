"""Language-model scores by context-tree weighting.

A byte is predicted bit by bit, highest first, from the ``depth`` bytes before it (zero bytes before the beginning) and the bits
of it that are known. Each node of the context tree has a Krichevsky-Trofimov estimate from its training counts, and weighs it
against the product of its children's probabilities, with one half each; so all depths are mixed. A context that training hasn't seen says
nothing: the prediction stops at the last one seen, and is one half if there is none. A text is scored with its end, a zero byte.

What a node needs is counts, so training is counting runs of ``depth`` + 1 bytes. Subtrees that share their first bytes of context are
weighted in one task; only the nodes above them, whose number the alphabet bounds, come to the driver. Each run that occurs in any
document gets its probability. Scoring looks up frequent runs in a table of a fixed size and all others through a join. Words are counted
and looked up in the same way for the baseline; they are known by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mselect.llm import words
from mselect.llm.common import written

HOT = 1 << 21  # most entries of the table of frequent keys
TASK_RUNS = 400_000  # runs that a task weights at once, about
SLICE_BYTES = 2_000_000  # text that is worked on at once; bounds a task's memory
SCORE_BYTES = 500_000  # text that is scored at once
MERGE_BYTES = 24_000_000  # text whose counts a task merges before it hands them on
RUN, WORD = 0, 1  # kinds of keys
_TRAIN = (1 << 32) - 1  # counts of a task: those in training in the low half of a long, others in the high half
_U = np.uint64


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers, by Stirling's series eight places up."""
    shift = x * (x + 1)
    for i in range(2, 8):
        shift = shift * (x + i)
    z = x + 8
    y = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / z - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def mix_up(log_here: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability, weight of the own estimate) of nodes."""
    both = np.logaddexp(log_here, log_children) - math.log(2)
    return both, np.exp(log_here - math.log(2) - both)


def step(p: np.ndarray, seen: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray, bit: np.ndarray) -> tuple:
    """The prediction of ``bit`` one depth up: own estimate and what comes from below, if it has been seen."""
    own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    here = zeros + ones > 0
    mixed = np.where(seen, weight * own + (1 - weight) * p, own)
    return np.where(here, mixed, 0.5), here


def weigh(runs: np.ndarray, counts: np.ndarray, depth: int, least: int) -> Iterator[tuple]:
    """For each bit of the byte: (bit number, nodes of depth ``least``: keys, zeros, ones, log probability; then for each
    run: bit, prediction, whether seen). ``runs`` must hold all runs of their contexts of that depth."""
    levels = []
    for d in range(depth, least - 1, -1):
        keys = runs & _U((1 << 8 * (d + 1)) - 1)
        order = np.argsort(keys, kind="stable")
        levels.append((d, order, keys[order], counts[order]))
    for k in range(8):
        bit = ((runs >> _U(7 - k)) & _U(1)).astype(bool)
        below = p = seen = None
        for d, order, keys, n in levels:
            node = keys >> _U(8 - k)
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
            own = node[first]
            n1 = np.where((keys >> _U(7 - k)) & _U(1), n, 0.0)
            ones = np.add.reduceat(n1, first) if len(first) else np.zeros(0)
            zeros = (np.add.reduceat(n, first) if len(first) else np.zeros(0)) - ones
            log_here = log_kt(zeros, ones)
            where = np.empty(len(runs), np.int64)
            where[order] = np.cumsum(np.concatenate(([False], node[1:] != node[:-1]))) if len(node) else 0
            if below is None:
                log_w, weight = log_here, np.ones(len(own))
                p, seen = np.full(len(runs), 0.5), np.zeros(len(runs), bool)
            else:
                parents = np.searchsorted(own, below[0] & _U((1 << (8 * d + k)) - 1))
                log_w, weight = mix_up(log_here, np.bincount(parents, below[1], len(own)))
            p, seen = step(p, seen, zeros[where], ones[where], weight[where], bit)
            below = (own, log_w)
        yield k, own, zeros, ones, log_w, bit, p, seen


class Top:
    """The nodes above depth 2: 256 x 256 of depth 1 and 256 of depth 0. A node is its context byte and 1 before its known bits."""

    def __init__(self, rows: Iterator[tuple[int, int, float, float, float]]):
        self.zeros1, self.ones1, children = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for byte, node, zeros, ones, log_w in rows:
            self.zeros1[byte, node], self.ones1[byte, node], children[byte, node] = zeros, ones, log_w
        log_w, self.weight1 = mix_up(log_kt(self.zeros1, self.ones1), children)
        self.zeros0, self.ones0 = self.zeros1.sum(0), self.ones1.sum(0)
        _, self.weight0 = mix_up(log_kt(self.zeros0, self.ones0), log_w.sum(0))


def log10_probabilities(runs: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """The log10 probability of each run's last byte after the others."""
    total = np.zeros(len(runs))
    byte = ((runs >> _U(8)) & _U(255)).astype(np.int64)
    for k, _, _, _, _, bit, p, seen in weigh(runs, counts, depth, 2):
        node = ((runs & _U(255)) >> _U(8 - k)).astype(np.int64) | 1 << k
        p, seen = step(p, seen, top.zeros1[byte, node], top.ones1[byte, node], top.weight1[byte, node], bit)
        p, _ = step(p, seen, top.zeros0[node], top.ones0[node], top.weight0[node], bit)
        total += np.log10(p)
    return total


def text_runs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs of all bytes and ends of a slice, first run of each text and the total)."""
    lengths = np.diff(offsets)
    n = len(lengths)
    ends = offsets[1:] + depth * np.arange(1, n + 1) + np.arange(n)  # where each text's end is, after its own and earlier padding
    padded = np.zeros(len(data) + n * (depth + 1), np.uint8)
    is_text = np.ones(len(padded), bool)
    is_text[ends] = False
    begins = ends - lengths - depth
    for i in range(depth):
        is_text[begins + i] = False
    padded[is_text] = data
    runs = np.zeros(len(padded), np.uint64)
    for i in range(depth + 1):
        runs[depth:] |= padded[depth - i: len(padded) - i].astype(np.uint64) << _U(8 * i)
    is_text[ends] = True
    return runs[is_text], np.concatenate(([0], np.cumsum(lengths + 1)))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with the sums of their counts. The lists are emptied, so that no part is held twice."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(key, kind="stable")
    n = n[order]
    key = key[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _merge_runs(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different runs, and their counts as ``_merge`` has them, of runs with a last bit that is set outside training. The list is emptied."""
    key, n = np.empty(sum(map(len, held)), np.uint64), 0
    while held:  # each part is freed as it is copied
        part = held.pop()
        key[n: n + len(part)] = part
        n += len(part)
        del part
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(first, append=len(key))
    key = key[first]
    n <<= (key & _U(1)).astype(np.int64) << 5
    key >>= _U(1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def key_counts(docs: DataFrame, depth: int, text: str, train: str) -> DataFrame:
    """(kind, key, n_all, n_train) of all runs and words. ``train`` is a boolean column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = words.Powers(SLICE_BYTES), {RUN: ([], []), WORD: ([], [])}, 0
        whole = depth < 7  # runs leave a bit free, so they are sorted once, by themselves

        def flush():
            for kind, parts in held.items():
                if sum(map(len, parts[0])):
                    keys, counts = _merge_runs(parts[0]) if whole and kind == RUN else _merge(*parts)
                    for i in range(0, len(keys), 100_000):
                        k, n = keys[i: i + 100_000].view(np.int64), counts[i: i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n)], ["kind", "key", "n"])
                for part in parts:
                    part.clear()

        for batch in batches:
            for row, data, offsets in words.slices(batch.column(0), SLICE_BYTES):
                trained = batch.column(1).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False).astype(bool)
                runs, run_first = text_runs(data, offsets, depth)
                starts, ends, word_first = words.word_spans(data, offsets)
                hashes = words.word_hashes(data, starts, ends, powers)
                for kind, keys, first in ((RUN, runs, run_first), (WORD, hashes, word_first)):
                    mask = np.repeat(trained, np.diff(first))
                    if whole and kind == RUN:
                        held[kind][0].append(keys << _U(1) | ~mask)
                        continue
                    for chosen, place in ((keys[mask], 0), (keys[~mask], 32)):
                        unique, n = np.unique(chosen, return_counts=True)
                        held[kind][0].append(unique)
                        held[kind][1].append(n << place)
                del runs, hashes, starts, ends, keys, mask, chosen, unique, n
                size += len(data)
                if size >= MERGE_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()
    parts = docs.select(text, train).mapInArrow(run, "kind byte, key long, n long")
    # dealt first: within a task nearly all keys are different, so counts are added where they meet
    return parts.repartition("key").groupBy("kind", "key").agg(
        F.sum(F.col("n").bitwiseAND(_TRAIN) + F.shiftright("n", 32)).alias("n_all"), F.sum(F.col("n").bitwiseAND(_TRAIN)).alias("n_train"))


def _partition(batches: Iterator[pa.RecordBatch], columns: int) -> tuple[np.ndarray, ...]:
    """All rows of a partition, of which the number is set beforehand, as arrays."""
    parts = list(zip(*([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows)))
    return tuple(np.concatenate(c) for c in parts) or (np.zeros(0, np.int64),) * columns


def run_probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """(key, value, n_all): the log10 probability of every run."""
    runs = counts.where(F.col("kind") == RUN)
    tasks = max(1, runs.count() // TASK_RUNS)
    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))  # the two bytes before: their subtree is in one task

    def dealt(*columns: str) -> DataFrame:
        return runs.select("key", *columns).repartition(tasks, near)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, train = _partition(batches, 2)
        for k, own, zeros, ones, log_w, *_ in weigh(keys.view(np.uint64), train.astype(float), depth, 2):
            if not len(own):
                continue
            parent, place = np.unique(own & _U((1 << (8 + k)) - 1), return_inverse=True)
            total = [np.bincount(place, x, len(parent)) for x in (zeros, ones, log_w)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((parent >> _U(k)).astype(np.int32)), pa.array((parent & _U((1 << k) - 1)).astype(np.int32) | 1 << k), *map(pa.array, total)],
                ["byte", "node", "zeros", "ones", "log_w"])
    schema = "byte int, node int, zeros double, ones double, log_w double"
    upper = dealt("n_train").mapInArrow(sums, schema).groupBy("byte", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log_w"))
    top = counts.sparkSession.sparkContext.broadcast(Top(map(tuple, upper.collect())))  # at most 256 x 255 rows

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, train, every = _partition(batches, 3)
        if len(keys):
            value = log10_probabilities(keys.view(np.uint64), train.astype(float), depth, top.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(value), pa.array(every)], ["key", "value", "n_all"])
    return dealt("n_train", "n_all").mapInArrow(values, "key long, value double, n_all long")


class HotTable:
    """Values of 64-bit keys. An open table has key and value side by side, so a look-up reads one place; keys that are given first are
    found soonest. An empty place has no number as its value; a key not in the table has no value. It is made when it is first used, so
    only keys and values are sent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given, self.rows = (keys, values), None

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys) - 1).bit_length())
        places = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = left[places[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            places[slot[put]] = put
            left = left[places[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.rows = np.zeros(len(places), [("key", np.uint64), ("value", np.float64)])
        self.rows["value"] = np.nan
        used = np.flatnonzero(places >= 0)
        self.rows["key"][used], self.rows["value"][used] = keys[places[used]], values[places[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, or 0; places of the keys that have none)."""
        def look(slot, keys):
            rows = self.rows.take(slot)
            used, same = ~np.isnan(rows["value"]), rows["key"] == keys
            return rows["value"], used & same, used & ~same  # an empty place ends the search

        if self.rows is None:
            self._build(*self.given)
            self.given = None
        slot = self._slot(keys)
        value, found, on = look(slot, keys)
        out, left = np.where(found, value, 0.0), np.flatnonzero(on)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            value, hit, on = look(slot, keys[left])
            out[left[hit]] = value[hit]
            found[left[hit]] = True
            left, slot = left[on], slot[on]
        return out, np.flatnonzero(~found)


def hot_rows(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Keys and values of the most frequent keys, most frequent first, and their smallest count: all keys that have it or more are at most ``most``."""
    classes = sorted(model.groupBy(F.floor(F.log2("n_all") * 8).alias("c")).agg(F.count(F.lit(1)), F.min("n_all")).collect(), reverse=True)
    total, least = 0, None
    for _, n, smallest in classes:  # a row for each eighth of a doubling
        total += n
        if total > most:
            break
        least = smallest
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), None
    table = model.where(F.col("n_all") >= least).select("key", "value", "n_all").toArrow()
    order = np.argsort(-table["n_all"].to_numpy(), kind="stable")
    return table["key"].to_numpy().view(np.uint64)[order], table["value"].to_numpy()[order], least


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", depth: int = 6, hot: int = HOT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``held_out`` is a boolean column expression over ``docs``; rows where it isn't true are learned from. ``score`` is the
    log10 probability of the whole text and its end, A-Z lower-cased; ``base_score`` that of its words and end by smoothed counts;
    bits_per_byte the code length by ``score`` over bytes and end. A null text is empty. Rows with null or repeated keys are scored
    one by one. Other columns of ``docs`` aren't returned. If nothing is learned from, every bit has probability one half.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).alias("_text"))
    counts = written(key_counts(rows.withColumn("_train", ~F.col("_held")), depth, "_text", "_train"), "counts")
    n_train, v_train = counts.where((F.col("kind") == WORD) & (F.col("n_train") > 0)).agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.where(~F.col("_held")).count()
    total, kinds_of = n_train + ends, v_train + int(ends > 0)
    runs = run_probabilities(counts, depth).withColumn("kind", F.lit(RUN).cast("byte"))
    own = counts.where(F.col("kind") == WORD).select("key", F.log10(F.col("n_train") + 1).alias("value"), "n_all", "kind")
    model = written(runs.unionByName(own), "model")
    # at most ``hot`` keys a kind: 32 MB each; a worker makes its table once, of 64 MB
    tables, rare = {}, {}
    for k in (RUN, WORD):
        of_kind = model.where(F.col("kind") == k)
        keys, values, least = hot_rows(of_kind, hot)
        tables[k], rare[k] = HotTable(keys, values), of_kind if least is None else of_kind.where(F.col("n_all") < least)
    frequent = docs.sparkSession.sparkContext.broadcast(tables)
    del tables, keys, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, number = words.Powers(SCORE_BYTES), TaskContext.get().partitionId() << 40
        table = frequent.value
        for batch in batches:
            for row, data, offsets in words.slices(batch.column(2), SCORE_BYTES):
                n = len(offsets) - 1
                starts, stops, word_first = words.word_spans(data, offsets)
                hashes = words.word_hashes(data, starts, stops, powers)
                seqs, run_first = text_runs(data, offsets, depth)
                out = {}
                for k, keys, first in ((RUN, seqs, run_first), (WORD, hashes, word_first)):
                    value, missing = table[k].get(keys)
                    known = (value > 0).astype(np.int64)
                    sums = np.concatenate(([0.0], np.cumsum(value)))
                    out[k] = (sums[first[1:]] - sums[first[:-1]], np.concatenate(([0], np.cumsum(known))),
                              pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, first).astype(np.int32)), pa.array(keys[missing].view(np.int64))), first)
                known = np.diff(out[WORD][1][out[WORD][3]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(number + np.arange(n)), pa.array(np.diff(word_first) + 1),
                     pa.array(known), pa.array(out[WORD][0]), pa.array(out[RUN][0]), pa.array(np.diff(offsets)), out[WORD][2], out[RUN][2]],
                    ["key", "held", "row", "n_tokens", "known", "base", "score", "n_bytes", "word_left", "run_left"])
                number += n
    parts = written(rows.mapInArrow(run, f"key {kind}, held boolean, row long, n_tokens long, known long, base double, score double, n_bytes long, "
                                    "word_left array<long>, run_left array<long>"), "parts")

    def left(k: int, column: str) -> DataFrame:
        # keys of the model are different and dealt by their hash, so a task's share is a small table, whatever the texts; nothing is sorted
        values = rare[k].select("key", "value").hint("shuffle_hash")
        return parts.select("row", F.explode(column).alias("key")).join(values, "key").select("row", F.lit(k).alias("kind"), "value")
    more = left(WORD, "word_left").unionByName(left(RUN, "run_left")).groupBy("row").agg(
        F.sum(F.when(F.col("kind") == WORD, F.col("value"))).alias("more_base"), F.sum(F.when(F.col("kind") == RUN, F.col("value"))).alias("more_score"),
        F.sum(F.when((F.col("kind") == WORD) & (F.col("value") > 0), 1)).alias("more_known"))
    zero = F.lit(0)
    base = F.col("base") + F.coalesce("more_base", zero) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + kinds_of + 1)
    value = F.col("score") + F.coalesce("more_score", zero)
    return parts.drop("word_left", "run_left").join(more, "row", "left").select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score"),
        (-value * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
