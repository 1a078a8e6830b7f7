"""Context-tree weighting against a recursive tree over single bits, and the word baseline against plain counts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mselect.llm import ctw


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.known = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for text in texts:
            for context, byte in self.places(text):
                for k in range(8):
                    head, bit = byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1
                    for d in range(depth + 1):
                        self.counts[context[depth - d:], head][bit] += 1
                        if d < depth:
                            self.children[context[depth - d:], head].add(context[depth - d - 1:])

    def places(self, text):
        data = bytes(self.depth) + re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode() + b"\0"
        return [(data[i - self.depth: i], data[i]) for i in range(self.depth, len(data))]

    def log_w(self, context, head):
        if (context, head) not in self.known:
            kt = log_kt(*self.counts[context, head])
            if len(context) == self.depth:
                self.known[context, head] = kt
            else:
                below = sum(self.log_w(c, head) for c in self.children[context, head])
                self.known[context, head] = np.logaddexp(kt, below) - math.log(2)
        return self.known[context, head]

    def bit(self, context, head, bit, d=0):
        own = context[self.depth - d:]
        if (own, head) not in self.counts:
            return None
        n = self.counts[own, head]
        kt = (n[bit] + 0.5) / (sum(n) + 1)
        below = self.bit(context, head, bit, d + 1) if d < self.depth else None
        if below is None:
            return kt
        w = math.exp(log_kt(*n) - math.log(2) - self.log_w(own, head))
        return w * kt + (1 - w) * below

    def score(self, text):
        return sum(math.log10(self.bit(c, b >> (8 - k) | 1 << k, b >> (7 - k) & 1) or 0.5) for c, b in self.places(text) for k in range(8))


@pytest.mark.parametrize("depth,hot", [(2, 1 << 20), (3, 5), (4, 0)])
def test_scores(spark, depth, hot):
    rng = random.Random(depth)
    texts = [" ".join(rng.choices(["the", "cat", "Sat", "on", "mät", "x"], k=rng.randint(0, 12))) for _ in range(40)]
    rows = [(i, t, i % 3 == 1, 1.0) for i, t in enumerate(texts)] + [(None, None, None, 1.0), (0, texts[0], False, 1.0), (99, "zzz \n\x0b new\x00", True, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean, score double")
    got = ctw.score(df, F.col("h"), depth=depth, hot=hot).collect()
    assert len(got) == len(rows)
    train = [t for _, t, h, _ in rows if not h]
    tree = Tree(train, depth)
    counts = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""])
    total = sum(counts.values())
    by = {(r.doc_id, r.held_out): r for r in got}
    for i, t, h, _ in rows:
        r = by[i, bool(h)]
        own = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own))
        assert r.score == pytest.approx(tree.score(t), rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((t or "").encode()) + 1))


def test_probabilities_of_a_byte_sum_to_one(spark):
    rng = random.Random(7)
    runs = {}
    for _ in range(300):
        runs[bytes(rng.choices(b"ab c", k=4))] = rng.randint(1, 9)
    context = next(iter(runs))[:3]
    keys = np.array([int.from_bytes(r, "big") for r in {*runs, *(context + bytes([b]) for b in range(256))}], np.uint64)
    counts = np.array([runs.get(int(k).to_bytes(4, "big"), 0) for k in keys], float)
    rows = defaultdict(lambda: [0.0, 0.0, 0.0])
    for k, own, zeros, ones, log_w, *_ in ctw.weigh(keys, counts, 3, 2):
        for node, *x in zip(own.tolist(), zeros, ones, log_w):
            parent = node & ((1 << (8 + k)) - 1)
            for i in range(3):
                rows[parent >> k, parent & ((1 << k) - 1) | 1 << k][i] += x[i]
    p = 10 ** ctw.log10_probabilities(keys, counts, 3, ctw.Top((a, b, *x) for (a, b), x in rows.items()))
    mine = [i for i, k in enumerate(keys) if int(k) >> 8 == int.from_bytes(context, "big")]
    assert len(mine) == 256 and p[mine].sum() == pytest.approx(1)


def test_gamma_and_table():
    x = np.array([0.5, 1, 1.5, 7.25, 1000, 1e9])
    assert ctw.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = ctw.HotTable(keys, np.arange(5000.0))
    value, missing = table.get(np.concatenate((keys, keys + np.uint64(1))))
    assert (value[:5000] == np.arange(5000)).all() and (missing == np.arange(5000, 10000)).all()


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ctw.score(df, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(24 * math.log10(0.5))
    assert ctw.score(df.limit(0), F.lit(False)).collect() == []


def test_merging_counts_holds_no_part_twice():
    import tracemalloc

    rng = np.random.default_rng(3)
    keys = [np.unique(rng.integers(0, 1 << 40, 400_000, np.uint64)) for _ in range(4)]
    counts = [np.full(len(k), 1 if i % 2 else 1 << 32) for i, k in enumerate(keys)]
    every = np.concatenate(keys)
    size = 16 * len(every)
    tracemalloc.start()
    key, n = ctw._merge(keys, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == counts == [] and peak < 3 * size
    assert np.array_equal(key, np.unique(every)) and (n & ctw._TRAIN).sum() + (n >> 32).sum() == len(every)


def test_counts_are_added_where_they_meet_and_looked_up_unsorted(spark):
    df = spark.createDataFrame([(i, f"the cat sat {i}") for i in range(20)], "doc_id long, text string")
    plan = ctw.key_counts(df.withColumn("train", F.lit(True)), 6, "text", "train")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("HashAggregate")
    plan = ctw.score(df, F.col("doc_id") % 7 == 2, hot=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2


def test_merging_runs_counts_training_apart():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 50, 300, np.uint64) << np.uint64(50) for _ in range(3)]
    held = [rng.integers(0, 2, 300).astype(bool) for _ in range(3)]
    train, rest = Counter(), Counter()
    for p, h in zip(parts, held):
        train.update(p[~h].tolist())
        rest.update(p[h].tolist())
    given = [p << np.uint64(1) | h for p, h in zip(parts, held)]
    key, n = ctw._merge_runs(given)
    assert given == [] and key.tolist() == sorted(train | rest)
    assert [(x & ctw._TRAIN, x >> 32) for x in n.tolist()] == [(train[k], rest[k]) for k in key.tolist()]


@pytest.mark.parametrize("depth", [6, 7])
def test_counts_of_runs_with_and_without_a_free_bit(spark, depth):
    texts = [("Abab" * 9, True), ("abab\xff", False), (None, True), ("", False)]
    df = spark.createDataFrame(texts, "text string, train boolean")
    every, train = Counter(), Counter()
    for t, trained in texts:
        data = bytes(depth) + (t or "").lower().encode() + b"\0"
        runs = [int.from_bytes(data[i - depth: i + 1], "big", signed=depth == 7) for i in range(depth, len(data))]
        every.update(runs)
        train.update(runs if trained else [])
    got = ctw.key_counts(df, depth, "text", "train").where(F.col("kind") == ctw.RUN).collect()
    assert {r.key: (r.n_all, r.n_train) for r in got} == {k: (every[k], train[k]) for k in every} and len(got) == len(every)


def test_a_table_is_sent_without_its_empty_places():
    import pickle

    keys = np.arange(1, 3001, dtype=np.uint64)
    sent = pickle.dumps(ctw.HotTable(keys, np.arange(3000.0)))
    assert len(sent) < 17 * len(keys)
    value, missing = pickle.loads(sent).get(np.array([3000, 0, 7], np.uint64))
    assert value.tolist() == [2999, 0, 6] and missing.tolist() == [1]
