"""Packing: every piece once, sequences full to the brim, and as few of them as exhaustive search finds."""

import random
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import pytest

from mselect.llm.packing import averaged, dearest, fractional, pack, plan, sequences

import numpy as np


def exact(counts, capacity):
    lengths = sorted(counts, reverse=True)
    fits = [c for c in product(*(range(min(counts[n], capacity // n) + 1) for n in lengths))
            if any(c) and sum(n * k for n, k in zip(lengths, c)) <= capacity]

    @lru_cache(None)
    def need(left):
        if not any(left):
            return 0
        first = next(i for i, k in enumerate(left) if k)
        return 1 + min(need(tuple(a - b for a, b in zip(left, c))) for c in fits
                       if c[first] and all(a >= b for a, b in zip(left, c)))
    return need(tuple(counts[n] for n in lengths))


def test_plans_hold_each_length_and_need_hardly_more_than_the_least():
    rng = random.Random(1)
    for _ in range(30):
        counts = {n: rng.randint(1, 4) for n in rng.sample(range(1, 13), 4)}
        chosen = plan(counts, 12)
        held = Counter()
        for config, times in chosen:
            assert sum(n * k for n, k in config) <= 12
            for n, k in config:
                held[n] += k * times
        assert held == counts
        assert sum(t for _, t in chosen) <= exact(counts, 12) + 1


def test_dearest_is_the_best_knapsack():
    rng = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 16), 4)))
        prices = np.array([rng.random() for _ in lengths])
        config = dict(dearest(lengths, prices, 15))
        value = sum(prices[list(lengths).index(n)] * k for n, k in config.items())
        best = max(sum(p * k for p, k in zip(prices, c)) for c in product(*(range(15 // n + 1) for n in lengths))
                   if sum(n * k for n, k in zip(lengths, c)) <= 15)
        assert value == pytest.approx(best)


def test_the_program_is_near_its_bound():
    rng = random.Random(3)
    counts = dict(Counter(min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(20_000)))
    bound = sum(n * k for n, k in counts.items()) / 256
    assert sum(fractional(counts, 256).values()) < 1.01 * bound
    assert sum(t for _, t in plan(counts, 256)) < 1.01 * bound


def test_pack_places_every_row_once(spark):
    rng = random.Random(4)
    rows = [(i, 0, 32 if i % 3 == 0 else rng.randint(1, 32), "x") for i in range(2000)] + [(5, 1, 4, "x"), (5, 1, 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string")
    got = pack(df, 32, ["doc_id", "piece"]).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter((a, b, c) for a, b, c, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32
    assert len(by) <= 1.01 * sum(r[2] for r in rows) / 32


def test_sequences_and_the_empty_table(spark):
    df = spark.createDataFrame([(1, 2, bytearray(b"aaaabbbb")), (2, 1, bytearray(b"cccc")), (3, 3, bytearray(b"ddddeeeeffff"))],
                               "doc_id long, length long, ids binary")
    out = sequences(pack(df, 3, ["doc_id"])).collect()
    assert sorted(bytes(r.ids) for r in out) == [b"aaaabbbbcccc", b"ddddeeeeffff"] and {r.length for r in out} == {3}
    assert pack(df.limit(0), 3, ["doc_id"]).collect() == []
    odd = pack(spark.createDataFrame([(1, None), (2, 3)], "doc_id long, length long"), 3, ["doc_id"])
    assert sorted(tuple(r) for r in odd.collect()) == [(1, None, None, None), (2, 3, 0, 0)]
    with pytest.raises(ValueError):
        plan({4: 1}, 3)


@pytest.mark.parametrize("counts, capacity", [
    ({560: 19_000, 336: 5_000, 320: 13_000}, 1024), ({600: 900, 500: 4_000, 420: 3_000, 260: 2_500, 70: 100}, 1024),
    ({51: 1_000, 27: 2_000, 26: 2_000, 23: 3_000}, 100), ({7: 10_000, 5: 10_000, 3: 10_000}, 16)])
def test_few_lengths_are_near_the_dual_bound(counts, capacity):
    x, bound = averaged(counts, capacity, [], 0.01, 200_000)
    assert sum(x.values()) <= 1.01 * bound
    for n, k in counts.items():
        assert sum(u * dict(c).get(n, 0) for c, u in x.items()) >= k * (1 - 1e-9)
    chosen = plan(counts, capacity)
    assert sum(t for _, t in chosen) <= 1.01 * bound + 3
    for n, k in counts.items():
        assert sum(dict(c).get(n, 0) * t for c, t in chosen) == k
