"""Longest processing time against a plain heap over all groups."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from mselect.llm.sharding import schedule, shard


def plain(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_schedule_has_the_loads_of_a_plain_heap():
    rng = random.Random(1)
    for _ in range(200):
        classes = [(n, rng.choice([1, 2, 5, 40, 300])) for n in rng.sample(range(1, 60), rng.randint(0, 12))]
        shards = rng.randint(1, 9)
        loads, ends = [0] * shards, Counter()
        for size, s, first, end in schedule(classes, shards):
            assert first == ends[size] < end
            ends[size] = end
            loads[s] += size * (end - first)
        assert ends == Counter(dict(classes))
        assert loads == plain([n for n, k in classes for _ in range(k)], shards)


def test_shard(spark):
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 50) for _ in range(300)] + ["copy of one text"] * 100 + [None] * 20
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no key", "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard(df, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by, home = defaultdict(list), {}
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        by[r.shard].append(r.slot)
        assert home.setdefault(text_of[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    totals = Counter()
    for i, t, _ in rows:
        totals[t] += len((t or "").encode()) + 1
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(plain(totals.values(), 4))
    assert shard(df.limit(0), 4).collect() == []
