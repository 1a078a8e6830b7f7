"""SimHash near-duplicates against brute force over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mselect.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams):
            bits |= 1 << b
    return bits


def brute_components(fps, distance=3):
    """Smallest index reachable from each of ``fps``, by trying all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", None, " \n", "one", "One TWO", "a b c", "a b c d a b c d", "é Ä\x0bß\x1fx y", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("distance,segments", [(3, 2), (3, 4), (5, 2), (0, 2)])
def test_links_are_all_pairs_within_the_distance(spark, distance, segments):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df, distance, segments).collect()}
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}
    assert got == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (1049, 2000)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in [*range(1000, 1050), 2000]}}


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_with_copies_nulls_and_other_columns(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "  "] + ["same text of a large group"] * 40
    for _ in range(12):
        base = rng.choices(vocab, k=120)
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rng.randrange(120)] = "changed"
            texts.append(" ".join(other))
    rows = [(i * 3, t, 1, "x") for i, t in enumerate(texts)] + [(None, "lonely words of no key at all", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, least string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain(t) for t in texts]
    root = brute_components(fps)
    want = {i * 3: (signed(fps[i]), root[i] * 3) for i in range(len(texts))}
    assert {r.doc_id: (r.fp, r.component) for r in got if r.doc_id is not None} == want
    assert [r.component for r in got if r.doc_id is None] == [None]
    sizes = defaultdict(int)
    for r in got:
        sizes[r.component] += 1
    assert sizes[0] == 3 and sizes[9] == 40


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    assert [r.component for r in simhash.near_duplicates(twice).collect()] == [5, 5]


def test_the_join_verifies_before_it_emits(spark):
    df = spark.range(64).select(F.col("id").alias("fp"))
    plan = simhash.links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan.split("Join", 1)[1].split("\n", 1)[0]
