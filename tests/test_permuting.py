"""Permutations are exact, follow the seed and the epoch, and need no exchange."""

import pytest
from pyspark.sql import functions as F

from mselect.operators import permuting


def plain(n, seed, x, epoch=0):
    """The same walk with Python's whole numbers."""
    a, b = permuting.sides(n)
    while True:
        left, right = x % a, x // a
        for r, (f, s, g) in enumerate(permuting.round_keys(seed)):
            t = (right * f + epoch * g + s) % 2 ** 31
            left, right = right, (left + (t * t >> 15)) % (b if r % 2 else a)
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 99, 101, 1000])
def test_exact_permutation(spark, n):
    got = dict(permuting.permuted(spark.range(n), n, 7, "id").collect())
    assert sorted(got.values()) == list(range(n))
    assert got == {x: plain(n, 7, x) for x in range(n)}


def test_large_range(spark):
    n = (1 << 61) - 1
    xs = [0, 1, 2, n // 2, n - 2, n - 1]
    got = dict(permuting.permuted(spark.createDataFrame([(x,) for x in xs], "pos long"), n, 3).collect())
    assert got == {x: plain(n, 3, x) for x in xs}


def test_epochs_differ_and_cover_all(spark):
    out = permuting.shuffled_epochs(spark.range(500).withColumnRenamed("id", "pos"), 500, 1, 32, 3).collect()
    orders = [tuple(r.pos for r in sorted(out, key=lambda r: r.shuffled) if r.epoch == e) for e in (1, 2, 3)]
    assert len(set(orders)) == 3 and all(sorted(o) == list(range(500)) for o in orders)
    assert all(r.minibatch * 32 + r.offset == r.shuffled for r in out)
    # a stretch of neighbours doesn't stay together
    for o in orders:
        assert sum(abs(x - y) == 1 for x, y in zip(o, o[1:])) < 15


def test_spread_over_seeds(spark):
    """Each of ten positions gets to each of ten places about equally often, and pairs too."""
    seeds, n = 4000, 10
    places = [[plain(n, s, x) for x in range(n)] for s in range(seeds)]
    want = seeds / n
    chi = sum((sum(p[x] == y for p in places) - want) ** 2 / want for x in range(n) for y in range(n))
    assert chi < 81 + 6 * (2 * 81) ** 0.5
    pairs = {}
    for p in places:
        pairs[p[0], p[1]] = pairs.get((p[0], p[1]), 0) + 1
    want = seeds / 90
    assert sum((c - want) ** 2 / want for c in pairs.values()) + (90 - len(pairs)) * want < 89 + 6 * (2 * 89) ** 0.5


def test_edges(spark):
    df = spark.createDataFrame([(None, 1), (0, 2), (0, 3)], "pos long, shuffled int")
    assert [r[0] for r in permuting.permuted(df, 4, 1, name="p").select("p").collect()] == [None, plain(4, 1, 0), plain(4, 1, 0)]
    assert permuting.shuffled_epochs(df.where("false"), 0, 1, 4, 2).collect() == []
    for wrong in (4, -1):
        with pytest.raises(Exception, match="outside 0 to 3"):
            permuting.permuted(df.select(F.lit(wrong).alias("pos")), 4, 1).collect()


def test_no_exchange(spark, capsys):
    permuting.shuffled_epochs(spark.range(1000).withColumnRenamed("id", "pos"), 1000, 1, 32, 3).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Sort" not in plan
