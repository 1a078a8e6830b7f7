"""Sums of vectors in levels against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mselect.operators.aggregates import weighted_merge
from mselect.operators.merging import merged_chunks, merged_vectors


@pytest.mark.parametrize("chunk,salts", [(4096, 16), (3, 1), (4, 5)])
def test_hot_keys_ragged_vectors_and_nulls(spark, chunk, salts):
    rng = np.random.default_rng(1)
    states = [("hot" if i % 3 else f"k{i % 5}", None if i % 50 == 7 else int(rng.integers(0, 5)),
               None if i % 40 == 3 else [None if rng.random() < .05 else float(rng.normal()) for _ in range(rng.integers(0, 12))]) for i in range(600)]
    states += [(None, 2, [1.0, 2.0])]
    df = spark.createDataFrame(states, "key string, n bigint, w array<double>").repartition(7)
    want = {}
    for key, n, w in states:
        for c, v in enumerate(w or []):
            s = want.setdefault((key, c), [0.0, 0.0])
            s[0] += (n or 0) * (v or 0)
            s[1] += n or 0
    got = {}
    for r in merged_chunks(df, ["key"], chunk=chunk, salts=salts).collect():
        for i, (s, m) in enumerate(zip(r.s, r.m)):
            got[r.key, r.chunk * chunk + i] = (s, m)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(want[k])) for k in want)


def test_many_states_of_one_model(spark):
    """100,000 states; the mean is that of a sum of doubles."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (F.sin(F.col("id") * i) * 5).cast("float"))
    states = spark.range(100_000, numPartitions=8).select(F.lit(3).cast("bigint").alias("model_key"), (F.col("id") % 9).alias("n"), vector.alias("w"))
    got = merged_vectors(states, ["model_key"]).collect()
    ids = np.arange(100_000)
    w = (np.sin(np.outer(ids, np.arange(1, 13))) * 5).astype(np.float32).astype(np.float64)
    assert len(got) == 1 and np.allclose(got[0].w, np.average(w, axis=0, weights=ids % 9), atol=1e-6)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (3, [5.0])], "n bigint, w array<double>")
    assert sorted(tuple(r) for r in weighted_merge(df).collect()) == [(0, 4.0, 4.0), (1, 2.0, 1.0)]
    assert weighted_merge(df.limit(0)).collect() == []
    assert weighted_merge(spark.createDataFrame([(0, [1.0])], "n bigint, w array<double>")).first().w is None
