"""Stopped runs go on to the result of a run that wasn't stopped; caches follow their inputs."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.operators import packing as pack
from mselect.search import adaptive
from mselect.sources import readers
from mselect.sources.runs import Steps, fingerprint
from mselect.training import loops


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(60).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(9)).cast("float") for j in range(3)]).alias("x"),
                                (F.col("id") % 2).cast("int").alias("y"))
    return loops.prepare(pack.pack(df, 10, 2, [0, 1], dist=F.pmod("id", F.lit(2))).drop("unseen"), 2)


def test_steps(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n).withColumn("a", F.array(F.lit(1.5)))

    one, two = Steps(spark, str(tmp_path), "k1"), Steps(spark, str(tmp_path), "k2")
    assert one.done("s") is None
    assert rows(one.run("s", lambda: build(3))) == rows(one.run("s", lambda: build(4))) == [(0, [1.5]), (1, [1.5]), (2, [1.5])]
    assert two.run("s", lambda: build(5)).count() == 5 and one.done("s").count() == 3 and made == [3, 5]
    assert one.run("empty", lambda: build(0)).columns == ["id", "a"]


def test_rows_without_a_manifest_do_not_count(spark, tmp_path, monkeypatch):
    steps = Steps(spark, str(tmp_path), "k")
    broken = Steps(spark, str(tmp_path), "k")

    class NoRename:
        def __getattr__(self, name):
            if name == "rename":
                raise Stopped
            return getattr(steps._fs, name)

    broken._fs = NoRename()
    with pytest.raises(Stopped):
        broken.commit("s", spark.range(3))
    assert steps.done("s") is None and steps.run("s", lambda: spark.range(2)).count() == 2


def test_hopper_resumes(spark, data, tmp_path, monkeypatch):
    space = spark.createDataFrame([(i, 0.02, 1e-4, 8, "sanity") for i in range(2)],
                                  "ordinal int, learning_rate double, lambda_value double, batch_size int, model string")
    states = loops.init_states(space, 3, 2)
    want_states, want_scores = loops.fit_model_hopper(data, states, 3)
    hop, scored, calls = loops._hop, loops.evaluate, []

    def stop_at_second(packed, now, *a, **k):
        if len([c for c in calls if c == "e"]) == 1:
            raise Stopped
        calls.append("e")
        return scored(packed, now, *a, **k)

    def counted(*a, **k):
        calls.append("h")
        return hop(*a, **k)

    monkeypatch.setattr(loops, "_hop", counted)
    monkeypatch.setattr(loops, "evaluate", stop_at_second)
    with pytest.raises(Stopped):
        loops.fit_model_hopper(data, states, 3, steps=Steps(spark, str(tmp_path), "run"))
    assert calls == ["h", "e", "h"]  # two epochs trained, one scored
    monkeypatch.setattr(loops, "evaluate", scored)
    got_states, got_scores = loops.fit_model_hopper(data, states, 3, steps=Steps(spark, str(tmp_path), "run"))
    assert calls == ["h", "e", "h", "h"]  # the third alone
    assert rows(got_states) == rows(want_states)
    assert rows(got_scores.select("epoch", "model_key", "loss", "metric")) == rows(want_scores.select("epoch", "model_key", "loss", "metric"))


def test_search_resumes(spark, tmp_path):
    space = {"learning_rate": [0.001, 0.1], "lambda_value": [1e-4, 1e-6], "batch_size": [16, 64], "model": ["sanity", "logistic"]}
    calls = []

    def train(trials):
        calls.append(trials.count())
        return trials.select("trial_id", F.lit(1).alias("epoch"), (F.col("learning_rate") * F.col("batch_size")).alias("loss_valid"))

    def stops(trials):
        if len(calls) == 2:
            raise Stopped
        return train(trials)

    want = rows(adaptive.search(spark, space, train, 7, 2))
    assert calls == [2, 2, 2, 1]
    calls.clear()
    with pytest.raises(Stopped):
        adaptive.search(spark, space, stops, 7, 2, steps=Steps(spark, str(tmp_path), "s"))
    got = adaptive.search(spark, space, train, 7, 2, steps=Steps(spark, str(tmp_path), "s"))
    assert rows(got) == want and calls == [2, 2, 2, 1]


def test_fingerprint_follows_inputs(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    first = fingerprint(spark.read.parquet(path), seed=1)
    assert first == fingerprint(spark.read.parquet(path), seed=1) != fingerprint(spark.read.parquet(path), seed=2)
    spark.range(3).write.mode("append").parquet(path)
    assert fingerprint(spark.read.parquet(path), seed=1) != first
    df = spark.range(5)
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("id"))) != fingerprint(df.union(df.limit(1)))
    assert fingerprint(df.where("false")) == fingerprint(df.where("id > 9"))
    files = spark.read.parquet(path)
    assert fingerprint(files.where("id < 3")) != fingerprint(files)


def test_cache_rebuilds_when_its_key_changes(spark, tmp_path):
    path, name, built = str(tmp_path / "t"), "cached_by_key", []
    spark.range(10).write.parquet(path)

    def read():
        source = spark.read.parquet(path)

        def build():
            built.append(1)
            return source.agg(F.count("id").alias("n"))

        return readers.read_cached(spark, name, build, key=fingerprint(source)).first().n

    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert (read(), read(), len(built)) == (10, 10, 1)
    spark.range(4).write.mode("append").parquet(path)
    assert (read(), read(), len(built)) == (14, 14, 2)
    spark.sql(f"DROP TABLE {name}")
