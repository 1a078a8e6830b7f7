"""Order-dependent operators give the same rows whether or not large keys are split into blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.operators import sequence as seq
from mselect.operators.ranking import sample_exact
from mselect.plans.reports import pair_records


@pytest.fixture(scope="module")
def skewed(events):
    """A third of all rows on one key, many equal times, some nulls, a null key."""
    return events.select(
        F.when(F.col("event_id") % 3 == 0, F.lit(1)).when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.col("user_id")).alias("worker"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t"), F.col("event_id").alias("pos"), F.col("event_type").alias("info"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value")).cache()


def both(build):
    return rows(build(1)), rows(build(40))


@pytest.mark.parametrize("steps", [1, 3, -1, -2])
@pytest.mark.parametrize("keys", [["worker"], []])
def test_shift(skewed, steps, keys):
    plain, split = both(lambda n: seq.Ordered(skewed, keys, ["t", "pos"], n).shift({"a": "info", "b": "value"}, steps).done())
    assert plain == split


@pytest.mark.parametrize("keys", [["worker"], []])
def test_running(skewed, keys):
    kinds = {"c": ("count", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "l": ("last", "value"), "s": ("sum", "pos")}
    plain, split = both(lambda n: seq.Ordered(skewed, keys, ["t", "pos"], n).running(kinds).done())
    assert plain == split


@pytest.mark.parametrize("keys", [["worker"], []])
def test_position(skewed, keys):
    plain, split = both(lambda n: seq.Ordered(skewed, keys, ["t", "pos"], n).position().done())
    assert plain == split


def test_event_gaps_keep_line_order(spark):
    t = dt.datetime(2021, 1, 1)
    log = spark.createDataFrame([("w", t, "a", 1), ("w", t, "b", 2), ("w", t + dt.timedelta(seconds=5), "c", 3), ("v", t, "x", 1)],
                                "worker string, t timestamp_ntz, info string, pos int")
    want = [("w", "Between-a-b", 0.0), ("w", "Between-b-c", 5.0)]
    assert rows(seq.event_gaps(log)) == want
    assert rows(seq.event_gaps(log, blocks=40)) == want


def test_fill_config_and_minibatches(skewed):
    plain, split = both(lambda n: seq.fill_config(skewed, F.when(F.col("info") == "view", F.col("pos")), ["worker"], ["pos"], blocks=n))
    assert plain == split
    plain, split = both(lambda n: seq.minibatch_index(skewed, 8, ["pos"], drop_last=True, blocks=n))
    assert plain == split and len(plain) == skewed.count() // 8 * 8


def test_run_intervals(spark):
    lines = ["A, Start time 2021-01-01 00:00:00", "A, End time 2021-01-01 01:00:00", "B, Start time 2021-01-01 02:00:00",
             "A, TOTAL EXECUTION TIME 3600", "A, Start time 2021-01-02 00:00:00  ", "A, End time 2021-01-02 03:00:00", "B, End time 2021-01-03 00:00:00"]
    log = spark.createDataFrame(list(enumerate(lines)), "pos int, value string")
    a = dt.datetime(2021, 1, 2), dt.datetime(2021, 1, 2, 3)
    for n in (None, 1, 5):
        assert rows(seq.run_intervals(log, "A", blocks=n)) == [a]
        assert rows(seq.run_intervals(log, "B", blocks=n)) == [(dt.datetime(2021, 1, 1, 2), dt.datetime(2021, 1, 3))]
        assert rows(seq.run_intervals(log, "C", blocks=n)) == []
        # any method: B's end closes the interval A opened last
        assert rows(seq.run_intervals(log, "A", find_first=True, blocks=n)) == [(a[0], dt.datetime(2021, 1, 3))]


def test_pair_records_resynchronises(spark):
    lines = ["", "2021-01-01 00:00:00", "10%,20%", "2021-01-01 00:00:01", "2021-01-01 00:00:02", "30%,1.5e1%", "junk", "2021-01-01 00:00:03"]
    log = spark.createDataFrame([("w1", "f", i, v) for i, v in enumerate(lines)], "worker string, file string, pos int, value string")
    want = [("w1", "f", dt.datetime(2021, 1, 1, 0, 0, 0), 10.0, 20.0), ("w1", "f", dt.datetime(2021, 1, 1, 0, 0, 2), 30.0, 15.0)]
    assert rows(pair_records(log, "cpu")) == want
    assert rows(pair_records(log, "cpu", blocks=40)) == want


def test_normalize_speedup_baseline(spark):
    df = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 4.0), ("z", 1, 0.0), ("z", 2, 0.0)], "method string, size int, x double")
    assert rows(seq.normalize_to_first(df, ["method"], "size", ["x"])) == [("a", 1, 1.0), ("a", 2, 0.5), ("z", 1, 1.0), ("z", 2, 1.0)]
    assert rows(seq.speedup(df.where("method = 'a'"), ["method"], "size", "x").select("size", "speedup")) == [(1, 1.0), (2, 2.0)]


@pytest.mark.parametrize("fraction", [0.0, 0.025, 0.5, 1.0])
def test_sample_exact(events, fraction):
    ids = events.select(F.col("event_id").alias("id"))
    n = ids.count()
    one = rows(sample_exact(ids, fraction, 42, "id"))
    assert len(one) == round(fraction * n) == len(set(one))
    assert one == rows(sample_exact(ids.repartition(3), fraction, 42, "id"))


def test_sample_exact_refuses_repeated_keys(spark):
    with pytest.raises(ValueError, match="unique"):
        sample_exact(spark.range(100).selectExpr("1 AS id"), 0.5, 1, "id")


def test_a_sample_of_a_repeated_key_is_exact_or_an_error(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(i,) for i in range(2, 12)], "id long")
    for seed in range(6):
        try:
            assert sample_exact(df, 0.5, seed).count() == 10
        except ValueError:
            pass
    for n in range(21):
        assert sample_exact(spark.range(20), n / 20, n).count() == n


def test_a_hot_key_spans_blocks(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    seq_ = seq.Ordered(df, ["k"], ["o"], 12)
    assert seq_.df.where("k = 7").select("_block").distinct().count() > 2
    assert [r.pos for r in seq_.position().done().where("k = 7").orderBy("o").collect()] == list(range(301))
