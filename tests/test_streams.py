"""Streams over several micro-batches give the rows of the table operators."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.operators.sequence import event_gaps
from mselect.streaming import streams


@pytest.fixture
def files(events, tmp_path):
    """The event table cut into time-ordered files."""
    src = events.select(F.col("user_id").cast("string").alias("worker"), F.col("ts").alias("t"), F.col("event_type").alias("info"),
                        F.col("event_id").alias("pos"), F.col("value").alias("utilization"))
    step = events.count() // 4 + 1
    for i in range(4):
        src.where(F.floor(F.col("pos") / step) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return src, str(tmp_path / "in")


def test_gaps_across_batches(spark, files):
    src, path = files
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drain(streams.stream_event_gaps(stream))
    assert rows(got) == rows(event_gaps(src))


def test_utilization_windows(spark, files):
    src, path = files
    as_time = F.col("t").cast("timestamp")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("t", as_time)
    got = rows(streams.drain(streams.stream_utilization(stream, "1 hour", "5 minutes")))
    table = src.withColumn("t", as_time)
    limit = table.agg(F.max("t") - F.expr("INTERVAL 5 MINUTES")).first()[0]
    want = rows(streams.stream_utilization(table, "1 hour").where(F.col("window_end") <= F.lit(limit)))
    assert got == want and got


def test_sliding_windows(events):
    table = events.select(F.lit("w").alias("worker"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("utilization"))
    n = streams.stream_utilization(table, "1 hour", slide="30 minutes").agg(F.sum("n")).first()[0]
    assert n == 2 * table.count()


def late_files(spark, events, folder, files=6, swap=1):
    """Four hours of events by time in files, each file's second half in the file after it; arrival is out of order."""
    src = events.select(F.col("user_id").cast("string").alias("worker"), F.col("ts").alias("t"), F.col("event_type").alias("info"),
                        F.col("event_id").alias("pos")).orderBy("t", "pos").collect()
    step = len(src) // files + 1
    parts = [[] for _ in range(files + swap)]
    for i, r in enumerate(src):
        parts[i // step + (swap if i % step % 2 else 0)].append(r)
    schema = spark.createDataFrame(src[:1]).schema
    for i, p in enumerate(parts):
        spark.createDataFrame(p[::-1], schema).coalesce(1).write.mode("append").parquet(folder)
    table = spark.createDataFrame(src, schema)
    spans = [src[min(len(src), (i + 1) * step) - 1].t - src[max(0, i - swap) * step].t for i in range(files)]
    return table, max(spans).total_seconds()


def before_watermark(table, lateness, idle):
    """Gaps of the table operator whose later event is behind the last watermark."""
    from mselect.operators.sequence import Ordered, seconds_between

    limit = table.agg((F.floor(F.max(F.unix_micros(F.col("t").cast("timestamp"))) / 1000) * 1000 - lateness * 1000000).alias("m")).first().m
    seq = Ordered(table, ["worker"], ["t", "pos"]).shift({"_t0": "t", "_i0": "info"}).done().where("_t0 IS NOT NULL")
    out = seq.where(F.unix_micros(F.col("t").cast("timestamp")) < limit).select(
        "worker", F.concat(F.lit("Between-"), "_i0", F.lit("-"), "info").alias("event"), seconds_between("_t0", "t").alias("seconds"))
    return out if idle is None else out.where(F.col("seconds") <= idle)


@pytest.mark.parametrize("idle", [None, 3000.0])
def test_late_events_give_the_table_result(spark, events, tmp_path, idle):
    table, span = late_files(spark, events, str(tmp_path / "late"))
    lateness = int(span) + 1
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = rows(streams.drain(streams.stream_late_gaps(stream, f"{lateness} seconds", idle)))
    want = rows(before_watermark(table, lateness, idle))
    assert got == want and got


def test_idle_workers_leave_no_state(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    schema = "worker string, t timestamp_ntz, info string, pos long"
    early = [(f"w{i}", start + timedelta(seconds=s), "e", s) for i in range(20) for s in (5, 1, 3)] + [("w0", None, "e", 9)]
    late = [("w0", start + timedelta(seconds=2), "e", 2)]  # behind the watermark by then
    marks = [[("clock", start + timedelta(seconds=s), "m", s)] for s in (500, 1000, 1500)]
    folder = str(tmp_path / "idle")
    for part in (early, marks[0], late, *marks[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = streams.stream_late_gaps(stream, "10 seconds", 60.0).writeStream.format("memory").queryName("idle_gaps").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = rows(spark.table("idle_gaps"))
    assert got == sorted([(f"w{i}", "Between-e-e", 2.0) for i in range(20) for _ in range(2)], key=repr)
    kept = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state"))
    assert {r.key.worker for r in kept.collect()} <= {"clock"}
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert {r.key.worker for r in waiting.collect()} <= {"clock"}
