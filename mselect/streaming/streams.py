"""Monitor logs and event logs as streams."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mselect.session import ensure_checkpoint_dir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

GAP_SCHEMA = StructType([StructField("worker", StringType()), StructField("event", StringType()),
                         StructField("micros", LongType())])


def stream_utilization(source: DataFrame, window: str = "10 minutes", lateness: str = "5 minutes", slide: str | None = None,
                       worker: str = "worker", time: str = "t", value: str = "utilization") -> DataFrame:
    """Mean value per worker and time window; rows later than the watermark are left out.

    Works on a stream or a table. Partial sums per window are kept, so a busy worker costs no more state than a quiet one.
    """
    span = F.window(time, window, slide) if slide else F.window(time, window)
    seen = source.withWatermark(time, lateness) if source.isStreaming else source
    out = seen.groupBy(span.alias("w"), worker).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), worker, value, "n")


class _GapProcessor(StatefulProcessor):
    """Keeps the last event of a worker; rows of a micro-batch are taken in (time, tie) order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "micros LONG, info STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["micros", "tie"], kind="stable")
        micros, infos = pdf["micros"].to_numpy(), pdf["info"].to_numpy()
        before = self._last.get() if self._last.exists() else None
        out = []
        if before is not None:
            out.append((key[0], f"Between-{before[1]}-{infos[0]}", int(micros[0] - before[0])))
        out += [(key[0], f"Between-{a}-{b}", int(y - x))
                for a, b, x, y in zip(infos[:-1], infos[1:], micros[:-1], micros[1:])]
        self._last.update((int(micros[-1]), str(infos[-1])))
        yield pd.DataFrame(out, columns=["worker", "event", "micros"])

    def close(self) -> None:
        pass


def stream_event_gaps(source: DataFrame, worker: str = "worker", time: str = "t", info: str = "info",
                      tie: str = "pos") -> DataFrame:
    """Adjacent events of each worker as they arrive: (worker, event, seconds). Batches must arrive in time order.

    State is one row per worker. A worker's rows of one micro-batch meet in one task, so bound the batch by the
    source's rate limit (``maxFilesPerTrigger``).
    """
    spark = source.sparkSession
    # the state runner on the driver does not see shipped packages, so the processor travels with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # keyed state of this kind needs the RocksDB store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ntz = source.schema[time].dataType.typeName() == "timestamp_ntz"
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(time)) if ntz else F.unix_micros(time)
    rows = source.select(F.col(worker).cast("string").alias("worker"), micros.alias("micros"),
                         F.col(info).alias("info"), F.col(tie).cast("long").alias("tie"))
    gaps = rows.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=_GapProcessor(), outputStructType=GAP_SCHEMA, outputMode="append", timeMode="none")
    return gaps.select("worker", "event", (F.col("micros") / 1e6).alias("seconds"))


def drain(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over all data that is there now into Parquet files and return the result as a table.

    Without ``path`` the files go next to the checkpoints, in a folder of their own.
    """
    spark = stream.sparkSession
    root = path or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/data").option(
        "checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


class _LateGapProcessor(StatefulProcessor):
    """Keeps a worker's events until the watermark has passed them, and the last event that it has passed."""

    def __init__(self, idle: int | None):
        self._idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "micros LONG, tie LONG, info STRING")
        self._last = handle.getValueState("last", "micros LONG, info STRING")

    def _wake(self, micros: int) -> None:
        # the first millisecond at which an event of this time is in the past
        self._handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            pdf = pdf[pdf["micros"] >= passed]
            if len(pdf):
                self._waiting.appendList(list(zip(pdf["micros"].tolist(), pdf["tie"].tolist(), pdf["info"].tolist())))
                low = int(pdf["micros"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        waiting = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        due = sorted((r for r in waiting if r[0] < passed), key=lambda r: (r[0], r[1]))
        last = self._last.get() if self._last.exists() else None
        for micros, _, info in due:
            if last is not None and (self._idle is None or micros - last[0] <= self._idle):
                out.append((key[0], f"Between-{last[1]}-{info}", micros - last[0]))
            last = (micros, info)
        if due:
            rest = [r for r in waiting if r[0] >= passed]
            if rest:
                self._waiting.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self._waiting.clear()
            self._last.update(last)
            if self._idle is not None:
                self._wake(last[0] + self._idle)
        elif last is not None and self._idle is not None and last[0] + self._idle < passed:
            # any event still to come is more than the idle time away
            self._last.clear()
        if out:
            yield pd.DataFrame(out, columns=["worker", "event", "micros"])

    def close(self) -> None:
        pass


def stream_late_gaps(source: DataFrame, lateness: str = "10 minutes", idle: float | None = 86400.0, worker: str = "worker",
                     time: str = "t", info: str = "info", tie: str = "pos") -> DataFrame:
    """Adjacent events of each worker whatever the order they arrive in: (worker, event, seconds).

    An event waits until the watermark, ``lateness`` behind the latest time seen, has passed it; then all events
    before it are known, and its gap is given. The result is that of ``event_gaps`` on the events before the watermark, equal times in
    the order of ``tie``. Events that come behind the watermark are left out, as are rows without a time. Gaps of more than ``idle``
    seconds are left out, so a worker that has been silent for that time leaves no state; with None no gap is left out and a worker's
    last event is kept for good. State is the events of one lateness, in RocksDB, sorted when their timer fires.
    """
    spark = source.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ntz = source.schema[time].dataType.typeName() == "timestamp_ntz"
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(time)) if ntz else F.unix_micros(time)
    rows = source.where(F.col(time).isNotNull()).select(
        F.coalesce(F.col(worker).cast("string"), F.lit("")).alias("worker"), micros.alias("micros"),
        F.coalesce(F.col(info).cast("string"), F.lit("")).alias("info"), F.col(tie).cast("long").alias("tie"))
    # through microseconds, so that no time zone shifts a time without zone
    timed = rows.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", lateness)
    gaps = timed.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=_LateGapProcessor(None if idle is None else round(idle * 1e6)), outputStructType=GAP_SCHEMA,
        outputMode="append", timeMode="eventtime")
    return gaps.select("worker", "event", (F.col("micros") / 1e6).alias("seconds"))
