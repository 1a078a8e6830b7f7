"""Reports on runs, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.functions import logs
from mselect.functions.configs import machine_hours
from mselect.operators import aggregates as agg
from mselect.operators.packing import pivot_phases
from mselect.operators.ranking import find_best
from mselect.operators.relational import pair_runs, rename_after_join, time_slice, to_numeric
from mselect.operators.sequence import (Ordered, best_so_far, event_gaps, fill_config, minus_baseline,
                                        normalize_to_first, run_intervals, seconds_between, speedup)

TIME = logs.TIME_FORMAT


def learning_curve(rows: DataFrame, method: str, top_5: bool = True) -> DataFrame:
    """(epoch, error) of the best model of a run."""
    return find_best(rows, method, top_5)


# Numeric fields of a model log and their column names here.
MODEL_LOG_FIELDS = {
    "EPOCH": "epoch", "UNIX TIME": "unix_time", "TRAIN LOSS": "train_loss", "ERROR": "error", "ERROR-1": "error_1",
    "Model Building and Session Initialization Time": "init_time", "Time": "time",
    "Checkpoint Save Time": "save_time", "VALID LOSS": "valid_loss",
}


def model_log_table(lines: DataFrame, keys: Sequence[str] = ("file",), order: Sequence[str] = ("pos",),
                    blocks: int | None = None) -> DataFrame:
    """Value lines of model logs with their numbers, mode, model key (from the file name) and configuration."""
    v = F.col("value")
    kept = lines.where(v.contains("MST") | v.contains("UNIX TIME"))
    config = F.when(v.contains("MST"), F.get(F.split(v, ": "), F.lit(1)))
    filled = fill_config(kept, config, keys, order, "config", blocks).where(v.contains("UNIX TIME"))
    parsed = filled.withColumn("_kv", logs.parse_kv("value", strict=True))
    mode = F.when(F.map_contains_key("_kv", F.lit("VALID LOSS")), "VALID").when(
        F.map_contains_key("_kv", F.lit("TRAIN LOSS")), "TRAIN")
    out = parsed.select(
        *keys, *[F.col("_kv")[name].alias(new) for name, new in MODEL_LOG_FIELDS.items()], mode.alias("mode"), "config")
    out = to_numeric(out, list(MODEL_LOG_FIELDS.values()))
    if "file" in keys:
        base = F.substring_index(F.substring_index("file", "/", -1), ".", 1)
        out = out.withColumn("mst_key", base.try_cast("int"))
    return out


def phase_breakdown(lines: DataFrame, semantics: DataFrame, style: str = "notice", worker: str = "worker",
                    strict: bool = True, blocks: int | None = None) -> DataFrame:
    """Seconds per phase of a log with columns (worker, pos, value)."""
    event = logs.parse_event_line("value", style)
    parsed = lines.select(worker, "pos", event.alias("e")).select(worker, "pos", "e.info", "e.t").where("t IS NOT NULL")
    gaps = event_gaps(parsed, worker, "t", "info", "pos", blocks)
    if not strict:
        by_event = gaps.groupBy("event").agg(F.sum("seconds").alias("seconds"))
        return by_event.join(semantics, "event").groupBy("phase").agg(F.sum("seconds").alias("seconds"))
    return agg.phase_totals(gaps, semantics)


def per_epoch_breakdown(phases: DataFrame, baseline: str = "ctq", keys: Sequence[str] = ("size",), workers: int = 8,
                        epochs: int = 5, file_load_seconds: float = 0.0,
                        file_methods: Sequence[str] = ("da", "spark")) -> DataFrame:
    """Machine hours per epoch by method: train+valid, transmission, hopping and the method's own part.

    ``phases`` has (method, keys, phase, seconds). Transmission above the baseline counts as hopping; file-based
    methods get the given load time and the baseline's hopping, both taken out of train+valid.
    """
    wide = pivot_phases(phases, ["method", *keys])
    moved = minus_baseline(wide, baseline, keys)
    base = wide.where(F.col("method") == baseline).groupBy(*keys).agg(F.max("model_hopping").alias("_hop"))
    joined = moved.join(base, list(keys), "left")
    by_file = F.col("method").isin(*file_methods)
    hop = F.coalesce("_hop", F.lit(0.0))
    parts = joined.withColumns({
        "data_transmission": F.when(by_file, F.lit(file_load_seconds)).otherwise(F.col("data_transmission")),
        "model_hopping": F.when(by_file, hop).otherwise(F.col("model_hopping")),
        "train_valid": F.when(by_file, F.col("train_valid") - file_load_seconds - hop).otherwise(F.col("train_valid")),
        "method_specific": F.col("idle") + F.col("merge"),
    })
    fields = ["train_valid", "data_transmission", "model_hopping", "method_specific"]
    return parts.select("method", *keys, *[machine_hours(f, workers, epochs).alias(f) for f in fields])


def monitor_records(lines: DataFrame, follow: int, keys: Sequence[str] = ("worker", "file"),
                    order: Sequence[str] = ("pos",), blocks: int | None = None) -> DataFrame:
    """Records of a timestamp line and the next ``follow`` lines: (keys, t, v1[, v2]).

    A timestamp line without its value lines is skipped by itself and reading goes on at the next line.
    """
    seq = Ordered(lines, keys, order, blocks)
    for i in range(1, follow + 1):
        seq.shift({f"v{i}": "value"}, -i)
    values = [f"v{i}" for i in range(1, follow + 1)]
    out = seq.done().withColumn("t", logs.parse_time("value")).where("t IS NOT NULL")
    for v in values:
        out = out.where(F.col(v).isNotNull())
    return out.select(*keys, *order, "t", *values)


def pair_records(lines: DataFrame, kind: str, keys: Sequence[str] = ("worker", "file"), order: Sequence[str] = ("pos",),
                 blocks: int | None = None) -> DataFrame:
    """Parsed monitor records. cpu/gpu: utilization and memory; disk: a row per device; network: a row per interface."""
    raw = monitor_records(lines, 2 if kind == "network" else 1, keys, order, blocks)
    head = [*keys, "t"]
    if kind in ("cpu", "gpu"):
        return raw.select(*head, logs.parse_percent("v1", 0).alias("utilization"),
                          logs.parse_percent("v1", 1).alias("memory")).where("utilization IS NOT NULL")
    if kind == "disk":
        return raw.select(*head, F.explode(logs.parse_disk("v1")).alias("d")).select(*head, "d.*")
    # only the two rates are read, so no map is built
    sides = F.array(F.struct(F.lit("CONTROL").alias("iface"), F.col("v1").alias("v")),
                    F.struct(F.lit("EXP").alias("iface"), F.col("v2").alias("v")))
    both = raw.where(logs.names_interface("v1") & logs.names_interface("v2")).select(*head, F.inline(sides))
    return both.select(*head, "iface", logs.kv_value("v", "rxkB/s").try_cast("double").alias("rx"),
                       logs.kv_value("v", "txkB/s").try_cast("double").alias("tx"))


def utilization(lines: DataFrame, start: str | Column, end: str | Column, kind: str = "cpu",
                value: str = "utilization", **options) -> DataFrame:
    """Mean over workers of the mean utilization (or memory) inside the time window."""
    rows = time_slice(pair_records(lines, kind, **options), start, end)
    return agg.mean_of_means(rows.where(F.col(value).isNotNull()), "worker", value)


def disk_report(lines: DataFrame, start: str | Column, end: str | Column, separate: bool = False, **options) -> DataFrame:
    """Disk traffic inside the time window, mean per worker and total."""
    rows = time_slice(pair_records(lines, "disk", **options), start, end)
    return agg.worker_io(agg.device_io(rows), separate)


def network_report(lines: DataFrame, start: str, end: str, **options) -> tuple[DataFrame, DataFrame]:
    """Interface statistics and total GB inside the time window."""
    rows = time_slice(pair_records(lines, "network", **options), start, end)
    kind = "timestamp_ntz"
    seconds = seconds_between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    return agg.network_stats(rows), agg.network_total(rows, seconds)


def run_time(global_log: DataFrame, method: str, find_first: bool = False, blocks: int | None = None) -> DataFrame:
    """Hours from start to end of a run."""
    span = run_intervals(global_log, method, find_first, blocks)
    return span.select((seconds_between("start_time", "end_time") / 3600).alias("hours"))


def search_report(ends: DataFrame, metrics: DataFrame, zero: Column, concurrency: int = 8, epochs: int = 10) -> DataFrame:
    """Per batch of models the time axis in hours and every model's metric list.

    ``ends`` has (batch, epoch, end_time), ``metrics`` (mst_idx, validation_metrics). Batch i takes the i-th run of
    ``epochs`` end times in (batch, epoch) order and the i-th run of ``concurrency`` models in key order.
    """
    timed = Ordered(ends, [], ["batch", "epoch"]).position("_p").done()
    axis = timed.groupBy(F.floor(F.col("_p") / epochs).alias("bag")).agg(
        F.sort_array(F.collect_list(F.struct("_p", (seconds_between(zero, F.col("end_time")) / 3600).alias("h")))).alias("_a"))
    axis = axis.select("bag", F.transform("_a", lambda p: p["h"]).alias("hours"))
    numbered = Ordered(metrics, [], ["mst_idx"]).position("_p").done()
    bags = numbered.withColumn("bag", F.floor(F.col("_p") / concurrency)).drop("_p")
    return bags.join(axis, "bag", "left").select("bag", "mst_idx", "hours", "validation_metrics")


def scaling_report(times: DataFrame, method: str = "method", size: str = "size", seconds: str = "seconds") -> DataFrame:
    """Normalized run time and speedup of every method over cluster sizes."""
    fast = speedup(times, [method], size, seconds)
    return normalize_to_first(fast.withColumn("normalized", F.col(seconds)), [method], size, ["normalized"])


def strategy_speedup(times: DataFrame, over: str = "udaf", under: str = "ctq") -> DataFrame:
    """How many times longer one method takes than the other, by cluster size."""
    return pair_runs(times, over, under)


def search_best(models: DataFrame, keys: Sequence[str] = (), batch: str = "batch", error: str = "error") -> DataFrame:
    """Smallest final error reached up to each batch of a search."""
    per_batch = models.groupBy(*keys, batch).agg(F.min(error).alias(error))
    return best_so_far(per_batch, keys, [batch], error)


def join_info_summary(info: DataFrame, summary: DataFrame, arch: DataFrame) -> DataFrame:
    """(model_id, model_name, validation_metrics, metrics_iters), the epochs of the one-row summary on every model.

    The summary is one row by contract; reading it into a constant avoids a join without keys.
    """
    row = summary.select("metrics_iters").head(1)
    iters = F.array(*[F.lit(i) for i in row[0][0]]) if row else F.lit(None).cast("array<int>")
    joined = info.join(arch.select("model_id", F.col("name").alias("model_name")), "model_id")
    return joined.select("model_id", "model_name", "validation_metrics", iters.alias("metrics_iters"))


__all__ = ["learning_curve", "model_log_table", "phase_breakdown", "rename_after_join"]
