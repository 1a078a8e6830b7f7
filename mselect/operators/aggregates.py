"""Grouped summaries of packed tables, jobs, metrics and monitor values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.operators.merging import CHUNK, merged_chunks


def rows_per_key(packed: DataFrame, key: str = "dist_key") -> DataFrame:
    """Examples per distribution key, from the buffer shapes alone."""
    return packed.groupBy(key).agg(F.sum(F.element_at("dependent_var_shape", 1)).alias("rows"))


def mean_by(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Unweighted means by the keys."""
    return rows.groupBy(*keys).agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def mean_by_epoch_model(jobs: DataFrame) -> DataFrame:
    """Mean losses and metrics of a model in an epoch over its partitions."""
    return mean_by(jobs, ["epoch", "model_key"], ["loss_train", "metric_train", "loss_valid", "metric_valid"])


def mean_by_epoch_mode(rows: DataFrame, keys: Sequence[str] = ("epoch", "mst_key", "mode", "config"),
                       values: Sequence[str] = ("train_loss", "valid_loss", "error", "error_1")) -> DataFrame:
    """Means of a model log by epoch, model and mode."""
    return mean_by(rows, list(keys), list(values))


def ordered_values(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Values per key as an array in ``order``. Meant for one value per (key, epoch): the array has epoch length."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda p: p["v"]).alias(name))


def model_summary(jobs: DataFrame, key: str = "model_key", value: str = "metric_valid") -> DataFrame:
    """Per model the mean validation metric of every epoch, in epoch order."""
    means = mean_by(jobs, [key, "epoch"], [value])
    return ordered_values(means, [key], "epoch", value, "metrics")


def phase_totals(events: DataFrame, semantics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds per phase: summed by event first, so only one row per distinct event meets the phase table."""
    from mselect.operators.relational import map_events

    by_event = events.groupBy(*keys, "event").agg(F.sum("seconds").alias("seconds"))
    return map_events(by_event, semantics).groupBy(*keys, "phase").agg(F.sum("seconds").alias("seconds"))


def device_io(disk: DataFrame) -> DataFrame:
    """Growth of the cumulative counters per worker and device; the master is left out."""
    grown = disk.where(F.col("worker") != "master").groupBy("worker", "device").agg(
        (F.max("MB_read") - F.min("MB_read")).alias("MB_i"), (F.max("MB_wrtn") - F.min("MB_wrtn")).alias("MB_o"))
    return grown.withColumn("MB_io", F.col("MB_i") + F.col("MB_o"))


def worker_io(devices: DataFrame, separate: bool = False) -> DataFrame:
    """Mean over workers and total of the per-worker sums: MB together, or GB for reads and writes apart."""
    names = ["MB_i", "MB_o"] if separate else ["MB_io"]
    per_worker = devices.groupBy("worker").agg(*[F.sum(n).alias(n) for n in names])
    unit = 1024 if separate else 1
    stats = []
    for n in names:
        label = n.replace("MB", "GB") if separate else n
        stats += [(F.avg(n) / unit).alias(f"mean_{label}"), (F.sum(n) / unit).alias(f"sum_{label}")]
    return per_worker.agg(*stats)


def network_stats(net: DataFrame) -> DataFrame:
    """Mean and maximum of receive, send and their sum by interface, master and workers apart."""
    both = net.withColumn("rxtx", F.col("rx") + F.col("tx"))
    side = F.when(F.col("worker") == "master", "master").otherwise("worker").alias("side")
    return both.groupBy(side, "iface").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("rx", "tx", "rxtx") for n, f in (("mean", F.avg), ("max", F.max))])


def network_total(net: DataFrame, seconds: float | Column, iface: str = "EXP") -> DataFrame:
    """GB received on one interface over the run: (master mean + worker mean x workers) x seconds."""
    is_master = F.col("worker") == "master"
    means = net.where(F.col("iface") == iface).agg(
        F.avg(F.when(is_master, F.col("rx"))).alias("m"), F.avg(F.when(~is_master, F.col("rx"))).alias("w"),
        F.countDistinct(F.when(~is_master, F.col("worker"))).alias("n"))
    t = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return means.select(((F.col("m") + F.col("w") * F.col("n")) * t / 1024 / 1024).alias("total_gb"))


def mean_of_means(util: DataFrame, worker: str = "worker", value: str = "utilization") -> DataFrame:
    """Mean per worker, then the unweighted mean of those; only sources that name a worker count."""
    named = util.where(F.col(worker).contains("worker"))
    return named.groupBy(worker).agg(F.avg(value).alias("m")).agg(F.avg("m").alias(value))


def metrics_as_list(rows: DataFrame, key: str = "model", order: str = "epoch", value: str = "metric",
                    name: str = "validation_metrics") -> DataFrame:
    """Metric values of a model in epoch order."""
    return ordered_values(rows, [key], order, value, name)


def batch_end_times(rows: DataFrame, concurrency: int | None = None, time: str = "t", model: str = "model",
                    batch: str = "iteration") -> DataFrame:
    """Latest time per (batch of models, epoch); without ``concurrency`` the batch is given by a column."""
    group = F.col(batch) if concurrency is None else F.floor(F.col(model) / concurrency)
    return rows.groupBy(group.alias("batch"), "epoch").agg(F.max(time).alias("end_time"))


def count_by_host(segments: DataFrame, host: str = "hostname") -> DataFrame:
    """Primary segments per host."""
    primary = segments.where((F.col("role") == "p") & (F.col("content") != -1))
    return primary.groupBy(host).agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("segments"))


def segment_count(segments: DataFrame) -> DataFrame:
    """Primary segments in all, at least 1."""
    primary = segments.where((F.col("role") == "p") & (F.col("content") != -1))
    return primary.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("segments"))


def top_classes(scores: str | Column, k: int) -> Column:
    """The ``k`` best-scoring classes, best first; equal scores in class order."""
    c = F.col(scores) if isinstance(scores, str) else scores
    ranked = F.array_sort(F.transform(c, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda p: p["i"])


def topk_hit(scores: str | Column, label: str | Column, k: int) -> Column:
    """1.0 when the label is among the ``k`` best, else 0.0.

    Counts the classes that beat the label instead of sorting them.
    """
    c = F.col(scores) if isinstance(scores, str) else scores
    y = F.col(label) if isinstance(label, str) else label
    own = F.get(c, y.cast("int"))
    better = F.filter(c, lambda s, i: (s > own) | ((s == own) & (i < y)))
    return F.when(own.isNull(), F.lit(0.0)).otherwise((F.size(better) < k).cast("double"))


def topk_hits(preds: DataFrame, k: int, scores: str = "scores", label: str = "label") -> DataFrame:
    """Fraction of rows whose label is among the ``k`` best scores."""
    return preds.agg(F.avg(topk_hit(scores, label, k)).alias("accuracy"))


def batch_then_mean(preds: DataFrame, value: str, batch: str = "batch", partition: str | None = None,
                    reset_per_partition: bool = False) -> DataFrame:
    """Mean per minibatch, then the unweighted mean of the batches.

    With ``reset_per_partition`` only the batches of the last partition count, as when the running values start anew
    at each partition.
    """
    keys = [batch] if partition is None else [partition, batch]
    means = preds.groupBy(*keys).agg(F.avg(value).alias("_m"))
    if not reset_per_partition:
        return means.agg(F.avg("_m").alias(value))
    per_part = means.groupBy(partition).agg(F.avg("_m").alias("_m"))
    return per_part.agg(F.max_by("_m", partition).alias(value))


def weighted_merge(states: DataFrame, keys: Sequence[str] = (), n: str = "n", w: str = "w") -> DataFrame:
    """Merge model states element by element, weighted by example count: (keys, pos, w, n)."""
    parts = merged_chunks(states, keys, n, w)
    places = parts.select(*keys, "chunk", F.posexplode(F.arrays_zip("s", "m")).alias("_i", "_v"))
    return places.select(*keys, (F.col("chunk") * CHUNK + F.col("_i")).alias("pos"),
                         (F.col("_v.s") / F.nullif(F.col("_v.m"), F.lit(0.0))).alias("w"), F.col("_v.m").alias("n"))


def as_vector(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merged elements back to one float array per key."""
    return merged.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda p: p["w"].cast("float")).alias("w"),
        F.max("n").alias("n"))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1-based numbers over the whole table."""
    from mselect.operators.sequence import Ordered

    return Ordered(df, [], order).position(name).done().withColumn(name, F.col(name) + 1)
