"""Filters, projections, joins and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_partition(df: DataFrame, key: int, column: str = "dist_key") -> DataFrame:
    """Rows of one distribution key; prunes files when the table is partitioned by it."""
    return df.where(F.col(column) == key)


def time_slice(df: DataFrame, start: str | Column, end: str | Column, time: str = "t") -> DataFrame:
    """Rows with ``start <= t < end``."""
    kind = df.schema[time].dataType
    lo = F.lit(start).cast(kind) if isinstance(start, str) else start
    hi = F.lit(end).cast(kind) if isinstance(end, str) else end
    return df.where((F.col(time) >= lo) & (F.col(time) < hi))


def shift_start(intervals: DataFrame, seconds: int | None = None, log: DataFrame | None = None,
                marker: str | None = None, start: str = "start_time") -> DataFrame:
    """Move the interval start by seconds, or to the first log line (columns t, value) that holds a marker."""
    if marker is None:
        return intervals.withColumn(start, F.timestamp_add("SECOND", F.lit(seconds), F.col(start)))
    first = log.where(F.col("value").contains(marker)).agg(F.min("t").cast("string")).first()[0]
    if first is None:
        raise ValueError(f"no line holds {marker!r}")
    return intervals.withColumn(start, F.lit(first).cast(intervals.schema[start].dataType))


def name_like(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Rows whose name holds the text."""
    return df.where(F.col(column).contains(text))


def lookup_model(models: DataFrame, value: str | int, column: str = "name") -> DataFrame:
    """Rows of a model by name or id; finding none is an error."""
    found = models.where(F.col(column) == value)
    if not found.head(1):
        raise LookupError(f"no model with {column} {value!r}")
    return found


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename_after_join(df: DataFrame, names: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename all columns in place order, then leave out the listed ones; a wrong number of names is an error."""
    return df.toDF(*names).drop(*drop)


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts to doubles: malformed text fails the job, missing stays null."""
    def number(c: str) -> Column:
        parsed = F.col(c).cast("string").try_cast("double")
        fail = F.raise_error(F.concat(F.lit(f"{c} is not a number: "), F.col(c).cast("string"))).cast("double")
        return F.when(F.col(c).isNull() | parsed.isNotNull(), parsed).otherwise(fail)
    return df.withColumns({c: number(c) for c in columns})


def info_with_arch(info: DataFrame, arch: DataFrame, key: str = "model_id") -> DataFrame:
    """Run information joined with its architecture."""
    return info.join(arch, key)


def left_composite(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join on several keys."""
    return a.join(b, list(keys), "left")


def hosts_with_device(segments: DataFrame, devices: DataFrame, host: str = "hostname") -> DataFrame:
    """Hosts of primary, non-master segments that have a device, each once.

    Both sides are reduced to one row per host before they meet, so many segments or devices on a host cost nothing.
    """
    primary = segments.where((F.col("role") == "p") & (F.col("content") != -1)).select(host).distinct()
    return primary.join(devices.select(host), host, "left_semi")


def relabel(files: DataFrame, truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """File to label text: file -> class index (``truth``), index -> text (``mapping`` by 0-based ``line``).

    A file without truth or an index without a line fails the job.
    """
    found = files.join(truth, "file", "left").join(
        mapping, F.col("class_index") == F.col("line"), "left").drop("line")
    fail = F.raise_error(F.concat(F.lit("no label for "), F.col("file").cast("string"))).cast("string")
    return found.withColumn("label_text", F.coalesce("label_text", fail))


def semi_members(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(keys, on, "left_semi")


def map_events(events: DataFrame, semantics: DataFrame, strict: bool = True) -> DataFrame:
    """Add the phase of every event from a table (event, phase); an unknown event fails the job when strict."""
    joined = events.join(semantics, "event", "left")
    if not strict:
        return joined
    fail = F.raise_error(F.concat(F.lit("unknown event "), F.col("event"))).cast("string")
    return joined.withColumn("phase", F.coalesce("phase", fail))


def unknown_events(events: DataFrame, semantics: DataFrame) -> DataFrame:
    """The distinct events the table does not know."""
    return events.select("event").distinct().join(semantics, "event", "left_anti")


def with_shapes(blobs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes of stored buffers by (table, buffer)."""
    return blobs.join(shapes, ["table_name", "buffer_id"])


def pair_runs(runs: DataFrame, over: str, under: str, on: str = "size", method: str = "method",
              time: str = "seconds") -> DataFrame:
    """Ratio of two methods' times at equal size: one aggregate instead of a self-join."""
    def only(m: str) -> Column:
        return F.max(F.when(F.col(method) == m, F.col(time)))
    both = runs.where(F.col(method).isin(over, under)).groupBy(on).agg(
        only(over).alias("over_time"), only(under).alias("under_time"))
    return both.where("over_time IS NOT NULL AND under_time IS NOT NULL").withColumn(
        "speedup", F.col("over_time") / F.col("under_time"))


def model_partition_pairs(models: DataFrame, keys: int | Sequence[int], name: str = "dist_key") -> DataFrame:
    """One row per model and distribution key: the work of an epoch. The key list is a fixed, short list."""
    listed = range(keys) if isinstance(keys, int) else keys
    return models.withColumn(name, F.explode(F.array(*map(F.lit, listed)) if not isinstance(keys, int)
                                             else F.sequence(F.lit(0), F.lit(keys - 1))))


def by_host_counts(segments: DataFrame, devices: DataFrame, host: str = "hostname") -> DataFrame:
    """Primary segments with their host's device count (0 when none) and a flag for too few devices."""
    primary = segments.where((F.col("content") != -1) & (F.col("role") == "p"))
    per_host = devices.groupBy(host).agg(F.count(F.lit(1)).alias("devices"))
    on_host = primary.groupBy(host).agg(F.count(F.lit(1)).alias("segments"))
    # both sides of the wide join are one row per host
    counts = on_host.join(per_host, host, "left").select(
        host, "segments", F.coalesce("devices", F.lit(0)).alias("devices"))
    out = primary.select(host, F.col("content").alias("segment_id")).join(counts, host)
    return out.withColumn("shared", (F.col("devices") > 0) & (F.col("devices") < F.col("segments")))


def union_splits(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Append two tables, duplicates kept."""
    return valid.unionByName(train)


def concat_shapes(valid: DataFrame, train: DataFrame, valid_name: str = "valid", train_name: str = "train") -> DataFrame:
    """Append shape tables under a table-name column."""
    return valid.withColumn("table_name", F.lit(valid_name)).unionByName(train.withColumn("table_name", F.lit(train_name)))


def append_frames(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Append tables that may miss columns of each other, with the name of the source in ``tag``."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stitch_history(sequential: DataFrame, averaged: DataFrame, epochs: int) -> DataFrame:
    """For every switch point k: the sequential curve before epoch k, the averaged curve of start k from k on.

    ``sequential`` has (epoch, metric), ``averaged`` (switch, epoch, metric).
    """
    early = sequential.withColumn("switch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) \
        .where(F.col("epoch") < F.col("switch"))
    late = averaged.where((F.col("epoch") >= F.col("switch")) & (F.col("epoch") < epochs))
    used = late.select("switch").distinct()
    return early.join(F.broadcast(used), "switch", "left_semi").select("switch", "epoch", "metric").unionByName(
        late.select("switch", "epoch", "metric"))
