"""Packing rows into minibatch buffers by distribution key, and taking buffers apart again."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.functions.features import normalize_array, one_hot
from mselect.operators.sequence import Ordered, with_positions
from mselect.session import kept

def class_table(df: DataFrame, y: str = "y", blocks: int | None = None) -> DataFrame:
    """The dictionary of a class column: (value, code), codes from 0 in the order of the values. Nulls are no class."""
    values = df.select(F.col(y).alias("value")).where("value IS NOT NULL").distinct()
    return kept(Ordered(values, [], ["value"], blocks).position("code").done().withColumn("code", F.col("code").cast("int")), "classes")


def _as_table(df: DataFrame, classes: Sequence | DataFrame, y: str) -> DataFrame:
    if isinstance(classes, DataFrame):
        return classes
    kind = df.schema[y].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(classes)], f"value {kind}, code int")


def pack(df: DataFrame, buffer_size: int, keys: int, classes: Sequence | DataFrame, norm: float = 1.0, id: str = "id", x: str = "x",
         y: str = "y", dist: Column | None = None, blocks: int | None = None, sparse: bool = False) -> DataFrame:
    """Rows (id, x, y) to buffers of at most ``buffer_size`` rows, spread over ``keys`` distribution keys.

    Buffers of a key are full but for the last one. y becomes one row of the identity matrix over ``classes``; an
    unknown class becomes all zeros and is counted in ``unseen``. ``classes`` are values in the order of their codes, or a
    ``class_table``, which is joined and may be of any size. With ``sparse`` a row of y holds the places of its ones alone: one place, or none for an
    unknown class; ``dense_labels`` gives the wide form.
    """
    if dist is None:
        dist = F.pmod(F.xxhash64(id), F.lit(keys))
    codes = _as_table(df, classes, y).select(F.col("value").alias("_value"), F.col("code").alias("_c"))
    width = codes.count()
    rows = df.select(dist.cast("int").alias("dist_key"), F.col(id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = rows.join(codes, F.col("_y") == F.col("_value"), "left").drop("_y", "_value")
    placed = with_positions(rows, ["dist_key"], ["_id"], "_pos", blocks)
    features = F.col("_x") if norm == 1.0 else normalize_array("_x", norm)
    cell = F.struct(F.col("_pos").alias("p"), features.cast("array<float>").alias("x"), F.col("_c").alias("c"))
    # a group is one buffer, so at most buffer_size rows come together
    buffers = placed.groupBy("dist_key", F.floor(F.col("_pos") / buffer_size).cast("int").alias("buffer_id")).agg(
        F.sort_array(F.collect_list(cell)).alias("b"))
    n = F.size("b")

    def label(r: Column) -> Column:
        return F.array_compact(F.array(r["c"])) if sparse else one_hot(r["c"], width)
    return buffers.select(
        "dist_key", "buffer_id",
        F.transform("b", lambda r: r["x"]).alias("independent_var"),
        F.transform("b", label).alias("dependent_var"),
        F.array(n, F.size(F.col("b")[0]["x"])).alias("independent_var_shape"),
        F.array(n, F.lit(width)).alias("dependent_var_shape"),
        F.size(F.filter("b", lambda r: r["c"].isNull())).alias("unseen"),
    )


def dense_labels(packed: DataFrame) -> DataFrame:
    """Sparse labels as rows of the identity matrix."""
    width = F.element_at("dependent_var_shape", 2)
    zero, one = F.lit(0).cast("smallint"), F.lit(1).cast("smallint")
    rows = F.transform("dependent_var", lambda r: F.when(F.size(r) == 0, F.array_repeat(zero, width)).otherwise(F.concat(
        F.array_repeat(zero, F.get(r, F.lit(0))), F.array(one), F.array_repeat(zero, width - 1 - F.get(r, F.lit(0))))))
    return packed.withColumn("dependent_var", rows)


def pack_train(df: DataFrame, buffer_size: int, keys: int, **options) -> tuple[DataFrame, DataFrame]:
    """Packed training table and its summary (class values, normalizing constant, buffer size, key count)."""
    classes = class_table(df, options.get("y", "y"), options.get("blocks"))
    packed = pack(df, buffer_size, keys, classes, **options)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("code", F.col("value").cast("string").alias("v")))), lambda c: c["v"])
    summary = classes.agg(in_order.alias("class_values")).select(
        "class_values", F.lit(float(options.get("norm", 1.0))).alias("normalizing_const"), F.lit(buffer_size).alias("buffer_size"),
        F.lit(keys).alias("num_keys"))
    return packed.drop("unseen"), summary


def pack_valid(df: DataFrame, summary: DataFrame, buffer_size: int, keys: int, **options) -> DataFrame:
    """Packed validation table that encodes labels with the training classes; keeps the ``unseen`` count."""
    kind = df.schema[options.get("y", "y")].dataType
    classes = kept(summary.select(F.posexplode("class_values").alias("code", "v")).select(F.col("v").cast(kind).alias("value"), "code"), "classes")
    return pack(df, buffer_size, keys, classes, norm=summary.select("normalizing_const").first()[0], **options)


def unpack(packed: DataFrame, keep: Sequence[str] = ("dist_key", "buffer_id")) -> DataFrame:
    """Buffers back to rows (offset, x, y); differing counts of x and y fail the job."""
    fail = F.raise_error(F.lit("x and y differ in length")).cast(packed.schema["independent_var"].dataType)
    checked = F.when(F.size("independent_var") == F.size("dependent_var"), F.col("independent_var")).otherwise(fail)
    zipped = F.arrays_zip(checked.alias("x"), F.col("dependent_var").alias("y"))
    return packed.select(*keep, F.posexplode(zipped).alias("offset", "_r")).select(
        *keep, "offset", F.col("_r.x").alias("x"), F.col("_r.y").alias("y"))


def _buffer_starts(packed: DataFrame, key: str, blocks: int | None) -> DataFrame:
    sizes = packed.select(key, "buffer_id", F.element_at("dependent_var_shape", 1).cast("long").alias("_n"))
    return Ordered(sizes, [key], ["buffer_id"], blocks).running({"_end": ("sum", "_n")}).done().withColumn(
        "_start", F.col("_end") - F.col("_n"))


def flat_index(packed: DataFrame, length: int | None = None, key: str = "dist_key",
               blocks: int | None = None) -> DataFrame:
    """Position of every example of a key: (key, i, buffer_id, offset).

    With ``length`` (training) positions run to that number, wrapping around the true length; a true length above it
    is cut, as an index that long is all a reader asks for. Only buffer shapes are read.
    """
    starts = _buffer_starts(packed, key, blocks)
    offsets = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    rows = starts.where("_n > 0").select(key, "buffer_id", "_start", F.explode(offsets).alias("offset"))
    rows = rows.withColumn("_at", F.col("_start") + F.col("offset"))
    if length is None:
        return rows.select(key, F.col("_at").alias("i"), "buffer_id", F.col("offset").cast("int").alias("offset"))
    totals = starts.groupBy(key).agg(F.sum("_n").alias("_total"))
    # every example repeats at i, i + total, i + 2 total, ... below the length
    wrapped = rows.join(totals, key).where(F.col("_at") < length)
    places = F.sequence(F.col("_at"), F.lit(length - 1).cast("long"), F.col("_total"))
    return wrapped.select(key, F.explode(places).alias("i"), "buffer_id", F.col("offset").cast("int").alias("offset"))


def locate(asked: DataFrame, packed: DataFrame, wrap: bool = False, i: str = "i", key: str = "dist_key",
           blocks: int | None = None) -> DataFrame:
    """``asked`` with the (buffer_id, offset) of each asked position of a key, repeats kept; columns of these names are replaced.

    The table is not turned into one row an example: buffers are intervals of positions, laid over bins as wide as the key's
    mean buffer, so that they enter fewer than three bins each on average, and a position meets the intervals of its bin alone. With
    ``wrap`` a position counts on past the end of its key and before its start. Other positions outside the key, those of
    an unknown or empty key, and nulls get nulls. Only buffer shapes are read.
    """
    starts = _buffer_starts(packed, key, blocks).where("_n > 0").select(F.col(key).alias("_k"), "buffer_id", "_start", "_end")
    totals = starts.groupBy("_k").agg(F.max("_end").alias("_total"), F.count(F.lit(1)).alias("_buffers")).select(
        "_k", "_total", F.ceil(F.col("_total") / F.col("_buffers")).alias("_wide"))
    bins = F.sequence(F.expr("_start div _wide"), F.expr("(_end - 1) div _wide"))
    spans = starts.join(totals, "_k").select(F.col("_k").alias("_sk"), "buffer_id", "_start", "_end", F.explode(bins).alias("_sbin"))
    known = asked.drop("buffer_id", "offset").join(totals, F.col(key) == F.col("_k"), "left")
    place = F.col(i).cast("long")
    known = known.withColumn("_at", F.pmod(place, "_total") if wrap else place).withColumn("_bin", F.expr("_at div _wide"))
    inside = (F.col("_k") == F.col("_sk")) & (F.col("_bin") == F.col("_sbin")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))
    found = known.join(spans, inside, "left").withColumn("offset", (F.col("_at") - F.col("_start")).cast("int"))
    return found.drop("_k", "_total", "_wide", "_at", "_bin", "_sk", "_sbin", "_start", "_end")


def to_bytes(values: str | Column, dtype: str = "float32") -> Column:
    """Nested numbers as raw little-endian bytes, whole Arrow batches at a time."""
    code = np.dtype(dtype).newbyteorder("<")

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(
            np.stack(v) if len(v) and isinstance(v[0], np.ndarray) else v, dtype=code).tobytes())

    return encode(values)


def from_bytes(raw: str | Column, shape: str | Column, dtype: str = "float32") -> Column:
    """Bytes back to rows of numbers by their (rows, width) shape; a wrong length fails the job."""
    code = np.dtype(dtype).newbyteorder("<")
    kind = "array<array<float>>" if dtype == "float32" else "array<array<smallint>>"

    @F.pandas_udf(kind)
    def decode(column: pd.Series, shapes: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else list(np.frombuffer(b, dtype=code).reshape(tuple(s)))
                          for b, s in zip(column, shapes)])

    return decode(raw, shape)


def buffer_shapes(packed: DataFrame) -> DataFrame:
    """Key, buffer and both shapes, without touching the data columns."""
    return packed.select("dist_key", "buffer_id", "independent_var_shape", "dependent_var_shape")


CHUNK_SIZE = 8140  # fixed value: units in a full chunk of a stored value


def reassemble_chunks(chunks: DataFrame, pointers: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Whole values of the pointed-to ids from numbered text chunks: (id, data, chunks, ok).

    ``pointers`` has (id, total). ``ok`` is false when the chunk count is not (total - 1) // size + 1, a chunk before
    the last is not full, or the total length differs. Repeated copies of a chunk are dropped before grouping, so a
    group never exceeds the value it makes.
    """
    wanted = chunks.join(pointers.select("id"), "id", "left_semi")
    once = wanted.groupBy("id", "seq").agg(F.min("data").alias("data"))
    parts = once.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("_p"),
        F.count(F.lit(1)).alias("chunks"), F.max("seq").alias("_last"),
        F.sum(F.length("data")).alias("_length"))
    full = F.forall(F.filter("_p", lambda p: p["seq"] < F.col("_last")), lambda p: F.length(p["data"]) == chunk_size)
    checked = parts.join(pointers, "id")
    due = F.floor((F.col("total") - 1) / chunk_size) + 1
    return checked.select(
        "id", F.array_join(F.transform("_p", lambda p: p["data"]), "").alias("data"), "chunks",
        (full & (F.col("chunks") == due) & (F.col("_length") == F.col("total"))).alias("ok"))


def placement(matrix: DataFrame, worker: str = "worker", available: str = "available") -> DataFrame:
    """Rows (worker, partition) of a 0/1 availability array per worker."""
    return matrix.select(worker, F.posexplode(available).alias("partition", "_on")).where("_on = 1").drop("_on")


def worker_layout(df: DataFrame, workers: int, partitions: int = 8) -> DataFrame:
    """Add ``available`` to a worker table: partitions dealt out evenly in runs, as for 8, 4, 2 or 1 workers."""
    run = partitions // workers
    owner = F.transform(F.sequence(F.lit(0), F.lit(partitions - 1)),
                        lambda p: (F.floor(p / run) == F.col("worker")).cast("int"))
    return df.withColumn("available", owner)


PHASES = ["initialization", "exiting", "data_transmission", "idle", "train_valid", "model_hopping", "merge"]


def pivot_phases(phases: DataFrame, keys: Sequence[str], fold: bool = True) -> DataFrame:
    """One column per phase (missing is 0); ``fold`` adds initialization and exiting to train_valid.

    The phase names are fixed, so the pivot needs no pass to find them.
    """
    wide = phases.groupBy(*keys).pivot("phase", PHASES).agg(F.sum("seconds")).fillna(0.0, subset=PHASES)
    if fold:
        wide = wide.withColumn("train_valid", F.col("train_valid") + F.col("initialization") + F.col("exiting")) \
            .drop("initialization", "exiting")
    return wide


def jobs_from_models(models: DataFrame, jobs: str = "jobs") -> DataFrame:
    """Job rows carrying the model key, from a map of model to list of job structs."""
    return models.select(F.explode(jobs).alias("model_key", "_jobs")).select("model_key", F.inline("_jobs"))


def redistribute(packed: DataFrame, keys: int) -> DataFrame:
    """Deal the buffers anew over ``keys`` distribution keys, evenly whatever the old keys held."""
    new = F.pmod(F.xxhash64("dist_key", "buffer_id"), F.lit(keys)).cast("int")
    renumbered = packed.withColumn("_new", new).withColumn("_old", F.struct("dist_key", "buffer_id"))
    light = Ordered(renumbered.select("_new", "_old"), ["_new"], ["_old"]).position("_b").done()
    moved = renumbered.join(light, ["_new", "_old"])
    return moved.withColumn("dist_key", F.col("_new")).withColumn("buffer_id", F.col("_b").cast("int")) \
        .drop("_new", "_old", "_b")
