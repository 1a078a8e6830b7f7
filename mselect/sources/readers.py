"""Readers for labelled tables, click logs, array text, images, run logs, monitor logs and metric files."""

from __future__ import annotations

import re

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mselect.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, col

# A click line is a label, 13 whole numbers and 26 texts, tab-separated, without header.
CLICK_SCHEMA = T.StructType(
    [T.StructField("_c0", T.IntegerType())]
    + [T.StructField(f"_c{i}", T.LongType()) for i in range(1, NUMERIC_FEATURES + 1)]
    + [T.StructField(f"_c{i}", T.StringType())
       for i in range(NUMERIC_FEATURES + 1, NUMERIC_FEATURES + CATEGORICAL_FEATURES + 1)]
)

def labeled(df: DataFrame, validation: bool) -> DataFrame:
    """Cast features and labels to float arrays and add the split flag."""
    return df.select(F.col("features").cast("array<float>").alias("features"),
                     F.col("labels").cast("array<float>").alias("labels"),
                     F.lit(int(validation)).alias("validation"))


def read_labeled(spark: SparkSession, paths: str | Sequence[str], validation: bool) -> DataFrame:
    """Parquet files of one split."""
    return labeled(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), validation)


def read_dataset(spark: SparkSession, valid_paths: Sequence[str], train_paths: Sequence[str]) -> DataFrame:
    """All validation files (flag 1), then all training files (flag 0)."""
    return read_labeled(spark, valid_paths, True).unionByName(read_labeled(spark, train_paths, False))


def zero_nulls(df: DataFrame) -> DataFrame:
    """Missing numbers become 0 and missing texts ``0``, which later count as absent features."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.fillna(0).fillna("0", subset=texts)


def read_click_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Click log files."""
    return zero_nulls(spark.read.csv(path, sep="\t", schema=CLICK_SCHEMA, header=False))


def parse_click_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Click log lines already held in a column."""
    row = F.from_csv(F.col(column), CLICK_SCHEMA.simpleString()[7:-1].replace(":", " "), {"sep": "\t"})
    return zero_nulls(lines.select(*keep, row.alias("r")).select(*keep, "r.*"))


def parse_array_text(line: str | Column, label: str = "scalar") -> Column:
    """Struct (id, x, y) of ``id|{1.0,2.0}|label``; inner braces are flattened away.

    ``label="list"`` reads the label as single digits.
    """
    parts = F.split(col(line), r"\|")
    x = F.from_json(F.concat(F.lit("["), F.translate(parts[1], "{} ", ""), F.lit("]")), "array<float>")
    y = F.trim(parts[2])
    y = F.transform(F.split(y, ""), lambda d: d.cast("int")) if label == "list" else y.cast("int")
    return F.struct(parts[0].cast("bigint").alias("id"), x.alias("x"), y.alias("y"))


def read_array_text(spark: SparkSession, path: str, label: str = "scalar") -> DataFrame:
    """Files written by ``unload_parts``."""
    return spark.read.text(path).select(parse_array_text("value", label).alias("r")).select("r.*")


def first_labels(names: DataFrame, label: str, count: int) -> DataFrame:
    """The rows of the ``count`` first labels in sorted order."""
    chosen = names.select(label).distinct().orderBy(label).limit(count)
    return names.join(F.broadcast(chosen), label, "left_semi")


def check_one_shape(images: DataFrame, label: str, shape: Sequence[str]) -> DataFrame:
    """Fail when two images of a label differ in shape, otherwise pass the table on.

    The check is one aggregate of a row per label; the job stops at the first offending label.
    """
    s = F.struct(*shape)
    mixed = images.groupBy(label).agg(F.min(s).alias("lo"), F.max(s).alias("hi")).where("lo <> hi").select(label).head(1)
    if mixed:
        raise ValueError(f"images of label {mixed[0][0]!r} differ in shape")
    return images


def read_image_dirs(spark: SparkSession, root: str, num_labels: int | None = None) -> DataFrame:
    """Images under ``root/<label>/``: (label, name, height, width, channels, x). A file that is no image fails the job."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    origin = F.col("image.origin")
    folder = "/" + re.sub(r"^\w+:/*|^/+", "", root).rstrip("/")
    tail = F.substring_index(origin, "/", -2)  # label/name
    unreadable = F.raise_error(F.concat(F.lit("not an image: "), origin))
    images = raw.select(
        F.substring_index(tail, "/", 1).alias("label"), F.substring_index(tail, "/", -1).alias("img_name"),
        F.when(F.col("image.height") < 0, unreadable.cast("int")).otherwise(F.col("image.height")).alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("x"),
    ).where(F.left(origin, F.length(origin) - F.length(tail) - 1).endswith(folder))
    if num_labels is not None:
        images = first_labels(images, "label", num_labels)
    return check_one_shape(images, "label", ["height", "width", "channels"])


def read_matrix_last_label(df: DataFrame, array: str = "row", keep: Sequence[str] = ()) -> DataFrame:
    """Split a flat array into its features and, from the last place, a whole-number label."""
    a = F.col(array)
    return df.select(*keep, F.slice(a, F.lit(1), F.size(a) - 1).cast("array<float>").alias("x"),
                     F.element_at(a, -1).cast("int").alias("y"))


def number_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Number files from 0 in path order. A file list has one row per partition, so one sort of it is enough."""
    from mselect.operators.sequence import Ordered

    return Ordered(files.select(path).distinct(), [], [path]).position("partition").done()


def list_partitions(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """Files under ``root`` with an extension as (path, partition)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext.lstrip('.')}") \
        .option("recursiveFileLookup", "true").load(root)
    return number_paths(files.select("path"))


def read_run_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Log lines as (file, pos, value) without trailing blanks.

    ``pos`` orders the lines of a file: the start of the block a line was read in, then the reading order inside it.
    It holds for files that are split over many tasks.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("pos"),
        F.rtrim("value").alias("value"),
    )


def worker_of(file: str | Column) -> Column:
    """Worker name: the file name after its last ``_`` and before the dot."""
    name = F.substring_index(col(file), "/", -1)
    return F.substring_index(F.substring_index(name, "_", -1), ".", 1)


def read_monitor_logs(spark: SparkSession, root: str) -> DataFrame:
    """All monitor logs of a folder as (worker, file, pos, value)."""
    return read_run_log(spark, root).select(worker_of("file").alias("worker"), "file", "pos", "value")


_CACHE_KEY = "mselect.cache.key"


def read_cached(spark: SparkSession, name: str, build: Callable[[], DataFrame], force: bool = False,
                key: str | None = None) -> DataFrame:
    """The saved table of that name; built and saved first when missing or forced, or when it was saved under another ``key``.

    ``runs.fingerprint`` makes a key of the inputs. The key is noted after the rows are written, so a build that was stopped is
    done again.
    """
    there = spark.catalog.tableExists(name)
    if there and key is not None:
        noted = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        there = noted.get(_CACHE_KEY) == key
    if force or not there:
        build().write.mode("overwrite").saveAsTable(name)
        if key is not None:
            spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_CACHE_KEY}' = '{key}')")
    return spark.read.table(name)


_METRICS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))


def rank_metrics(lines: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Rows (epoch, mode, loss, acc_top1, acc_top5, rank, model_index) of ``{epoch: {mode: {metric: v}}}`` texts."""
    name = F.substring_index(F.col(file), "/", -1)
    parsed = lines.select(
        F.regexp_extract(name, r"rank(\d+)_", 1).cast("int").alias("rank"),
        F.regexp_extract(name, r"index(\d+)", 1).cast("int").alias("model_index"),
        F.from_json(value, T.MapType(T.StringType(), _METRICS)).alias("m"),
    )
    by_epoch = parsed.select("rank", "model_index", F.explode("m").alias("epoch", "m"))
    by_mode = by_epoch.select("rank", "model_index", F.col("epoch").cast("int").alias("epoch"),
                              F.explode("m").alias("mode", "m"))
    pick = {n: F.try_element_at(F.col("m"), F.concat(F.col("mode"), F.lit(f"_{n}"))).alias(n)
            for n in ("loss", "acc_top1", "acc_top5")}
    return by_mode.select("epoch", "mode", *pick.values(), "rank", "model_index")


def read_rank_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-process metric files named ``...rank<r>_index<i>``, one JSON object per line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rank_metrics(lines)
