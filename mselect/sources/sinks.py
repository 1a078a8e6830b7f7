"""Writing tables, text parts and training state; table life cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mselect.functions.features import col


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def checked_lengths(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Fail the job on a row whose two array columns differ in length."""
    same = F.size(x) == F.size(y)
    fail = F.raise_error(F.lit("x and y differ in length")).cast(df.schema[x].dataType)
    return df.withColumn(x, F.when(same, F.col(x)).otherwise(fail))


def load_table(df: DataFrame, name: str, append: bool = False, paired: Sequence[str] = ()) -> None:
    """Create a table, or append to one. Creating an existing table and appending to a missing one are errors.

    ``paired`` names two array columns that must have equal lengths in every row.
    """
    spark = df.sparkSession
    if append != spark.catalog.tableExists(name):
        raise ValueError(f"table {name} {'does not exist' if append else 'exists already'}")
    if paired:
        df = checked_lengths(df, *paired)
    df.write.mode("append" if append else "errorifexists").saveAsTable(name)


def load_many(spark: SparkSession, paths: Sequence[str], name: str, force: bool = False) -> bool:
    """Load Parquet files into one new table in a single write; an existing table stays unless ``force``."""
    if spark.catalog.tableExists(name):
        if not force:
            return False
        drop_table(spark, name)
    load_table(spark.read.parquet(*paths), name)
    return True


def format_array_text(x: str | Column, y: str | Column, name: str | Column | None = None) -> Column:
    """``{a,b}|y`` or ``{a,b}|y|name``."""
    parts = [F.concat(F.lit("{"), F.array_join(col(x), ","), F.lit("}")), col(y).cast("string")]
    if name is not None:
        parts.append(col(name))
    return F.concat_ws("|", *parts)


def unload_lines(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, value) with the columns joined by ``|``; arrays in braces, null as one blank."""
    texts = []
    for f in df.schema:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))
        texts.append(F.coalesce(c.cast("string"), F.lit(" ")))
    return df.select(F.col(key), F.concat_ws("|", *texts).alias("value"))


def unload_parts(df: DataFrame, path: str, parts: int, key: str = "id") -> None:
    """Write ``parts`` text files, rows distributed by the hash of ``key``."""
    lines = unload_lines(df, key)
    lines.repartition(parts, key).select("value").write.mode("errorifexists").text(path)


def save_epoch_state(df: DataFrame, path: str, epoch: int) -> None:
    """Write one epoch of a state or job table; an earlier copy of that epoch is replaced, other epochs stay."""
    df.withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch") \
        .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
