"""Registration of checked queries, and tables derived from the given ones in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same rows if there is one."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Expressions that read the same in Spark and in the checking SQL.
JOB_COLUMNS = [
    "CAST(user_id % 8 AS INT) AS model_key", "CAST(event_id % 8 AS INT) AS dist_key",
    "CAST(1 + event_id % 5 AS INT) AS epoch", "value / 503 AS metric_valid", "1 - value / 503 AS loss_valid",
    "value / 607 AS metric_train", "1 - value / 607 AS loss_train", "ts AS start_time", "event_id",
]
JOBS_SQL = f"jobs AS (SELECT {', '.join(JOB_COLUMNS)} FROM events)"


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job records: a row per (epoch, model, key) visit."""
    return table(spark, folder, "events").selectExpr(*JOB_COLUMNS)


def stamp(c: str = "ts"):
    """A timestamp to the second as text, whatever the session's zone."""
    return F.left(F.col(c).cast("string"), F.lit(19))


STAMP_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

# Click rows from lineitem: 13 whole numbers and 26 texts, among them zeros, negatives and nulls.
CLICK_NUMERIC = [
    "CAST(l_quantity AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)", "l_partkey", "l_suppkey", "l_orderkey",
    "CAST(l_linenumber AS BIGINT)", "l_suppkey - 50", "l_partkey % 3", "l_orderkey % 11", "l_orderkey * 1000",
    "l_partkey * l_suppkey", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey % 100 END", "l_suppkey % 2",
]
CLICK_CATEGORICAL = ["l_returnflag", "l_linestatus"] + [f"CAST(l_partkey % {k} AS STRING)" for k in range(2, 14)] + [
    f"CAST(l_orderkey % {k} AS STRING)" for k in range(20, 31)] + [
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('k', l_suppkey) END"]
CLICK_LABEL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Click rows (l_orderkey, l_linenumber, y, n0..n12, c0..c25)."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{CLICK_LABEL} AS y",
        *[f"{e} AS n{i}" for i, e in enumerate(CLICK_NUMERIC)], *[f"{e} AS c{i}" for i, e in enumerate(CLICK_CATEGORICAL)])


CLICKS_SQL = "clicks AS (SELECT l_orderkey, l_linenumber, {y} AS y, {n}, {c} FROM lineitem)".format(
    y=CLICK_LABEL, n=", ".join(f"{e} AS n{i}" for i, e in enumerate(CLICK_NUMERIC)),
    c=", ".join(f"{e} AS c{i}" for i, e in enumerate(CLICK_CATEGORICAL)))


def bucket_sql(e: str) -> str:
    """The bucket rule by counting boundaries."""
    bounds = f"list_transform(range(50), lambda j: pow(1.5, j) - 0.51)"
    return (f"CASE WHEN {e} IS NULL OR {e} = 0 THEN NULL "
            f"ELSE least(len(list_filter({bounds}, lambda b: b <= {e})), 49) END")


def hash_sql(e: str, buckets: int = 256) -> str:
    return (f"CASE WHEN {e} IS NULL OR {e} IN ('', '0') THEN NULL "
            f"ELSE CAST('0x' || substr(md5({e}), 1, 8) AS BIGINT) % {buckets} END")
