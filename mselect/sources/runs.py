"""Runs that go on where they were stopped: steps as written tables, each counted once its manifest is in place."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _whole(df: DataFrame, *columns) -> list:
    """Count and digests of rows, the same in any order; two independent sums, so that repeated rows count."""
    number = [F.xxhash64(F.lit(salt), *columns).cast("decimal(20,0)") for salt in (0, 1)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("string").alias(f"d{i}") for i, c in enumerate(number)]).first()
    return [r.n, r.d0, r.d1]


def fingerprint(*inputs: DataFrame, **parameters) -> str:
    """A key that changes with the inputs and the parameters (anything JSON can hold; others by their ``repr``).

    A table read straight from files counts by the path, size and time of the files its rows come from and its rows in each, which
    reads no further column; name a filter or a computed column among the parameters too.
    Any other table counts by its rows, in any order; then its columns must be hashable (no maps), and it is computed once for this.
    """
    seen: list = [json.dumps(parameters, sort_keys=True, default=repr)]
    for df in inputs:
        seen.append(df.schema.json())
        try:
            files = df.select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")])
        except AnalysisException:
            seen.append(_whole(df, *[F.col(f"`{c}`") for c in df.columns]) if df.columns else df.count())
        else:
            # with the rows taken of each file, as a filter may stand between
            seen.append(_whole(files.groupBy(*files.columns).count(), *files.columns, "count"))
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


class Steps:
    """The finished steps of one run, below ``path`` in a folder all executors can reach.

    A step's rows are written under a new name first; then its manifest is written aside and renamed into place, so a step is there whole or
    not at all, whenever the driver stops. Manifests carry ``key``: steps of another key are not seen, and stay. If two drivers
    finish a step at once, both go on with the same one of the two where the file system refuses to rename over a file (HDFS).
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark._jvm
        self._as_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._as_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> str:
        return f"{self.path}/{name}-{hashlib.sha256(self.key.encode()).hexdigest()[:16]}.json"

    def done(self, name: str) -> DataFrame | None:
        """The rows of a finished step, or None."""
        file = self._manifest(name)
        if not self._fs.exists(self._as_path(file)):
            return None
        held = json.loads(self.spark.read.text(file, wholetext=True).first().value)
        if held["key"] != self.key:
            return None
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.path}/{held['rows']}")

    def commit(self, name: str, df: DataFrame) -> DataFrame:
        """Write a step and make it count; the rows as they are read back."""
        rows = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{rows}")
        aside = self._as_path(f"{self.path}/.{rows}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"key": self.key, "rows": rows, "schema": json.loads(df.schema.json())}).encode()))
        out.close()
        if not self._fs.rename(aside, self._as_path(self._manifest(name))) and self.done(name) is None:
            raise OSError(f"could not put the manifest of step {name!r} in place below {self.path}")
        return self.done(name)

    def run(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step's rows: read if it is finished, else built and committed."""
        found = self.done(name)
        return self.commit(name, build()) if found is None else found
