"""Log files as lines with their exact places: a data source that plans byte ranges, for tables and for streams.

A range gives the lines that begin in it. It looks at the byte before its start to tell whether a line begins there, drops the rest of a
line that began before, and reads on past its end to finish its last line. So every line comes once and (file, offset) is
its place in the file, whatever the ranges were.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, value string"
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
PAST_BYTES = 4096
BATCH_BYTES = 4 << 20
TASK_BYTES = 4 << 20  # a task takes so many bytes of ranges that follow each other, or one range


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class ByteRange(InputPartition):
    """Bytes ``begin`` to ``end`` (not included) of a file, read in ranges of ``size`` bytes; 0: as one."""

    file: str
    begin: int
    end: int
    size: int = 0


def list_files(root: str) -> dict[str, int]:
    """Path and size of the files below a folder (or of one file); names that begin with ``_`` or ``.`` are hidden."""
    system, path = _open(root)
    found = system.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    infos = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return {i.path: i.size for i in infos if i.is_file and not re.search(r"(^|/)[_.]", i.path[len(path):] if not found.is_file else "")}


NOTHING = ByteRange("", 0, 0)  # a plan needs a range


def cut(file: str, begin: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(file, at, min(at + size, end)) for at in range(begin, end, size)]


def tasks(file: str, begin: int, end: int, size: int) -> list[ByteRange]:
    """The ranges of ``cut``, a task's worth in each part, so that small ranges don't make a task each."""
    return [ByteRange(file, r.begin, r.end, size) for r in cut(file, begin, end, size * max(1, TASK_BYTES // size))]


def lines_of(stream, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its line feed) of the lines that begin in the range; ``stream`` can seek and read."""
    at = begin
    if begin:
        stream.seek(begin - 1)
        while True:  # to the first line feed at begin - 1 or later
            block = stream.read(min(READ_BYTES, end - at + 1))
            if not block:
                return
            feed = block.find(b"\n")
            if feed >= 0:
                at += feed
                break
            at += len(block)
            if at >= end:
                return
    stream.seek(at)
    pieces: list[bytes] = []
    while at < end:
        # a little past the end, where the last line is likely to end
        block = stream.read(min(READ_BYTES, max(end - at, 0) + PAST_BYTES))
        if not block:
            if pieces:
                yield at, b"".join(pieces)
            return
        *whole, rest = block.split(b"\n")
        for part in whole:
            pieces.append(part)
            line = b"".join(pieces)
            pieces = []
            yield at, line
            at += len(line) + 1
            if at >= end:
                return
        if rest:
            pieces.append(rest)


def _batches(system: fs.FileSystem, path: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    names = ["file", "offset", "value"]

    def batch(offsets: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(offsets), pa.string()), pa.array(offsets, pa.int64()),
                                           pa.array(values, pa.string())], names)

    offsets, values, held = [], [], 0
    with system.open_input_file(path) as stream:
        for own in cut(part.file, part.begin, part.end, part.size or part.end - part.begin):
            for at, line in lines_of(stream, own.begin, own.end):
                offsets.append(at)
                values.append(line.decode("utf-8", "replace"))
                held += len(line) + len(part.file) + 8
                if held >= BATCH_BYTES:
                    yield batch(offsets, values)
                    offsets, values, held = [], [], 0
    if offsets:
        yield batch(offsets, values)


class _Reads:
    def __init__(self, options):
        self.root = options["path"]
        self.size = int(options.get("rangeBytes", RANGE_BYTES))
        if self.size < 1:
            raise ValueError("rangeBytes must be positive")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.file:
            # listed paths belong to the file system of the root
            yield from _batches(_open(self.root)[0], partition.file, partition)


class _TableReader(_Reads, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        return [r for file, size in sorted(list_files(self.root).items()) for r in tasks(file, 0, size, self.size)] or [NOTHING]


class _StreamReader(_Reads, DataSourceStreamReader):
    """The offset is the end of the last whole line of every file, so a line is read when its line feed is there."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _open(self.root)
        return {file: self._whole(system, file, size) for file, size in sorted(list_files(self.root).items())}

    @staticmethod
    def _whole(system: fs.FileSystem, file: str, size: int) -> int:
        with system.open_input_file(file) as stream:
            end = size
            while end:
                begin = max(0, end - READ_BYTES)
                stream.seek(begin)
                feed = stream.read(end - begin).rfind(b"\n")
                if feed >= 0:
                    return begin + feed + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [r for file, to in end.items() for r in tasks(file, start.get(file, 0), to, self.size)] or [NOTHING]

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """Format ``log_lines``: option ``path`` (a folder or file), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _registered(spark: SparkSession, path: str, range_bytes: int, stream: bool):
    # the planner's Python does not see shipped packages, so the source travels with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogLines)
    return (spark.readStream if stream else spark.read).format("log_lines").option("rangeBytes", str(range_bytes)).option("path", path).load()


def read_log_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines below a folder as (file, offset, value), without trailing blanks; ``offset`` is the byte the line begins at.

    Lines end with a line feed; bytes that are no UTF-8 become U+FFFD. A file that does not end with a line feed gives its last line
    too, an empty file none. A line is held whole, so its length alone bounds a task's memory beside a batch of 4 MB.
    """
    return _registered(spark, path, range_bytes, False).withColumn("value", F.rtrim("value"))


def stream_log_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same rows as a stream: files that come and lines appended to files, each line once it is whole.

    The checkpoint holds one number a file. Files may grow and be added; a file that shrinks or is rewritten is not noticed.
    """
    return _registered(spark, path, range_bytes, True).withColumn("value", F.rtrim("value"))
