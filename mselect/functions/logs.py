"""Parsing of run-log and monitor-log lines as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.functions.features import col

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"

# Fields of a disk record and of a network record.
DISK_FIELDS = ["tps", "MB_read/s", "MB_wrtn/s", "MB_read", "MB_wrtn"]
DISK_MARK = "MB_wrtn "
CONTROL_IFACE = "CONTROL_IFACE"
EXPERIMENT_IFACE = "EXPERIMENT_IFACE"

# Log messages of the data-parallel runs that are shortened to these names.
SHORT_EVENTS = ["Start loading data", "End loading data", "Start MST", "End MST"]


def parse_time(c: str | Column) -> Column:
    """Timestamp of a whole text, null when it is something else."""
    c = col(c)
    return F.when(c.rlike(TIME_PATTERN), c.try_cast("timestamp_ntz"))


def kv_value(line: str | Column, key: str) -> Column:
    """One value of a ``K: V, K: V`` line: the last pair of that key that has two parts, null without one.

    The same value as ``parse_kv(line)[key]`` without building the map.
    """
    quoted = re.escape(key)
    found = F.regexp_extract(col(line), rf"^(?:.*, )?{quoted}: ((?:(?!, |: ).)*)(?:, .*)?$", 1)
    return F.when(col(line).rlike(rf"(?:^|, ){quoted}: (?:(?!, |: ).)*(?:, |$)"), found)


def parse_kv(line: str | Column, strict: bool = False) -> Column:
    """``K: V, K: V`` as a map. Pairs that are not two parts are dropped, or fail the job when ``strict``."""
    parts = F.transform(F.split(col(line), ", "), lambda p: F.split(p, ": "))
    good = F.filter(parts, lambda p: F.size(p) == 2)
    # a repeated key keeps its last value
    names = F.transform(good, lambda p: p[0])
    unique = F.array_distinct(names)
    latest = F.transform(unique, lambda k: F.element_at(F.filter(good, lambda p: p[0] == k), -1)[1])
    result = F.map_from_arrays(unique, latest)
    if strict:
        bad = F.exists(parts, lambda p: F.size(p) != 2)
        return F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), col(line))).cast("map<string,string>")
                      ).otherwise(result)
    return result


def parse_event_line(line: str | Column, style: str) -> Column:
    """Struct (info, t) of one log line.

    ``notice``: three fields, the time may carry a ``(...)`` suffix. ``client``: the time is the last field.
    ``unix``: pairs holding EVENT and TIME. ``ddp``: like client, with the long messages shortened.
    """
    c = col(line)
    if style == "unix":
        seconds = kv_value(c, "TIME").try_cast("bigint")
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.struct(kv_value(c, "EVENT").alias("info"), F.timestamp_add("SECOND", seconds, epoch).alias("t"))
    if style == "notice":
        info = F.trim(F.split_part(c, F.lit(": "), F.lit(2)))
        stamp = F.trim(F.substring_index(F.split_part(c, F.lit(": "), F.lit(3)), "(", 1))
    elif style in ("client", "ddp"):
        stamp = F.trim(F.substring_index(c, ": ", -1))
        before = F.left(c, F.length(c) - F.length(F.substring_index(c, ": ", -1)) - 2)
        info = F.trim(F.when(before.rlike(r"\s: |:  "), F.regexp_replace(before, r"\s*: \s*", ": ")).otherwise(before))
        if style == "ddp":
            for name in reversed(SHORT_EVENTS):
                info = F.when(c.contains(name), F.lit(name)).otherwise(info)
    else:
        raise ValueError(f"unknown line style {style!r}")
    return F.struct(info.alias("info"), parse_time(stamp).alias("t"))


def parse_percent(line: str | Column, place: int) -> Column:
    """The ``place``-th comma-separated number of a line such as ``12%,34.5%`` without its one-letter unit."""
    piece = F.get(F.split(col(line), ","), F.lit(place))
    return F.regexp_extract(piece, r"^\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*.$", 1).try_cast("double")


def parse_disk(line: str | Column) -> Column:
    """Array of two device structs (device, tps, rates, cumulative MB) from the text after the header words.

    One bad field makes the whole record null.
    """
    c = col(line)
    tokens = F.split(F.substring_index(c, DISK_MARK, -1), " ")

    def device(at: int) -> Column:
        numbers = [F.get(tokens, F.lit(at + 1 + i)).try_cast("double").alias(n.replace("/", "_per_"))
                   for i, n in enumerate(DISK_FIELDS)]
        return F.struct(F.get(tokens, F.lit(at)).alias("device"), *numbers)

    both = F.array(device(0), device(6))
    names = [n.replace("/", "_per_") for n in DISK_FIELDS]
    good = F.forall(both, lambda d: (F.coalesce(d["device"], F.lit("")) != "") & reduce(and_, (d[n].isNotNull() for n in names)))
    return F.when(c.contains(DISK_MARK) & good, both)


def names_interface(line: str | Column) -> Column:
    return col(line).rlike(rf"(?:^|, )(?:{CONTROL_IFACE}|{EXPERIMENT_IFACE}): (?:(?!, |: ).)*(?:, |$)")


def parse_net(line: str | Column) -> Column:
    """Map of a network line's numbers; the interface entry itself is left out, null if the line names none."""
    named = names_interface(line)
    numbers = F.map_filter(parse_kv(col(line)), lambda k, _: ~k.isin(CONTROL_IFACE, EXPERIMENT_IFACE))
    return F.when(named, F.transform_values(numbers, lambda _, v: v.try_cast("double")))


def keep_lines(lines: DataFrame, any_of: list[str] = (), none_of: list[str] = (), column: str = "value") -> DataFrame:
    """Lines that hold one of the markers and none of the others; empty lines go."""
    c = F.col(column)
    cond = c != ""
    if any_of:
        hit = F.lit(False)
        for m in any_of:
            hit = hit | c.contains(m)
        cond = cond & hit
    for m in none_of:
        cond = cond & ~c.contains(m)
    return lines.where(cond)


def lines_of_worker(lines: DataFrame, worker: int, style: str, column: str = "value") -> DataFrame:
    """The lines of a shared log that name a worker by ``WORKER: n`` (style unix) or ``segn``; the number is compared whole."""
    mark = r"WORKER: (\d+)" if style == "unix" else r"seg(\d+)"
    return lines.where(F.regexp_extract(column, mark, 1) == str(worker))
