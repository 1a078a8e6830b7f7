"""Work that depends on row order: neighbours, running values, positions and what is built on them.

``Ordered`` range-partitions rows on (key, order), so that a large key spans many blocks, computes inside the blocks, and
carries one summary row per (key, block) across block borders. No task sorts more than a block, however many rows a key
has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mselect.session import cut_lineage

_BLOCK = "_block"
_INF = Window.unboundedPreceding


class Ordered:
    """A DataFrame seen as one ordered sequence per key. ``order`` must be a total order inside a key.

    ``blocks`` is the number of range partitions, that of shuffle partitions if not given. The rows are written to the
    checkpoint folder once, so wide columns that an operation doesn't need are better left out.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None):
        self.keys, self.order = list(keys), list(order)
        blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the block number must not change between the branches below, so it is written
        self.df = cut_lineage(
            df.repartitionByRange(blocks, *self.keys, *self.order).withColumn(_BLOCK, F.spark_partition_id()))

    def _inside(self):
        return Window.partitionBy(*self.keys, _BLOCK).orderBy(*self.order)

    def _attach(self, carry: DataFrame) -> DataFrame:
        names = [*self.keys, _BLOCK]
        right = carry.select(*[F.col(n).alias(f"_r_{n}") for n in names], "_carry")
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
        return self.df.join(right, cond, "left").drop(*[f"_r_{n}" for n in names])

    def shift(self, columns: Mapping[str, str], steps: int = 1) -> "Ordered":
        """Add, for every ``new: old``, the value ``steps`` rows earlier (later when negative), null past the ends."""
        back = steps > 0
        for turn in range(abs(steps)):
            source = columns if turn == 0 else {new: new for new in columns}
            self._shift_one(source, back)
        return self

    def _shift_one(self, columns: Mapping[str, str], back: bool) -> None:
        edge = F.max_by if back else F.min_by
        row = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
        summary = self.df.groupBy(*self.keys, _BLOCK).agg(edge(row, F.struct(*self.order)).alias("_edge"))
        over_blocks = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        move = F.lag if back else F.lead
        joined = self._attach(summary.withColumn("_carry", move("_edge").over(over_blocks)))
        w = self._inside()
        at_edge = move(F.lit(1)).over(w).isNull()
        self.df = joined.withColumns(
            {new: F.when(at_edge, F.col(f"_carry.{new}")).otherwise(move(old).over(w)) for new, old in columns.items()}
        ).drop("_carry")

    def running(self, values: Mapping[str, tuple[str, str]]) -> "Ordered":
        """Add running values up to and including the row: ``new: (kind, column)``.

        kind is sum, count, min, max, or last (the latest non-null value).
        """
        plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
                 "last": lambda c: F.last(c, ignorenulls=True)}
        w = self._inside().rowsBetween(_INF, 0)
        inside = {new: plain[kind](col).over(w) for new, (kind, col) in values.items()}
        per_block = []
        for new, (kind, col) in values.items():
            if kind == "last":
                agg = F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*self.order)))
            else:
                agg = plain[kind](col)
            per_block.append(agg.alias(new))
        before = Window.partitionBy(*self.keys).orderBy(_BLOCK).rowsBetween(_INF, -1)
        fold = {**plain, "count": F.sum}
        carry = self.df.groupBy(*self.keys, _BLOCK).agg(*per_block).withColumn(
            "_carry", F.struct(*[fold[kind](new).over(before).alias(new) for new, (kind, _) in values.items()])
        )
        joined = self._attach(carry.select(*self.keys, _BLOCK, "_carry"))
        merged = {}
        for new, (kind, _) in values.items():
            here, past = inside[new], F.col(f"_carry.{new}")
            if kind in ("sum", "count"):
                merged[new] = F.coalesce(here + past, here, past)
            elif kind == "min":
                merged[new] = F.least(here, past)
            elif kind == "max":
                merged[new] = F.greatest(here, past)
            else:
                merged[new] = F.coalesce(here, past)
        self.df = joined.withColumns(merged).drop("_carry")
        return self

    def position(self, name: str = "pos") -> "Ordered":
        """Add the 0-based place of each row inside its key."""
        self.df = self.df.withColumn("_one", F.lit(1))
        self.running({name: ("count", "_one")})
        self.df = self.df.withColumn(name, F.col(name) - 1).drop("_one")
        return self

    def done(self) -> DataFrame:
        return self.df.drop(_BLOCK)


def with_positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
                   blocks: int | None = None) -> DataFrame:
    """Add the 0-based place of each row inside its key, for rows that may be wide.

    Places are found on the key and order columns alone and joined back, so the other columns are not written to the
    checkpoint folder.
    """
    names = list(dict.fromkeys([*keys, *order]))
    seq = Ordered(rows.select(*names), keys, order, blocks)
    places = seq.position(name).done().select(*[F.col(n).alias(f"_r_{n}") for n in names], name)
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return rows.join(places, cond).drop(*[f"_r_{n}" for n in names])


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Seconds from ``start`` to ``end`` as a double, for timestamps with or without zone."""
    a = F.col(start) if isinstance(start, str) else start
    b = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", a, b).cast("double") / 1e6


def event_gaps(log: DataFrame, worker: str = "worker", time: str = "t", info: str = "info", tie: str = "pos",
               blocks: int | None = None) -> DataFrame:
    """Adjacent events of a worker as (worker, event, seconds); equal times keep line order."""
    seq = Ordered(log.select(worker, time, info, tie), [worker], [time, tie], blocks)
    out = seq.shift({"_t0": time, "_info0": info}).done().where(F.col("_t0").isNotNull())
    return out.select(
        worker,
        F.concat(F.lit("Between-"), "_info0", F.lit("-"), info).alias("event"),
        seconds_between("_t0", time).alias("seconds"),
    )


def fill_config(lines: DataFrame, config: Column, keys: Sequence[str], order: Sequence[str], name: str = "config",
                blocks: int | None = None) -> DataFrame:
    """Carry the latest non-null ``config`` forward inside a file; null before the first one."""
    seq = Ordered(lines.withColumn("_cfg", config), keys, order, blocks)
    return seq.running({name: ("last", "_cfg")}).done().drop("_cfg")


def run_intervals(log: DataFrame, method: str, find_first: bool = False, blocks: int | None = None) -> DataFrame:
    """The last start/end pair of a run in a global log (columns ``pos``, ``value``) as one row.

    Only lines naming the method count, unless ``find_first``. A start opens an interval, an end closes it, and any
    other counted line forgets both. Times are the last 19 characters of the line.
    """
    kept = log.select("pos", F.rtrim("value").alias("line"))
    if not find_first:
        kept = kept.where(F.col("line").contains(method))
    when = F.to_timestamp_ntz(F.right("line", F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))
    is_start = F.col("line").contains("Start time")
    is_end = ~is_start & F.col("line").contains("End time")
    tagged = kept.select(
        "pos",
        F.when(is_start, F.lit("start")).when(is_end, F.lit("end")).otherwise(F.lit("other")).alias("kind"),
        F.when(is_start | is_end, when).alias("t"),
    ).withColumn("opened", F.when(F.col("kind") != "end", F.struct("kind", "t")))
    seq = Ordered(tagged, [], ["pos"], blocks).running({"opener": ("last", "opened")}).done()
    ends = seq.where(F.col("kind") == "end").select(
        "pos", F.when(F.col("opener.kind") == "start", F.col("opener.t")).alias("start_time"), F.col("t").alias("end_time")
    )
    return ends.agg(F.max_by(F.struct("start_time", "end_time"), "pos").alias("r")).where("r IS NOT NULL").select("r.*")


def running_mean(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "running",
                 blocks: int | None = None) -> DataFrame:
    """Mean of all values up to each row."""
    seq = Ordered(rows, keys, order, blocks).running({"_s": ("sum", value), "_n": ("count", value)})
    return seq.done().withColumn(name, F.col("_s") / F.col("_n")).drop("_s", "_n")


def best_so_far(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "best",
                blocks: int | None = None) -> DataFrame:
    """Smallest value seen up to each row."""
    return Ordered(rows, keys, order, blocks).running({name: ("min", value)}).done()


def _first_by(rows: DataFrame, keys: Sequence[str], size: str, values: Sequence[str]) -> DataFrame:
    """Each key's values at its smallest size, one row per key."""
    first = F.min_by(F.struct(*[F.col(v).alias(f"_first_{v}") for v in values]), size).alias("_f")
    if not keys:
        return rows.agg(first).select("_f.*")
    return rows.groupBy(*keys).agg(first).select(*keys, "_f.*")


def normalize_to_first(rows: DataFrame, keys: Sequence[str], size: str, values: Sequence[str]) -> DataFrame:
    """Divide each value by the same key's value at the smallest size; 0/0 gives 1."""
    joined = rows.join(_first_by(rows, keys, size, values), list(keys))
    ratio = {
        v: F.when((F.col(v) == 0) & (F.col(f"_first_{v}") == 0), F.lit(1.0)).otherwise(
            F.col(v) / F.nullif(F.col(f"_first_{v}"), F.lit(0.0)))
        for v in values
    }
    return joined.withColumns(ratio).drop(*[f"_first_{v}" for v in values])


def speedup(rows: DataFrame, keys: Sequence[str], size: str, runtime: str, name: str = "speedup") -> DataFrame:
    """Run time at the smallest size divided by the run time."""
    joined = rows.join(_first_by(rows, keys, size, [runtime]), list(keys))
    return joined.withColumn(name, F.col(f"_first_{runtime}") / F.nullif(F.col(runtime), F.lit(0.0))).drop(
        f"_first_{runtime}")


def minus_baseline(phases: DataFrame, baseline: str, keys: Sequence[str] = ("size",), method: str = "method",
                   moved: str = "data_transmission", into: str = "model_hopping",
                   methods: Sequence[str] = ("udaf", "ma")) -> DataFrame:
    """Move the part of ``moved`` above the baseline method's value into ``into`` for the listed methods."""
    base = phases.where(F.col(method) == baseline).groupBy(*keys).agg(F.max(moved).alias("_base"))
    hit = F.col(method).isin(*methods) & F.col("_base").isNotNull()
    return phases.join(base, list(keys), "left").withColumns({
        into: F.when(hit, F.coalesce(into, F.lit(0.0)) + F.col(moved) - F.col("_base")).otherwise(F.col(into)),
        moved: F.when(hit, F.col("_base")).otherwise(F.col(moved)),
    }).drop("_base")


def minibatch_index(rows: DataFrame, batch: int, order: Sequence[str], keys: Sequence[str] = (),
                    drop_last: bool = False, blocks: int | None = None) -> DataFrame:
    """Add the minibatch number by position; ``drop_last`` leaves out a short final batch."""
    out = with_positions(rows, keys, order, "_pos", blocks)
    out = out.withColumn("batch", F.floor(F.col("_pos") / batch))
    if drop_last:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if keys:
            out = out.join(counts, list(keys))
        else:
            out = out.withColumn("_n", F.lit(counts.first()[0]))
        out = out.where(F.col("batch") < F.floor(F.col("_n") / batch)).drop("_n")
    return out.drop("_pos")


def relative_hours(rows: DataFrame, times: Sequence[str], zero: Column | None = None) -> DataFrame:
    """Replace timestamps by hours since ``zero``, or since the earliest value of the first column."""
    if zero is None:
        earliest = rows.agg(F.min(times[0]).cast("string")).first()[0]
        zero = F.lit(earliest).cast(rows.schema[times[0]].dataType)
    return rows.withColumns({t: seconds_between(zero, F.col(t)) / 3600 for t in times})


def linspace_epochs(start: Column, end: Column, epochs: int) -> Column:
    """``epochs`` equally spaced points after ``start``, the last one at ``end``."""
    steps = F.sequence(F.lit(1), F.lit(epochs))
    return F.transform(steps, lambda i: start + (end - start) * i / F.lit(float(epochs)))


def job_gantt(jobs: DataFrame, start: str = "start_time", end: str = "end_time", worker: str = "worker",
              model: str = "model") -> DataFrame:
    """Bars of a job chart: hours since the first start, length, and models numbered by first appearance."""
    first = jobs.groupBy(model).agg(F.min(start).alias("_seen"))
    numbered = Ordered(first, [], ["_seen", model]).position("ordinal").done().select(
        model, (F.col("ordinal") + 1).alias("ordinal"))
    out = jobs.withColumn("total_time", seconds_between(start, end)).join(numbered, model)
    return relative_hours(out, [start, end]).withColumnRenamed(worker, "task")
