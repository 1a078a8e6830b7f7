"""Best-fit packing through a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence. The program asks for the fewest configurations, in fractions,
that cover the histogram. A greedy cover at nearly fixed prices comes first; the dual bound at its prices often shows that it is near the
least. If not, the program is solved by multiplicative weights: in small steps the price of a length falls as it gets covered,
dynamic programming over a knapsack finds the dearest configuration, and the average of all steps nears the least. Covers are
rounded down, and what is left is packed by best fit, both on counts of equal lengths; the plan with the fewest sequences is kept.
All of this sees the histogram alone, which has at most as many rows as a sequence has tokens; the pieces are numbered and placed by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mselect.llm.common import blocks_for, numbered

Config = tuple[tuple[int, int], ...]  # (length, times), longest first


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Config:
    """The configuration of the highest total price, by dynamic programming. ``lengths`` rise; equal totals prefer long pieces."""
    falling, price = lengths[::-1], prices[::-1]
    first = len(lengths) - np.searchsorted(lengths, np.arange(capacity + 1), "right")  # the longest that fits each room
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        at = first[room]
        value = price[at:] + best[room - falling[at:]]
        n = int(value.argmax())
        best[room], took[room] = value[n], falling[at + n]
    config: dict[int, int] = {}
    room = capacity
    while took[room]:
        config[int(took[room])] = config.get(int(took[room]), 0) + 1
        room -= int(took[room])
    return tuple(sorted(config.items(), reverse=True))


def greedy(counts: dict[int, int], capacity: int, convex: float = 1.1, rate: float = 0.1) -> tuple[dict[Config, float], float]:
    """A cover of the histogram by fractions of configurations, and a number that no cover goes below.

    Prices start at length ** ``convex``, which favours lengths that are hard to place. In each round the dearest configuration
    is used until one of its lengths is covered; then the prices of its lengths fall by exp(-rate * share covered).
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[n] for n in lengths.tolist()], float)
    weight = (lengths / capacity) ** convex
    missing = np.ones(len(lengths))
    x: dict[Config, float] = {}
    bound = float(lengths @ need) / capacity
    while len(open_ := np.flatnonzero(missing > 1e-9)):
        config = dearest(lengths[open_], weight[open_], capacity)
        rows = np.searchsorted(lengths, [n for n, _ in config])
        times = np.array([k for _, k in config])
        bound = max(bound, float(weight[open_] @ need[open_] / (times @ weight[rows])))
        share = times / need[rows]  # of the need, that one use covers
        uses = (missing[rows] / share).min()
        x[config] = x.get(config, 0.0) + uses
        missing[rows] -= uses * share
        weight[rows] *= np.exp(-rate * uses * share)
    return x, bound


def averaged(counts: dict[int, int], capacity: int, start: Sequence[Config], eps: float, rounds: int) -> tuple[dict[Config, float], float]:
    """A cover by multiplicative weights, and the best dual bound met: within ``eps`` of each other, or as near as ``rounds`` bring them.

    A step uses the dearest configuration known, at prices exp(-sharpness * share covered) / need, until the scarcest of its lengths gains
    a share of eps / sharpness. All lengths stay open, and the average of the steps is the cover. Sharpness doubles until the
    cover is within eps / 2 of the bound of the configurations known; then the knapsack adds the dearest of all, or shows that none is dearer.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[n] for n in lengths.tolist()], float)
    configs = list(dict.fromkeys([*start, *(((n, capacity // n),) for n in lengths.tolist())]))

    def share(config: Config) -> np.ndarray:
        row = np.zeros(len(lengths))
        row[np.searchsorted(lengths, [n for n, _ in config])] = [k for _, k in config]
        return row / need
    shares = np.array([share(c) for c in configs])
    best, least, bound, sharp = {}, np.inf, 0.0, 4 * np.log(len(lengths) + 1)
    while rounds > 0 and least > (1 + eps) * bound:
        covered, uses, known, prices = np.zeros(len(lengths)), np.zeros(len(configs)), 0.0, need
        while rounds > 0 and covered.min() < 1 and least > (1 + eps / 2) * known:
            rounds -= 1
            weight = np.exp(-sharp * (covered - covered.min()))
            value = shares @ weight
            at = int(value.argmax())
            if weight.sum() > known * value[at]:
                known, prices = float(weight.sum() / value[at]), weight
            step = eps / sharp / shares[at].max()
            uses[at] += step
            covered += step * shares[at]
            if covered.min() > 0 and (total := uses.sum() / covered.min()) < least:
                least, best = total, {configs[c]: float(uses[c] / covered.min()) for c in np.flatnonzero(uses)}
        config = dearest(lengths, prices / need, capacity)
        row = share(config)
        bound = max(bound, float(prices.sum() / (row @ prices)))
        if config in configs:
            sharp *= 2
        else:
            configs.append(config)
            shares = np.vstack((shares, row))
    return best, bound


def fractional(counts: dict[int, int], capacity: int, eps: float = 0.01, rounds: int = 200_000) -> dict[Config, float]:
    """A cover of the histogram by fractions of configurations, at most 1 + ``eps`` times the dual bound if ``rounds`` steps suffice."""
    x, bound = greedy(counts, capacity)
    if not x or sum(x.values()) <= (1 + eps) * bound:
        return x
    y, _ = averaged(counts, capacity, list(x), eps, rounds)
    return min((c for c in (x, y) if c), key=lambda c: sum(c.values()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing over equal lengths: fill with the longest that fits, and repeat as often as the counts allow."""
    left = {n: k for n, k in counts.items() if k > 0}
    plan = []
    while left:
        room, config = capacity, []
        for n in sorted(left, reverse=True):
            if k := min(room // n, left[n]):
                config.append((n, k))
                room -= n * k
        times = min(left[n] // k for n, k in config)
        plan.append((tuple(config), times))
        for n, k in config:
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def rounded(x: dict[Config, float], counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """The whole uses of a cover, without pieces that don't exist, and best fit for what is left."""
    left, chosen = dict(counts), []
    for config, uses in sorted(x.items(), key=lambda c: (-c[1], c[0])):
        more = int(uses + 1e-6)
        while more and (part := tuple((n, min(k, left[n])) for n, k in config if left[n])):
            times = min(more, *(left[n] // k for n, k in part))
            chosen.append((part, times))
            for n, k in part:
                left[n] -= k * times
            more -= times
    return chosen + best_fit(left, capacity)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """(configuration, number of sequences) that hold each length exactly as often as it occurs."""
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    counts = {n: k for n, k in counts.items() if k > 0}
    if not counts:
        return []
    x, bound = greedy(counts, capacity)
    plans = [rounded(x, counts, capacity), best_fit(counts, capacity)]
    if min(map(used, plans)) > bound + 1:  # a plan within one sequence of the bound is as good as any
        plans.append(rounded(fractional(counts, capacity), counts, capacity))
    return min(plans, key=used)


def used(chosen: list[tuple[Config, int]]) -> int:
    """Sequences of a plan."""
    return sum(times for _, times in chosen)


def places(chosen: list[tuple[Config, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, offset), sorted: where the pieces of a length go by rank."""
    rows, used, sequence = [], {}, 0
    for config, times in chosen:
        offset = 0
        for n, k in config:
            rows.append((n, used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, order: Sequence[str], length: str = "length") -> DataFrame:
    """``pieces`` with (sequence_id, offset): as few sequences of at most ``capacity`` as the plan needs.

    ``pieces`` is read more than once, so give a written table. ``length`` must be from 1 to ``capacity``; a row
    without one is kept with no place.
    ``order`` are columns that tell rows apart; rows that agree in them are interchangeable. All columns are kept; columns
    named sequence_id or offset are replaced. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    # at most ``capacity`` rows
    counts = {r[0]: r[1] for r in pieces.where(F.col(length).isNotNull()).groupBy(length).count().collect()}
    table = places(plan(counts, capacity))
    span = 1 << 42  # more than pieces of a length can be
    starts = table[:, 0] * span + table[:, 1]
    send = pieces.sparkSession.sparkContext.broadcast((starts, table))
    ranked = numbered(pieces.where(F.col(length).isNotNull()), [length], F.struct(*order), list(order), blocks_for(max(counts.values(), default=0)), "_rank")
    names = pieces.columns

    def run(batches):
        starts, table = send.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            own = table[np.searchsorted(starts, n * span + rank, "right") - 1]
            turn = rank - own[:, 1]
            sequence, slot = own[:, 2] + turn // own[:, 3], turn % own[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(own[:, 4] + slot * n)], [*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    none = pieces.where(F.col(length).isNull()).select(
        "*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return ranked.select(*names, "_rank").mapInArrow(run, schema).unionByName(none)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, length): the ids of each sequence in one row, of a bounded size, from pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids)))
    out = packed.groupBy("sequence_id").agg(parts.alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda acc, p: F.concat(acc, p[ids]))
    return out.select("sequence_id", joined.alias("ids")).withColumn("length", (F.octet_length("ids") / 4).cast("long"))
