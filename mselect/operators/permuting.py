"""Exact shuffles of positions by arithmetic on each row alone: no sort, no exchange, nothing kept."""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WORD = 1 << 31  # a half position and every constant lie below, so that no product leaves 64 bits


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three constants a round, fixed by the seed: an odd factor, a shift, and the shift's growth from epoch to epoch."""
    out = []
    for r in range(ROUNDS):
        words = hashlib.sha256(f"{seed}|{r}".encode()).digest()
        factor, shift, growth = (int.from_bytes(words[i:i + 4], "big") % WORD for i in (0, 4, 8))
        out.append((factor | 1, shift, growth | 1))
    return out


def sides(n: int) -> tuple[int, int]:
    """The sides a, b of the rectangle that holds ``n`` positions; fewer than ``a`` of its cells are over."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _div(value: Column, by: int) -> Column:
    # whole numbers throughout: a double holds 53 bits
    return F.call_function("div", value, F.lit(by).cast("long"))


def _mix(half: Column, factor, shift, growth, epoch: Column) -> Column:
    t = (half * factor + epoch * growth + shift) % WORD
    return F.shiftright(t * t, 15)


def permuted(df: DataFrame, n: int, seed: int, position: str = "pos", name: str = "shuffled", epoch: str | None = None) -> DataFrame:
    """Add ``name``: a permutation of the positions 0 to n - 1 that the seed fixes, and the value of ``epoch`` if given.

    A Feistel network over two halves of the position, with moduli just large enough: less than a square root of n cells lie
    outside the range. A value that falls there is sent through again until it comes back (it can't visit a cell twice), which
    fewer than sqrt(n) rows need. A null position gives null; one outside the range fails the job, and so does a negative epoch.
    ``n`` is below 2^62, epochs below 2^31. Columns that begin with ``_permute`` are the operator's own.
    """
    if not 0 <= n < WORD * WORD:
        raise ValueError("n must be from 0 to 2^62")
    a, b = sides(n)
    keys = round_keys(seed)
    place, turn = F.col(position).cast("long"), F.lit(0) if epoch is None else F.col(epoch)
    bad = F.raise_error(F.lit(f"{position} outside 0 to {n - 1}, or an epoch outside its range")).cast("long")
    out = df.withColumn("_permute_e", turn.cast("long"))
    fine = place.isNull() | (place.between(0, n - 1) & F.col("_permute_e").between(0, WORD - 1))
    out = out.withColumn("_permute_v", F.when(fine, place).otherwise(bad))
    out = out.withColumns({"_permute_l": F.col("_permute_v") % a, "_permute_r": _div(F.col("_permute_v"), a)})
    # a projection a round: inside one expression each half would be written out twice a round, 2^8 times in all
    for r, k in enumerate(keys):
        mixed = (F.col("_permute_l") + _mix(F.col("_permute_r"), *k, F.col("_permute_e"))) % (b if r % 2 else a)
        out = out.withColumns({"_permute_l": F.col("_permute_r"), "_permute_r": mixed})
    value = F.col("_permute_r") * a + F.col("_permute_l")
    over = a * b - n if n else 0
    if over:
        rounds = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip("fsgm", (*k, b if r % 2 else a))])
                           for r, k in enumerate(keys)])

        def again(v: Column) -> Column:
            return F.aggregate(rounds, F.struct((v % a).alias("l"), _div(v, a).alias("r")),
                               lambda h, k: F.struct(h["r"].alias("l"), ((h["l"] + _mix(h["r"], k["f"], k["s"], k["g"], F.col("_permute_e")))
                                                                         % k["m"]).alias("r")),
                               lambda h: h["r"] * a + h["l"])

        out = out.withColumn("_permute_v", value)
        value = F.when(F.col("_permute_v") < n, F.col("_permute_v")).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.lit(over)), F.col("_permute_v"), lambda v, _: F.when(v >= n, again(v)).otherwise(v)))
    return out.withColumn(name, value).drop("_permute_e", "_permute_v", "_permute_l", "_permute_r")


def shuffled_epochs(df: DataFrame, n: int, seed: int, batch: int, epochs: int, position: str = "pos") -> DataFrame:
    """Every row once an epoch, in an order of its own each time: adds (epoch, shuffled, minibatch, offset).

    ``position`` numbers the rows from 0 to n - 1. Row ``offset`` of ``minibatch`` is known from the row alone, so a reader that wants
    a minibatch filters on it and a writer that wants files of minibatches repartitions by it.
    """
    turns = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))) if epochs else df.withColumn("epoch", F.lit(1)).limit(0)
    out = permuted(turns, n, seed, position, "shuffled", "epoch")
    place = F.col("shuffled")
    return out.withColumns({"minibatch": _div(place, batch), "offset": (place % batch).cast("int")})
