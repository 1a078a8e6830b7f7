"""Sorting, limits, best-of, sampling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.operators.aggregates import mean_by, mean_by_epoch_mode, mean_by_epoch_model

# Rows around a sampling cut that one task may sort.
def sort_configs(configs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Model, then batch size, then enumeration order."""
    return configs.orderBy("model", "batch_size", ordinal)


def limit_offset(df: DataFrame, n: int, k: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows after the first ``k`` in order."""
    return df.orderBy(*order).offset(k).limit(n)


def _curve(curves: DataFrame, keys: Sequence[str], epoch: str, score: Column, best: str) -> DataFrame:
    """The rows of the model whose score is best at the last epoch; ties go to the lowest key.

    ``curves`` is an aggregate with a row per (epoch, model). The last epoch's winner is found by one ``min_by`` over
    (-epoch, score, key), so neither a sort nor a second pass for the last epoch is needed.
    """
    signed = score if best == "min" else -score
    win = curves.where(score.isNotNull()).agg(
        F.min(F.struct((-F.col(epoch)).alias("e"), signed.alias("s"), *keys)).alias("b")
    ).select(*[F.col(f"b.{k}").alias(k) for k in keys])
    return curves.join(F.broadcast(win), list(keys), "left_semi")


def best_model(jobs: DataFrame, mode: str = "metric") -> DataFrame:
    """Best model at the last epoch with its whole curve as (epoch, model_key, y)."""
    means = mean_by_epoch_model(jobs)
    if mode == "metric":
        return _curve(means, ["model_key"], "epoch", F.col("metric_valid"), "max").select(
            "epoch", "model_key", (1 - F.col("metric_valid")).alias("y"))
    return _curve(means, ["model_key"], "epoch", F.col("loss_valid"), "min").select(
        "epoch", "model_key", F.col("loss_valid").alias("y"))


def find_best(rows: DataFrame, method: str, top_5: bool = True) -> DataFrame:
    """Learning curve (epoch, error) of the best model, by the kind of run.

    ``ctq``: job records. ``ma``/``udaf``: rows with the final metric and arrays of metrics and epochs. ``ddp``: rank
    metrics. Anything else: model-log rows.
    """
    if method == "ctq":
        return best_model(rows).select("epoch", F.col("y").alias("error"))
    if method in ("ma", "udaf"):
        top = rows.agg(F.max_by(F.struct("metrics_iters", "validation_metrics"),
                                F.struct("validation_metrics_final", (-F.col("model_id")).alias("k"))).alias("r"))
        pairs = top.select(F.explode(F.arrays_zip(F.col("r.metrics_iters").alias("e"),
                                                  F.col("r.validation_metrics").alias("m"))).alias("p"))
        return pairs.select(F.col("p.e").alias("epoch"), (1 - F.col("p.m")).alias("error"))
    if method in ("ddp", "da-ddp"):
        acc = "acc_top5" if top_5 else "acc_top1"
        means = mean_by(rows.where(F.col("mode") == "valid"), ["epoch", "model_index"], [acc])
        return _curve(means, ["model_index"], "epoch", F.col(acc), "max").select(
            (F.col("epoch") + 1).alias("epoch"), (1 - F.col(acc)).alias("error"))
    err = "error" if top_5 else "error_1"
    means = mean_by_epoch_mode(rows.where(F.col("mode") == "VALID"))
    return _curve(means, ["mst_key"], "epoch", F.col(err), "min").select(
        (F.col("epoch") + 1).alias("epoch"), F.col(err).alias("error"))


def sort_by_final_metric(rows: DataFrame, metric: str = "validation_metrics_final") -> DataFrame:
    return rows.orderBy(F.col(metric).desc())


def _digest(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_fraction(seed: int, *keys: str) -> Column:
    """A number in [0, 1) fixed by the seed and the row's key."""
    return F.conv(F.substring(_digest(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order fixed by seed and key, whatever the partitioning."""
    return df.orderBy(_digest(seed, *keys), *keys)


def sample_exact(df: DataFrame, fraction: float = 0.025, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly round(fraction x rows) rows without replacement, chosen by the seeded digest of a unique key.

    The digest prefix that separates chosen from other rows is found from counts of prefixes (a bounded number of groups),
    lengthened until the count is met. The result is then a plain filter: no sort and no shuffle of the table. A key that
    repeats just at the boundary, so that no digest separates the rows, is an error.
    """
    tagged = df.select(_digest(seed, key).alias("_d"))
    prefix, want, inside = "", None, tagged
    while True:
        width = len(prefix) + 4
        counts = inside.groupBy(F.substring("_d", 1, width).alias("p")).count()
        bins = sorted((r["p"], r["count"]) for r in counts.collect())  # at most 16^4 prefixes
        if want is None:
            want = round(fraction * sum(n for _, n in bins))
            if want == 0:
                return df.limit(0)
        for prefix, n in bins:
            if want <= n:
                break
            want -= n
        if want == n:
            return df.where(F.substring(_digest(seed, key), 1, width) <= prefix)
        if width >= 32:
            raise ValueError(f"column {key!r} repeats a value {n} times at the boundary; sample_exact needs a unique key")
        inside = tagged.where(F.substring("_d", 1, width) == prefix)


def split_rows(df: DataFrame, fraction: float = 0.1, seed: int = 2018, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Flag each row as validation (1) with the given probability, on its own and repeatably."""
    return df.withColumn("validation", (hash_fraction(seed, *keys) < fraction).cast("int"))


def sanity_head(configs: DataFrame, n: int = 8, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` configurations."""
    return configs.orderBy(ordinal).limit(n)


def single(configs: DataFrame, index: int, ordinal: str = "ordinal") -> DataFrame:
    """The configuration at a 0-based place."""
    return configs.where(F.col(ordinal) == index)
