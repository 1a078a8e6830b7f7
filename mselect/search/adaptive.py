"""Adaptive search: sampling a space, proposing configurations from finished trials, and the search loop."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mselect.operators.ranking import hash_fraction
from mselect.operators.sequence import Ordered
from mselect.session import cut_lineage
from mselect.sources.runs import Steps


def _choice(values: list, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def draw(ids: DataFrame, space: Mapping, seed: int, id: str = "trial_id") -> DataFrame:
    """Add a configuration to every row: model and lambda uniform among the values, learning rate log-uniform between
    its two bounds, batch size a uniform whole number between its two bounds, both included.

    Every number depends on the seed and the row's id only.
    """
    tagged = ids
    for f in ("learning_rate", "lambda_value", "batch_size", "model"):
        tagged = tagged.withColumn(f"_k_{f}", F.concat(F.col(id).cast("string"), F.lit(f"|{f}")))
    u = {f: hash_fraction(seed, f"_k_{f}") for f in ("learning_rate", "lambda_value", "batch_size", "model")}
    lo, hi = np.log(space["learning_rate"][0]), np.log(space["learning_rate"][1])
    b0, b1 = space["batch_size"][0], space["batch_size"][1]
    return tagged.select(
        *ids.columns,
        F.exp(F.lit(float(lo)) + F.lit(float(hi - lo)) * u["learning_rate"]).alias("learning_rate"),
        _choice([float(v) for v in space["lambda_value"]], u["lambda_value"]).alias("lambda_value"),
        (F.floor(u["batch_size"] * (b1 - b0 + 1)) + b0).cast("int").alias("batch_size"),
        _choice(list(space["model"]), u["model"]).alias("model"))


def sample_space(spark: SparkSession, space: Mapping, n: int, seed: int, start: int = 0) -> DataFrame:
    """``n`` configurations, numbered from ``start``."""
    return draw(spark.range(start, start + n).withColumnRenamed("id", "trial_id"), space, seed)


#: Bins of a numeric field's range, for the densities of finished trials.
BINS = 64


def _bin(x: Column, lo: float, hi: float) -> Column:
    """The bin of a number; what lies outside the range goes to the first or last one."""
    place = F.floor((x - lo) / max(hi - lo, 1e-12) * BINS)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int")


def _number(field: str, values: list) -> Column:
    """The place of a field's value among ``values``; null for others."""
    return F.coalesce(*[F.when(F.col(field) == F.lit(v), F.lit(i)) for i, v in enumerate(values)]).cast("int")


def _kernel(counts: np.ndarray, n: int, lo: float, hi: float) -> np.ndarray:
    """Log density of each bin: equal-width normal kernels at the bins of ``n`` seen values and one over the whole range."""
    centre = lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS
    width = max((hi - lo) / (1 + np.sqrt(n)), 1e-12)
    bumps = np.exp(-0.5 * ((centre[:, None] - centre) / width) ** 2) @ counts
    return np.log((bumps + width / max(hi - lo, 1e-12)) / (width * (n + 1)))


def suggest_next(trials: DataFrame, space: Mapping, c: int, seed: int, start: int, candidates: int = 24,
                 quantile: float = 0.25) -> DataFrame:
    """The next ``c`` configurations by tree-structured Parzen estimates over the finished trials, however many there are.

    Finished trials are split at a loss quantile by their place in the order of (loss, trial_id); among ``candidates`` draws per proposal the
    one with the highest ratio of good to bad density wins, the earliest if equal. Densities are over bins of the ranges and over values, so
    what comes to the driver, and what the plan holds, is one count a bin or value and side. Without two finished trials
    proposals are plain draws.
    """
    spark = trials.sparkSession
    lr, bs = [float(np.log(v)) for v in space["learning_rate"]], [float(v) for v in space["batch_size"]]
    values = {"lambda_value": [float(v) for v in space["lambda_value"]], "model": list(space["model"])}
    places = {"learning_rate": _bin(F.log("learning_rate"), *lr), "batch_size": _bin(F.col("batch_size").cast("double"), *bs),
              **{f: _number(f, v) for f, v in values.items()}}
    done = trials.where(F.col("loss").isNotNull()).select("trial_id", "loss", *[p.alias(f) for f, p in places.items()])
    ranked = cut_lineage(Ordered(done, [], ["loss", "trial_id"]).position("_p").done())
    n = ranked.count()
    if n < 2:
        return sample_space(spark, space, c, seed, start)
    cut = max(1, int(np.ceil(quantile * n)))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("at")) for f in places])).alias("c")
    counts = ranked.select((F.col("_p") < cut).alias("good"), cells).where("c.at IS NOT NULL").groupBy("good", "c.field", "c.at").count()
    sides = {g: {f: np.zeros(len(values.get(f, range(BINS)))) for f in places} for g in (True, False)}
    for r in counts.collect():  # one a bin or value and side
        sides[r["good"]][r["field"]][r["at"]] = r["count"]
    if cut >= n:
        sides[False] = sides[True]

    def ratio(field: str) -> list[float]:
        logs = []
        for good, size in ((True, min(cut, n)), (False, n - cut if cut < n else n)):
            seen = sides[good][field]
            logs.append(np.log((1 + seen) / (len(seen) + size)) if field in values else _kernel(seen, size, *(lr if field == "learning_rate" else bs)))
        return (logs[0] - logs[1]).tolist()

    pool = spark.range(start, start + c).withColumnRenamed("id", "trial_id").withColumn(
        "candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    drawn = draw(pool.withColumn("_id", F.concat_ws("#", "trial_id", "candidate")), space, seed, "_id")
    score = sum((F.get(F.array(*map(F.lit, ratio(f))), p) for f, p in places.items()), F.lit(0.0))
    fields = F.struct("learning_rate", "lambda_value", "batch_size", "model")
    return drawn.withColumn("_s", score).groupBy("trial_id").agg(
        F.max_by(fields, F.struct("_s", (-F.col("candidate")).alias("c"))).alias("r")).select("trial_id", "r.*")


def record_losses(trials: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each trial with its mean validation loss at its last epoch; ``jobs`` has (trial_id, epoch, loss_valid)."""
    means = jobs.groupBy("trial_id", "epoch").agg(F.avg("loss_valid").alias("m"))
    last = means.groupBy("trial_id").agg(F.max_by("m", "epoch").alias("loss"))
    return trials.drop("loss").join(last, "trial_id", "left")


def search(spark: SparkSession, space: Mapping, train: Callable[[DataFrame], DataFrame], max_configs: int = 32, c: int = 8,
           seed: int = 2018, table: str | None = None, steps: Steps | None = None) -> DataFrame:
    """Propose ``c`` configurations, train them, record their losses, until ``max_configs`` are done.

    ``train`` takes trials (trial_id, configuration) and returns (trial_id, epoch, loss_valid). The trial table is
    written after every round: to the checkpoint folder, and to ``table`` when named. With ``steps`` the proposals and the results of each
    round are kept there, and a search that was stopped goes on with the round it was in; its key must stand for the space, the
    seed, ``c`` and what ``train`` trains on (``runs.fingerprint``).
    """
    trials = None
    for done in range(0, max_configs, c):
        size = min(c, max_configs - done)
        turn = f"{done // c}-of-{size}"

        def propose(trials=trials, size=size, done=done):
            drawn = sample_space(spark, space, size, seed, done) if trials is None else suggest_next(trials, space, size, seed, done)
            return drawn.withColumn("batch", F.lit(done // c))

        batch = cut_lineage(propose()) if steps is None else steps.run(f"proposals-{turn}", propose)

        def finish(batch=batch):
            return record_losses(batch, train(batch.drop("batch")))

        finished = finish() if steps is None else steps.run(f"losses-{turn}", finish)
        trials = cut_lineage(finished if trials is None else trials.unionByName(finished))
        if table is not None:
            trials.write.mode("overwrite").saveAsTable(table)
    return trials


def hopper_trainer(packed: DataFrame, valid: DataFrame, epochs: int, strategy: str = "hopper") -> Callable[[DataFrame], DataFrame]:
    """A ``train`` function for ``search``: hopper, averaging, or job table over placed data."""
    from mselect.training import loops

    inputs, classes = loops.data_shape(packed)

    def train(trials: DataFrame) -> DataFrame:
        states = loops.init_states(trials.withColumnRenamed("trial_id", "ordinal"), inputs, classes)
        if strategy == "jobs":
            _, jobs = loops.fit_job_table(packed, states, epochs, valid)
            return jobs.select(F.col("model_key").alias("trial_id"), "epoch", "loss_valid")
        fit = loops.fit_model_hopper if strategy == "hopper" else loops.fit_model_averaging
        _, history = fit(packed, states, epochs, valid)
        return history.select(F.col("model_key").alias("trial_id"), "epoch", F.col("loss").alias("loss_valid"))

    return train
