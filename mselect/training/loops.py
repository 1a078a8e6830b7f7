"""Training and evaluation of many models over a packed table.

The data stay where they are: a packed table is partitioned by distribution key once, in memory (``prepare``) or in buckets on disk
(``place``), of which a step reads those of its keys alone. What
moves between steps is the model states, joined to the buffers by key. A state reaches Python only with the first
buffer of its key, and a task streams buffers, so memory holds a few buffers and the states in use.
"""

from __future__ import annotations

import base64
import copy
import pickle
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mselect.functions.configs import CONFIG_FIELDS
from mselect.operators.merging import merged_vectors
from mselect.operators.packing import _buffer_starts, class_table, pack
from mselect.operators.ranking import split_rows
from mselect.session import cut_lineage, ensure_checkpoint_dir, kept, ship_package
from mselect.sources.runs import Steps
from mselect.training import learner

STATE = "model_key BIGINT, learning_rate DOUBLE, lambda_value DOUBLE, batch_size INT, layers ARRAY<INT>, w ARRAY<FLOAT>"
_STATE_FIELDS = ["model_key", "learning_rate", "lambda_value", "batch_size", "layers", "w"]
_TRAINED = ("dist_key INT, model_key BIGINT, n BIGINT, w ARRAY<FLOAT>, start_time TIMESTAMP_NTZ, "
            "init_time DOUBLE, train_time DOUBLE")
_SCORED = "dist_key INT, model_key BIGINT, n BIGINT, sum_loss DOUBLE, hits DOUBLE, seconds DOUBLE"


def _bound_batches(spark: SparkSession) -> None:
    """The session default does not bound the bytes of an Arrow batch, and a buffer may be megabytes."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size) > 2**28:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**26))


def prepare(packed: DataFrame, keys: int) -> DataFrame:
    """The packed table partitioned and ordered by distribution key, kept for the steps to come."""
    ship_package(packed.sparkSession)
    _bound_batches(packed.sparkSession)
    placed = packed.repartition(keys, "dist_key").sortWithinPartitions("dist_key", "buffer_id")
    return placed.persist(StorageLevel.MEMORY_AND_DISK)


def place(packed: DataFrame, keys: int) -> DataFrame:
    """The packed table written once in ``keys`` buckets by distribution key, in the shared folder.

    A filter on ``dist_key`` reads the buckets of these keys alone, and a join by ``dist_key`` doesn't move the buffers.
    """
    spark = packed.sparkSession
    ship_package(spark)
    _bound_batches(spark)
    name = f"placed_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    dealt = packed.repartition(keys, "dist_key")
    dealt.write.bucketBy(keys, "dist_key").sortBy("dist_key", "buffer_id").option("path", path).saveAsTable(name)
    return spark.table(name)


def on_keys(packed: DataFrame, keys: Sequence[int]) -> DataFrame:
    """The buffers of some keys; of a placed table only their buckets are read."""
    return packed.where(F.col("dist_key").isin(list(keys)))


def data_shape(packed: DataFrame) -> tuple[int, int]:
    """Feature width and class count from the buffer shapes."""
    r = packed.where(F.element_at("dependent_var_shape", 1) > 0).agg(
        F.max(F.element_at("independent_var_shape", 2)), F.max(F.element_at("dependent_var_shape", 2))).first()
    return r[0], r[1]


def init_states(configs: DataFrame, inputs: int, classes: int, seed: int = learner.SEED, warm_start: bool = False,
                key: str = "ordinal") -> DataFrame:
    """One start state per configuration row. Warm start is not supported.

    Weights are drawn in the tasks from the seed and the layer sizes, so equal architectures start equal.
    """
    if warm_start:
        raise NotImplementedError("warm start is not supported")
    ship_package(configs.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            layers = [learner.layer_sizes(m, inputs, classes) for m in pdf["model"]]
            yield pd.DataFrame({
                "model_key": pdf["model_key"], "learning_rate": pdf["learning_rate"],
                "lambda_value": pdf["lambda_value"], "batch_size": pdf["batch_size"], "layers": layers,
                "w": [learner.initial_weights(s, seed) for s in layers]})

    return configs.select(F.col(key).cast("long").alias("model_key"), *CONFIG_FIELDS).mapInPandas(build, STATE)


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    outer = column.slice(row, 1).flatten()
    flat = outer.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(outer), -1).astype(np.float64)


def _with_states(packed: DataFrame, assign: DataFrame) -> DataFrame:
    """Buffers with ``models``, the states of their key, on the first buffer of the key and null on the others.

    ``assign`` has (dist_key, states...). The shuffled hash join builds on the small side and keeps both the
    partitioning and the order of the packed table.
    """
    models = assign.groupBy("dist_key").agg(F.sort_array(F.collect_list(F.struct(*_STATE_FIELDS))).alias("models"))
    first = packed.groupBy("dist_key").agg(F.min("buffer_id").alias("first_buffer"))
    right = models.join(first, "dist_key").hint("shuffle_hash")
    return packed.join(right, "dist_key").select(
        "dist_key", "buffer_id", "independent_var", "dependent_var",
        F.when(F.col("buffer_id") == F.col("first_buffer"), F.col("models")).alias("models"),
    ).sortWithinPartitions("dist_key", "buffer_id")


def train_assigned(packed: DataFrame, assign: DataFrame, optimizer: str = "adam") -> DataFrame:
    """Each assigned model once through the buffers of its key, from its given state: (dist_key, model_key, n, w, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fits, began, ready = None, {}, 0.0, 0.0

        def finished() -> Iterator[pa.RecordBatch]:
            for model, fit in fits.items():
                row = {"dist_key": key, "model_key": model, "n": fit.n, "w": fit.w.astype(np.float32),
                       "start_time": int(began * 1e6), "init_time": ready - began, "train_time": time.time() - ready}
                yield _record(row)

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                states = col["models"][r].as_py()
                if states is not None:
                    yield from finished()
                    began = time.time()
                    key = col["dist_key"][r].as_py()
                    fits = {s["model_key"]: learner.Fit(s["w"], s["layers"], s["learning_rate"], s["lambda_value"],
                                                        s["batch_size"], optimizer) for s in states}
                    ready = time.time()
                x, y = _numbers(col["independent_var"], r), _numbers(col["dependent_var"], r)
                for fit in fits.values():
                    fit.see(x, y)
        yield from finished()

    return _with_states(packed, assign).mapInArrow(run, _TRAINED)


def _record(row: Mapping) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row["dist_key"]], pa.int32()), pa.array([row["model_key"]], pa.int64()),
         pa.array([row["n"]], pa.int64()), pa.array([row["w"]], pa.list_(pa.float32())),
         pa.array([row["start_time"]], pa.timestamp("us")), pa.array([row["init_time"]], pa.float64()),
         pa.array([row["train_time"]], pa.float64())],
        names=["dist_key", "model_key", "n", "w", "start_time", "init_time", "train_time"])


def score_assigned(packed: DataFrame, assign: DataFrame, k: int = 1) -> DataFrame:
    """Summed loss and hits of each assigned model on its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        key, models, sums, began = None, [], {}, 0.0

        def finished() -> pd.DataFrame:
            return pd.DataFrame([(key, m, n, loss, hits, time.time() - began) for m, (n, loss, hits) in sums.items()],
                                columns=["dist_key", "model_key", "n", "sum_loss", "hits", "seconds"])

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                states = col["models"][r].as_py()
                if states is not None:
                    if sums:
                        yield pa.RecordBatch.from_pandas(finished(), schema=_SCORED_ARROW, preserve_index=False)
                    began, key = time.time(), col["dist_key"][r].as_py()
                    models = [(s["model_key"], np.asarray(s["w"], dtype=np.float64), s["layers"]) for s in states]
                    sums = {m: (0, 0.0, 0.0) for m, _, _ in models}
                x, y = _numbers(col["independent_var"], r), _numbers(col["dependent_var"], r)
                for m, w, layers in models:
                    loss, hits = learner.evaluate_rows(w, layers, x, y, k)
                    n0, l0, h0 = sums[m]
                    sums[m] = (n0 + len(x), l0 + loss, h0 + hits)
        if sums:
            yield pa.RecordBatch.from_pandas(finished(), schema=_SCORED_ARROW, preserve_index=False)

    return _with_states(packed, assign).mapInArrow(run, _SCORED)


_SCORED_ARROW = pa.schema([("dist_key", pa.int32()), ("model_key", pa.int64()), ("n", pa.int64()),
                           ("sum_loss", pa.float64()), ("hits", pa.float64()), ("seconds", pa.float64())])


def on_every_key(states: DataFrame, packed: DataFrame) -> DataFrame:
    """Assign every state to every distribution key of the table.

    Keys are counted first: there are as many as partitions, which the user chose.
    """
    keys = sorted(r[0] for r in packed.select("dist_key").distinct().collect())
    return states.withColumn("dist_key", F.explode(F.array(*map(F.lit, keys))))


def evaluate(packed: DataFrame, states: DataFrame, k: int = 1) -> DataFrame:
    """Mean loss and metric of every state over the whole table: (model_key, loss, metric, n)."""
    sums = score_assigned(packed, on_every_key(states, packed), k).groupBy("model_key").agg(
        F.sum("sum_loss").alias("l"), F.sum("hits").alias("h"), F.sum("n").alias("n"))
    return sums.select("model_key", (F.col("l") / F.col("n")).alias("loss"), (F.col("h") / F.col("n")).alias("metric"), "n")


def fit_step(packed: DataFrame, states: DataFrame, key: int | None = None, optimizer: str = "adam") -> DataFrame:
    """One pass of every given model over one key (or over each key, all from the same start)."""
    data = packed if key is None else packed.where(F.col("dist_key") == key)
    return train_assigned(data, on_every_key(states, data), optimizer)


def merge_states(trained: DataFrame) -> DataFrame:
    """Average the weights of a model over keys, weighted by example counts: (model_key, w).

    Weights are summed in levels of packed chunks, so a model trained on very many keys is no large group anywhere.
    """
    return merged_vectors(trained.where("n > 0"), ["model_key"])


def _with_weights(states: DataFrame, weights: DataFrame) -> DataFrame:
    """States with new weights; models without a new row keep theirs."""
    new = weights.select("model_key", F.col("w").alias("_w"))
    joined = states.join(new, "model_key", "left")
    return joined.select(*[F.coalesce("_w", "w").alias("w") if f == "w" else F.col(f) for f in _STATE_FIELDS])


def fit_model_averaging(packed: DataFrame, states: DataFrame, epochs: int, valid: DataFrame | None = None,
                        every: int = 1, optimizer: str = "adam") -> tuple[DataFrame, DataFrame]:
    """Train all keys from the same weights, merge, repeat. Returns the states and (epoch, model_key, loss, metric, n).

    Several models may be given; they are trained side by side and each is merged on its own.
    """
    states, history = cut_lineage(states), []
    for epoch in range(1, epochs + 1):
        merged = merge_states(train_assigned(packed, on_every_key(states, packed), optimizer))
        states = kept(_with_weights(states, merged), "states")
        if epoch % every == 0 or epoch == epochs:
            history.append(evaluate(packed if valid is None else valid, states).withColumn("epoch", F.lit(epoch)))
    return states, cut_lineage(reduce(DataFrame.unionByName, history))


def hop_schedule(models: DataFrame, n_models: int, partitions: Sequence[int], pad: bool = True) -> DataFrame:
    """Round robin (step, dist_key, place): the key at place i works at step s on model (s - i) mod M.

    ``models`` has (place, model_key). With fewer models than keys the missing ones are idle rows with a null model.
    """
    width = max(n_models, len(partitions)) if pad else n_models
    place = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: s)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("dist_key")) for i, p in enumerate(partitions)])
    frame = models.sparkSession.range(1).select(F.explode(place).alias("step")).select("step", F.explode(keys).alias("k"))
    slots = frame.select("step", "k.dist_key", F.pmod(F.col("step") - F.col("k.i"), F.lit(width)).alias("place"))
    return slots.join(models, "place", "left")


def schedule_by_place(models: DataFrame, partitions: int, width: int) -> DataFrame:
    """The same rotation computed from the model side: a row per (model, key) with its step.

    ``models`` has a ``place``; the model of place p meets the key of place i at step (p + i) mod width.
    """
    return models.withColumn("dist_key", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).withColumn(
        "step", F.pmod(F.col("place") + F.col("dist_key"), F.lit(width)))


def _places(states: DataFrame) -> tuple[DataFrame, int]:
    keys = sorted(r[0] for r in states.select("model_key").collect())  # a row per configuration
    return states.sparkSession.createDataFrame(list(enumerate(keys)), "place INT, model_key BIGINT"), len(keys)


def busy_keys(step: int, keys: Sequence[int], models: int) -> list[int]:
    """The keys that have a model at a step of ``hop_schedule``."""
    return [k for i, k in enumerate(keys) if (step - i) % max(models, len(keys)) < models]


def _hop(packed: DataFrame, states: DataFrame, epochs: int, optimizer: str,
         valid: DataFrame | None, with_jobs: bool, k: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """A step joins the states that work to the buffers of their keys alone, so an epoch reads a key once for each model."""
    keys = sorted(r[0] for r in packed.select("dist_key").distinct().collect())
    models, count = _places(states)
    schedule = hop_schedule(models, count, keys)
    states, jobs = kept(states, "states"), []
    for epoch in range(1, epochs + 1):
        for step in range(max(count, len(keys))):
            data = on_keys(packed, busy_keys(step, keys, count))
            now = schedule.where((F.col("step") == step) & F.col("model_key").isNotNull()).select("dist_key", "model_key")
            trained = train_assigned(data, states.join(now, "model_key"), optimizer)
            trained = kept(trained, "trained") if with_jobs else trained
            states = kept(_with_weights(states, trained), "states")
            if with_jobs:
                at, check = states.join(now, "model_key"), on_keys(valid, busy_keys(step, keys, count))
                jobs.append(kept(_job_rows(epoch, trained, score_assigned(data, at, k), score_assigned(check, at, k)), "jobs"))
    return states, jobs


def fit_model_hopper(packed: DataFrame, states: DataFrame, epochs: int, valid: DataFrame | None = None,
                     optimizer: str = "adam", steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Every model trains on every key once per epoch, one key after the other; a key has one model at a time.

    Returns the states and (epoch, model_key, loss, metric, n) after each epoch. With ``steps`` the states and the scores of each epoch are
    kept there, and a run that was stopped goes on after its last finished step; its key must stand for the data, the
    first states and the optimizer (``runs.fingerprint``). More epochs under the same key train on from the last.
    """
    history, checked = [], packed if valid is None else valid
    for epoch in range(1, epochs + 1):
        def train(before=states):
            return _hop(packed, before, 1, optimizer, None, False)[0]

        states = train() if steps is None else steps.run(f"states-{epoch}", train)

        def score(now=states, epoch=epoch):
            return evaluate(checked, now).withColumn("epoch", F.lit(epoch))

        history.append(score() if steps is None else steps.run(f"scores-{epoch}", score))
    return states, cut_lineage(reduce(DataFrame.unionByName, history))


def _job_rows(epoch: int, trained: DataFrame, on_train: DataFrame, on_valid: DataFrame) -> DataFrame:
    def side(scored: DataFrame, name: str) -> DataFrame:
        return scored.select("dist_key", "model_key", (F.col("sum_loss") / F.col("n")).alias(f"loss_{name}"),
                             (F.col("hits") / F.col("n")).alias(f"metric_{name}"), F.col("seconds").alias(f"seconds_{name}"))

    rows = trained.drop("w", "n").join(side(on_train, "train"), ["dist_key", "model_key"]).join(
        side(on_valid, "valid"), ["dist_key", "model_key"], "left")
    spent = F.col("init_time") + F.col("train_time") + F.col("seconds_train") + F.coalesce("seconds_valid", F.lit(0.0))
    return rows.select(
        F.lit("success").alias("status"), F.lit(epoch).alias("epoch"), "dist_key", "model_key",
        "loss_train", "metric_train", "loss_valid", "metric_valid", "start_time",
        F.timestamp_add("MICROSECOND", (spent * 1e6).cast("long"), F.col("start_time")).alias("end_time"),
        "init_time", "train_time",
        (F.col("seconds_train") + F.coalesce("seconds_valid", F.lit(0.0))).alias("valid_time"),
        F.lit(0.0).alias("exit_time"))


def fit_targeted(packed: DataFrame, states: DataFrame, key: int, valid: DataFrame, epoch: int = 1, k: int = 1,
                 optimizer: str = "adam") -> tuple[DataFrame, DataFrame]:
    """Train on one key, evaluate on that key of the training and the validation table: (states, job record)."""
    data, check = packed.where(F.col("dist_key") == key), valid.where(F.col("dist_key") == key)
    at = states.withColumn("dist_key", F.lit(key))
    trained = cut_lineage(train_assigned(data, at, optimizer))
    new = cut_lineage(_with_weights(states, trained))
    at = new.withColumn("dist_key", F.lit(key))
    return new, _job_rows(epoch, trained, score_assigned(data, at, k), score_assigned(check, at, k))


def fit_job_table(packed: DataFrame, states: DataFrame, epochs: int, valid: DataFrame, k: int = 1,
                  optimizer: str = "adam") -> tuple[DataFrame, DataFrame]:
    """All (model, key) pairs of every epoch, each once, with a job record each: (states, jobs)."""
    states, jobs = _hop(packed, states, epochs, optimizer, valid, True, k)
    return states, cut_lineage(reduce(DataFrame.unionByName, jobs))


def fit_task_parallel(packed: DataFrame, states: DataFrame, epochs: int, valid: DataFrame,
                      optimizer: str = "adam") -> tuple[DataFrame, DataFrame]:
    """Every trial on the whole data with its last validation loss: (states, (model_key, loss)).

    A trial visits the keys in turn and never gathers the table in one task.
    """
    states, history = fit_model_hopper(packed, states, epochs, valid, optimizer)
    return states, history.where(F.col("epoch") == epochs).select("model_key", "loss")


def _gathered(context: BarrierTaskContext, g: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The sums over all tasks of the stage. Each adds them in the order of the tasks, so all have the same."""
    parts = context.allGather(base64.b64encode(np.append(g, n).astype("<f8").tobytes()).decode() if n else "")
    total = np.zeros(len(g) + 1)
    for part in parts:
        if part:
            total += np.frombuffer(base64.b64decode(part), "<f8")
    return total[:-1], int(total[-1])


def _located(packed: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """Buffers with the positions of their first and last row in the key, dealt over tasks and in order of position; the rows of the largest key."""
    bounds = cut_lineage(_buffer_starts(packed, "dist_key", None).select("dist_key", "buffer_id", "_start", "_end"))
    rows = packed.join(bounds.hint("shuffle_hash"), ["dist_key", "buffer_id"]).select(
        "dist_key", "buffer_id", "_start", "_end", "independent_var", "dependent_var")
    dealt = rows.repartition(tasks, "dist_key").sortWithinPartitions("_start", "dist_key", "buffer_id")
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), bounds.agg(F.max("_end")).first()[0] or 0


def fit_synchronous(packed: DataFrame, layers: Sequence[int], w: np.ndarray, rate: float, penalty: float, steps: int,
                    batch: int | None = None, optimizer: str = "adam", tasks: int | None = None) -> np.ndarray:
    """Data-parallel descent: each step sums the gradients of all keys' current minibatches and updates once.

    ``batch`` is the total over keys; each key gives its next batch // keys rows a step, at last what it has left, and nothing more until
    all keys are through; then the next epoch begins. So an epoch visits every row once. Without ``batch`` a step uses all rows.

    An epoch is one barrier stage of ``tasks`` tasks (as many as the session's parallelism, if there are that many keys), which all run at once.
    They stream their buffers, exchange gradients with ``allGather`` after each step and make the same update, so nothing comes to the driver
    until an epoch ends. A lost task repeats the epoch. Weights, optimizer and one minibatch are in memory; a step moves tasks * tasks gradients.
    """
    ship_package(packed.sparkSession)
    keys = packed.select("dist_key").distinct().count()
    per_key = None if batch is None else batch // max(1, keys)
    if per_key == 0:
        raise ValueError("batch is smaller than the number of keys")
    state = learner.Optimizer(len(w), rate, penalty, optimizer)
    w, layers = np.asarray(w, dtype=np.float64), list(layers)
    tasks = min(tasks or packed.sparkSession.sparkContext.defaultParallelism, max(1, keys))
    located, most = _located(packed, tasks)
    width = most if per_key is None else per_key
    each_epoch = -(-most // width) if most else 0

    def epoch(w: np.ndarray, state: learner.Optimizer, steps: int) -> tuple[np.ndarray, learner.Optimizer]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, own, update = BarrierTaskContext.get(), w.copy(), copy.deepcopy(state)
            buffers = ((b.column("_start")[r].as_py(), _numbers(b.column("independent_var"), r), _numbers(b.column("dependent_var"), r))
                       for b in batches for r in range(b.num_rows))
            waiting, ahead = [], next(buffers, None)  # what the step doesn't reach, at most a buffer a key; the next buffer
            for step in range(steps):
                g, n, end, left = np.zeros(len(own)), 0, (step + 1) * width, []

                def use(start: int, x: np.ndarray, y: np.ndarray) -> None:
                    nonlocal g, n
                    cut = min(len(x), end - start)
                    if cut:
                        g = g + learner.gradient(own, layers, x[:cut], y[:cut])
                        n += cut
                    if cut < len(x):
                        left.append((start + cut, x[cut:], y[cut:]))
                for part in waiting:
                    use(*part)
                while ahead is not None and ahead[0] < end:
                    use(*ahead)
                    ahead = next(buffers, None)
                waiting = left
                g, n = _gathered(context, g, n)
                if n:
                    own = update.step(own, g / n)
            for _ in batches:  # an epoch cut short
                pass
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_pydict({"w": pa.array([own.tolist()], pa.list_(pa.float64())), "state": [pickle.dumps(update)]})

        row = located.drop("dist_key", "buffer_id", "_end").mapInArrow(run, "w ARRAY<DOUBLE>, state BINARY", barrier=True).collect()[0]
        return np.asarray(row["w"]), pickle.loads(row["state"])

    done = 0
    while done < steps and each_epoch:
        now = min(each_epoch, steps - done)
        w, state = epoch(w, state, now)
        done += now
    located.unpersist()
    return w.astype(np.float32)


def predict(df: DataFrame, layers: Sequence[int], w: Sequence[float], x: str = "x", name: str = "scores") -> DataFrame:
    """Add class scores; the weights go to each executor once."""
    spark = df.sparkSession
    ship_package(spark)
    sent, layers = spark.sparkContext.broadcast(np.asarray(w, dtype=np.float64)), list(layers)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(learner.scores(sent.value, layers, np.stack(column.to_list()).astype(np.float64))))

    return df.withColumn(name, run(x))


def stop_finished(states: DataFrame, epochs: int, history: str = "history") -> DataFrame:
    """Models whose history has all its epochs."""
    return states.where(F.size(history) >= epochs)


def epoch_dataset(df: DataFrame, seed: int, batch: int, epochs: int, key: str = "id",
                  blocks: int | None = None) -> DataFrame:
    """Rows shuffled by the seed, cut into batches, repeated for each epoch: adds (batch, epoch)."""
    from mselect.operators.ranking import _digest
    from mselect.operators.sequence import minibatch_index

    mixed = minibatch_index(df.withColumn("_o", _digest(seed, key)), batch, ["_o", key], blocks=blocks)
    return mixed.drop("_o").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))


def best_history(history: DataFrame) -> DataFrame:
    """All rows of the model with the lowest loss at its last epoch; ties go to the lowest key."""
    win = history.agg(F.min(F.struct((-F.col("epoch")).alias("e"), "loss", "model_key")).alias("b")).select("b.model_key")
    return history.join(F.broadcast(win), "model_key", "left_semi")


def fit_grid(df: DataFrame, space: Mapping, epochs: int, keys: int, buffer_size: int, validation_col: str | None = None,
             id: str = "id", x: str = "x", y: str = "y", optimizer: str = "adam") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every configuration of a space: (best model's history, all histories, states).

    The data are split (by a 0/1 column, or one row in ten), packed and placed once for all models.
    """
    from mselect.search.spaces import expand_grid

    if validation_col is None:
        df, validation_col = split_rows(df, keys=[id]), "validation"
    classes = class_table(df.where(F.col(validation_col) == 0), y)
    parts = [prepare(pack(df.where(F.col(validation_col) == v), buffer_size, keys, classes, id=id, x=x, y=y).drop("unseen"),
                     keys) for v in (0, 1)]
    inputs, n = data_shape(parts[0])
    states = init_states(expand_grid(df.sparkSession, space), inputs, n)
    states, history = fit_model_hopper(parts[0], states, epochs, parts[1], optimizer)
    for p in parts:
        p.unpersist()
    return best_history(history), history, states


