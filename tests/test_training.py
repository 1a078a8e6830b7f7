import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mselect.operators.ranking import sanity_head, single
from conftest import rows
from mselect.operators import packing as pack
from mselect.search import adaptive, spaces
from mselect.training import learner, loops

KEYS = 3


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) + np.eye(3, 4)[y] * 3
    return x.astype(np.float32), y


@pytest.fixture(scope="module")
def placed(spark, raw):
    x, y = raw
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(y))], "id bigint, x array<float>, y int")
    return loops.prepare(pack.pack(df, 16, KEYS, [0, 1, 2], dist=F.pmod("id", F.lit(KEYS))).drop("unseen"), KEYS)


def configs(spark, n, model="sanity"):
    return spark.createDataFrame([(i, 0.01 * (i + 1), 1e-4, 8, model) for i in range(n)],
                                 "ordinal int, learning_rate double, lambda_value double, batch_size int, model string")


def part(raw, k):
    x, y = raw
    return x[k::KEYS].astype(np.float64), np.eye(3)[y[k::KEYS]]


def fit_over(raw, w, layers, cfg, keys):
    """The same passes by hand, buffer by buffer."""
    for k in keys:
        x, y = part(raw, k)
        f = learner.Fit(w, layers, *cfg)
        for a in range(0, len(x), 16):
            f.see(x[a:a + 16], y[a:a + 16])
        w = f.w.astype(np.float32)
    return w


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    layers = [4, 5, 3]
    w = rng.normal(size=learner.parameter_count(layers))
    x, y = rng.normal(size=(6, 4)), np.eye(3)[rng.integers(0, 3, 6)]
    g = learner.gradient(w, layers, x, y)
    for i in range(0, len(w), 5):
        e = np.zeros_like(w)
        e[i] = 1e-6
        up, down = (learner.evaluate_rows(w + s * e, layers, x, y, 1)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_states_are_repeatable(spark):
    a = rows(loops.init_states(configs(spark, 3), 4, 3))
    assert a == rows(loops.init_states(configs(spark, 3).repartition(3), 4, 3))
    assert len(a[0][-1]) == learner.parameter_count([4, 10, 10, 3])
    with pytest.raises(NotImplementedError):
        loops.init_states(configs(spark, 1), 4, 3, warm_start=True)


def test_fit_step_streams_buffers_in_order(spark, placed, raw):
    states = loops.init_states(configs(spark, 1), 4, 3)
    w0 = np.array(states.first().w, dtype=np.float32)
    got = {r.dist_key: r.w for r in loops.fit_step(placed, states).collect()}
    for k in range(KEYS):
        want = fit_over(raw, w0, [4, 10, 10, 3], (0.01, 1e-4, 8), [k])
        assert np.allclose(got[k], want, atol=1e-6)


def test_averaging_is_the_weighted_mean(spark, placed, raw):
    states = loops.init_states(configs(spark, 2), 4, 3)
    w0 = np.array(states.first().w, dtype=np.float32)
    new, history = loops.fit_model_averaging(placed, states, 1)
    by_key = {r.model_key: np.array(r.w) for r in new.collect()}
    for m in range(2):
        each = [fit_over(raw, w0, [4, 10, 10, 3], (0.01 * (m + 1), 1e-4, 8), [k]) for k in range(KEYS)]
        n = [len(part(raw, k)[0]) for k in range(KEYS)]
        assert np.allclose(by_key[m], np.average(each, axis=0, weights=n), atol=1e-6)
    assert {r.n for r in history.collect()} == {240}


def test_large_vectors_merge_by_chunks(spark):
    a, b = np.arange(10000.0), np.ones(10000)
    df = spark.createDataFrame([(0, 0, 1, a.tolist()), (1, 0, 3, b.tolist()), (2, 0, 0, b.tolist())], "dist_key int, model_key bigint, n bigint, w array<float>")
    got = np.array(loops.merge_states(df).first().w)
    assert np.allclose(got, (a + 3 * b) / 4, rtol=1e-6)


@pytest.mark.parametrize("models", [2, 4])
def test_schedule_visits_every_pair_once(spark, models):
    m = spark.createDataFrame([(i, 100 + i) for i in range(models)], "place int, model_key bigint")
    got = loops.hop_schedule(m, models, [5, 6, 7])
    width = max(models, 3)
    assert got.count() == width * 3
    busy = got.where("model_key IS NOT NULL")
    assert rows(busy.select("model_key", "dist_key")) == sorted((100 + i, k) for i in range(models) for k in (5, 6, 7))
    assert busy.groupBy("step", "dist_key").count().where("count > 1").count() == 0
    assert busy.groupBy("step", "model_key").count().where("count > 1").count() == 0
    other = loops.schedule_by_place(m, 3, width).select("step", (F.col("dist_key") + 5).alias("dist_key"), "model_key")
    assert rows(other) == rows(busy.select("step", "dist_key", "model_key"))


def test_hopping_equals_sequential_training(spark, placed, raw):
    states = loops.init_states(configs(spark, 2), 4, 3)
    w0 = np.array(states.first().w, dtype=np.float32)
    new, history = loops.fit_model_hopper(placed, states, 1)
    for r in new.collect():
        order = sorted(range(KEYS), key=lambda i: (r.model_key + i) % KEYS)
        want = fit_over(raw, w0, [4, 10, 10, 3], (0.01 * (r.model_key + 1), 1e-4, 8), order)
        assert np.allclose(r.w, want, atol=1e-5)
    assert history.where("metric > 0.6").count() == 2


def test_job_table_has_every_pair(spark, placed):
    states = loops.init_states(configs(spark, 2), 4, 3)
    _, jobs = loops.fit_job_table(placed, states, 1, placed)
    got = jobs.collect()
    assert sorted((r.dist_key, r.model_key) for r in got) == [(k, m) for k in range(KEYS) for m in range(2)]
    assert all(r.loss_train == pytest.approx(r.loss_valid) and r.end_time >= r.start_time for r in got)


def test_synchronous_equals_single_machine(placed, raw):
    layers, batch = [4, 3], 24
    w = learner.initial_weights(layers)
    got = loops.fit_synchronous(placed, layers, w, 0.5, 0.0, 3, batch=batch, optimizer="sgd")
    want, per = w.astype(np.float64), batch // KEYS
    for s in range(3):
        parts = [part(raw, k) for k in range(KEYS)]
        x, y = (np.concatenate([p[j][s * per:(s + 1) * per] for p in parts]) for j in (0, 1))
        want = want - 0.5 * learner.gradient(want, layers, x, y) / len(x)
    assert np.allclose(got, want, atol=1e-6)


def plain_epochs(parts, w, layers, per, steps, optimizer):
    """Synchronous descent in one process: each part's next rows, at last what it has left."""
    update, epoch = learner.Optimizer(len(w), 0.05, 1e-4, optimizer), -(-max(len(y) for _, y in parts) // per)
    for s in range(steps):
        at = s % epoch * per
        x, y = (np.concatenate([p[j][at:at + per] for p in parts]) for j in (0, 1))
        w = update.step(w, learner.gradient(w, layers, x, y) / len(x))
    return w


@pytest.mark.parametrize("tasks,optimizer", [(None, "adam"), (1, "sgd"), (2, "adam")])
def test_synchronous_visits_every_row(spark, tasks, optimizer):
    """Keys of unlike sizes, buffers across minibatches, short last minibatches, several epochs and the optimizer's state between them."""
    rng = np.random.default_rng(2)
    sizes, layers = [41, 7, 23, 1, 40], [3, 4, 2]
    parts, rows_ = [], []
    for k, n in enumerate(sizes):
        x, y = rng.normal(size=(n, 3)).astype(np.float32).astype(np.float64), np.eye(2)[rng.integers(0, 2, n)]
        parts.append((x, y))
        for b, a in enumerate(range(0, n, 9)):
            rows_.append((k, b, x[a:a + 9].tolist(), y[a:a + 9].astype(int).tolist(), [len(x[a:a + 9]), 3], [len(x[a:a + 9]), 2]))
    kinds = "dist_key int, buffer_id int, independent_var array<array<float>>, dependent_var array<array<smallint>>, independent_var_shape array<int>, dependent_var_shape array<int>"
    packed = spark.createDataFrame(rows_, kinds)
    w = learner.initial_weights(layers).astype(np.float64)
    for batch, steps in ((5 * 6, 17), (5 * 100, 3), (None, 3)):
        got = loops.fit_synchronous(packed, layers, w, 0.05, 1e-4, steps, batch, optimizer, tasks)
        assert np.allclose(got, plain_epochs(parts, w, layers, 10**6 if batch is None else batch // 5, steps, optimizer), atol=1e-6)


def test_synchronous_without_rows(spark, placed):
    w = learner.initial_weights([4, 3])
    assert np.array_equal(loops.fit_synchronous(placed.limit(0), [4, 3], w, 0.1, 0.0, 5, 12), w)
    with pytest.raises(ValueError):
        loops.fit_synchronous(placed, [4, 3], w, 0.1, 0.0, 5, 1)


def test_a_step_reads_the_buckets_of_its_keys(spark, placed):
    data = loops.place(placed, KEYS)
    assert rows(data.select("dist_key", "buffer_id")) == rows(placed.select("dist_key", "buffer_id"))
    states = loops.kept(loops.init_states(configs(spark, 1), 4, 3))
    step = loops.train_assigned(loops.on_keys(data, [1]), states.withColumn("dist_key", F.lit(1)))
    plan = step._jdf.queryExecution().executedPlan().toString()
    chosen = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)
    assert chosen and all(c == ("1", str(KEYS)) for c in chosen)
    assert not [line for line in plan.splitlines() if "Exchange" in line and "independent_var" in line]
    assert {r.dist_key for r in step.collect()} == {1}


@pytest.mark.parametrize("models,keys", [(2, 5), (5, 2), (3, 3)])
def test_busy_keys(models, keys):
    """Every key is busy at one step for each model."""
    names, width = [10 * i for i in range(keys)], max(models, keys)
    busy = [loops.busy_keys(s, names, models) for s in range(width)]
    assert all(sum(k in b for b in busy) == models for k in names)


def test_hopping_over_buckets_equals_hopping_in_memory(spark, placed):
    states = loops.kept(loops.init_states(configs(spark, 2), 4, 3))
    a, b = (loops.fit_model_hopper(d, states, 1)[0].orderBy("model_key").collect() for d in (placed, loops.place(placed, KEYS)))
    assert [r.model_key for r in a] == [r.model_key for r in b] and all(np.allclose(x.w, y.w, atol=1e-6) for x, y in zip(a, b))


def test_training_does_not_shuffle_the_data_again(spark, placed):
    states = loops.init_states(configs(spark, 1), 4, 3)
    from mselect.session import cut_lineage

    plan = loops.train_assigned(placed, loops.on_every_key(cut_lineage(states), placed))._jdf.queryExecution().executedPlan().toString()
    above_cache = plan.split("InMemoryRelation")[0]
    assert "ShuffledHashJoin" in above_cache
    big = [line for line in above_cache.splitlines() if "Exchange" in line and "independent_var" in line]
    assert not big


def test_grid_reports_best(spark, raw):
    x, y = raw
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(y))], "id bigint, x array<float>, y int")
    space = {"learning_rate": [0.01, 1e-6], "lambda_value": [1e-4], "batch_size": [8], "model": ["sanity"]}
    best, history, _ = loops.fit_grid(df, space, 1, 2, 16)
    assert history.count() == 2 and best.count() == 1
    assert best.first().loss == history.agg(F.min("loss")).first()[0]


def test_grids(spark):
    assert spaces.choose_space(spark).count() == 16
    first = spaces.choose_space(spark).orderBy("ordinal").first()
    assert (first.model, first.batch_size, first.learning_rate, first.lambda_value) == ("resnet50", 32, 1e-4, 1e-4)
    mixed = spaces.choose_space(spark, "hetero")
    assert rows(mixed.groupBy("model", "batch_size").count()) == [("mobilenetv2", 128, 38), ("nasnetmobile", 4, 10)]
    assert spaces.choose_space(spark, "hetero_load").count() == 2
    with pytest.raises(ValueError):
        spaces.expand_hetero(spark, {**spaces.GRIDS["hetero"], "total": 47})
    assert spaces.choose_space(spark, "search").count() == 4
    assert spaces.choose_space(spark, "clicks").count() == 16
    assert spaces.choose_space(spark, "clicks_breakdown").count() == 8
    assert single(sanity_head(spaces.choose_space(spark, "scalability")), 3).count() == 1
    assert spaces.divide_batch(spaces.choose_space(spark, "best"), 8).first().batch_size == 4


def test_registry(spark):
    c = spaces.choose_space(spark, "hetero")
    arch = spaces.register_models(c)
    table = spaces.selection_table(c, arch)
    assert arch.count() == 2 and table.count() == 48 and table.agg(F.min("mst_key"), F.max("mst_key")).first() == (1, 48)
    assert spaces.get_arch_weights(arch, 1).count() == 1
    with pytest.raises(LookupError):
        spaces.get_arch_weights(arch, 3)


def test_proposals(spark):
    space = spaces.GRIDS["search"]
    drawn = adaptive.sample_space(spark, space, 200, 1)
    lo, hi, b0, b1 = drawn.agg(F.min("learning_rate"), F.max("learning_rate"), F.min("batch_size"), F.max("batch_size")).first()
    assert 1e-5 <= lo < 1e-4 and 1e-2 < hi <= 0.1 and 16 <= b0 < 30 and 240 < b1 <= 256
    # losses that favour one model and high rates pull proposals there
    trials = drawn.withColumn("loss", F.when(F.col("model") == "resnet34", 0.0).otherwise(5.0) - F.log("learning_rate"))
    got = adaptive.suggest_next(trials, space, 8, 1, 200).collect()
    assert [r.trial_id for r in sorted(got)] == list(range(200, 208))
    assert all(r.model == "resnet34" for r in got) and np.median([r.learning_rate for r in got]) > 1e-2
    assert rows(adaptive.suggest_next(trials.limit(0), space, 4, 1, 9)) == rows(adaptive.sample_space(spark, space, 4, 1, 9))


def test_search_loop(spark, placed):
    space = {"learning_rate": [0.001, 0.1], "lambda_value": [1e-4, 1e-6], "batch_size": [8, 32], "model": ["sanity", "logistic"]}
    got = adaptive.search(spark, space, adaptive.hopper_trainer(placed, placed, 1), 3, 2).collect()
    assert sorted(r.trial_id for r in got) == [0, 1, 2] and all(r.loss > 0 for r in got)
    assert sorted(r.batch for r in got) == [0, 0, 1]
