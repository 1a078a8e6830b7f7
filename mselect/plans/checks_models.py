"""Checked queries: packing, configurations, training, search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mselect.functions.features import argmax
from mselect.operators import packing as pack
from mselect.operators.aggregates import ordered_values
from mselect.plans.base import query, table
from mselect.search import adaptive, spaces
from mselect.session import cut_lineage
from mselect.training import learner, loops

KEYS, BUFFER, CLASSES = 8, 32, 10


def examples(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))


def packed(spark, d, buffer=BUFFER, keys=KEYS):
    return pack.pack_train(examples(spark, d), buffer, keys, dist=F.pmod("id", F.lit(keys)))[0]


_PACK_SQL = (f"r AS (SELECT vec_id AS id, label AS y, embedding AS x, vec_id % {KEYS} AS dist_key, "
             f"(row_number() OVER (PARTITION BY vec_id % {KEYS} ORDER BY vec_id) - 1) AS pos FROM embeddings), "
             f"p AS (SELECT *, pos // {BUFFER} AS buffer_id, pos % {BUFFER} AS off FROM r)")


# ---- packing

@query(f"WITH {_PACK_SQL} SELECT dist_key, buffer_id, count(*) AS n, 64 AS width, sum(CAST(y = 3 AS INT)) AS threes, "
       "round(sum(CAST(x[5] AS DOUBLE)), 6) AS total FROM p GROUP BY dist_key, buffer_id")
def pack_train(spark, d):
    threes = F.aggregate("dependent_var", F.lit(0), lambda a, v: a + v[3])
    total = F.aggregate("independent_var", F.lit(0.0), lambda a, v: a + v[4].cast("double"))
    return packed(spark, d).select("dist_key", "buffer_id", F.col("independent_var_shape")[0].alias("n"),
                                   F.col("independent_var_shape")[1].alias("width"), threes.alias("threes"), F.round(total, 6).alias("total"))


@query(f"WITH {_PACK_SQL} SELECT dist_key, buffer_id, count(*) AS n, sum(CAST(y NOT IN (0, 1, 2, 3, 4) AS INT)) AS unseen, "
       "sum(CAST(y = 2 AS INT)) AS twos FROM p GROUP BY dist_key, buffer_id")
def pack_valid(spark, d):
    e = examples(spark, d)
    _, summary = pack.pack_train(e.where("y < 5"), BUFFER, KEYS)
    v = pack.pack_valid(e, summary, BUFFER, KEYS, dist=F.pmod("id", F.lit(KEYS)))
    return v.select("dist_key", "buffer_id", F.col("dependent_var_shape")[0].alias("n"), "unseen",
                    F.aggregate("dependent_var", F.lit(0), lambda a, r: a + r[2]).alias("twos"))


@query(f"WITH {_PACK_SQL} SELECT dist_key, buffer_id, off AS \"offset\", y, CAST(x[1] AS DOUBLE) AS first FROM p")
def unpack(spark, d):
    return pack.unpack(packed(spark, d)).select("dist_key", "buffer_id", "offset", argmax("y").alias("y"), F.col("x")[0].cast("double").alias("first"))


@query(f"WITH {_PACK_SQL}, t AS (SELECT dist_key, count(*) AS n FROM p GROUP BY 1) SELECT p.dist_key, i, buffer_id, off AS \"offset\" FROM p JOIN t USING (dist_key), "
       "range((SELECT max(n) + 40 FROM t)) g(i) WHERE i % n = pos")
def flat_index(spark, d):
    p = packed(spark, d)
    longest = p.groupBy("dist_key").agg(F.sum(F.col("dependent_var_shape")[0]).alias("n")).agg(F.max("n")).first()[0]
    return pack.flat_index(p, longest + 40)


@query(f"WITH {_PACK_SQL}, t AS (SELECT dist_key, count(*) AS n FROM p GROUP BY 1), a AS (SELECT event_id, user_id % 11 AS dist_key, event_id * 7919 + user_id AS i FROM events) "
       "SELECT event_id, a.dist_key, i, buffer_id, off AS \"offset\" FROM a LEFT JOIN t USING (dist_key) LEFT JOIN p ON p.dist_key = a.dist_key AND p.pos = i % n")
def locate(spark, d):
    asked = table(spark, d, "events").selectExpr("event_id", "CAST(user_id % 11 AS INT) AS dist_key", "event_id * 7919 + user_id AS i")
    return pack.locate(asked, packed(spark, d), wrap=True)


@query(f"WITH {_PACK_SQL} SELECT dist_key, buffer_id, concat(count(*), ',64') AS xs, concat(count(*), ',10') AS ys FROM p GROUP BY dist_key, buffer_id")
def buffer_shapes(spark, d):
    return pack.buffer_shapes(packed(spark, d)).select("dist_key", "buffer_id", F.array_join("independent_var_shape", ",").alias("xs"),
                                                       F.array_join("dependent_var_shape", ",").alias("ys"))


@query(f"WITH {_PACK_SQL} SELECT dist_key, buffer_id, count(*) * 256 AS x_bytes, count(*) * 20 AS y_bytes, round(sum(CAST(x[64] AS DOUBLE)), 6) AS total, "
       "sum(CAST(y = 3 AS INT)) AS threes FROM p GROUP BY dist_key, buffer_id")
def to_bytes(spark, d):
    raw = packed(spark, d).select("dist_key", "buffer_id", "independent_var_shape", "dependent_var_shape",
                                  pack.to_bytes("independent_var").alias("xb"), pack.to_bytes("dependent_var", "int16").alias("yb"))
    # stored before it is read back, as byte buffers are
    back = cut_lineage(raw).withColumn("x", pack.from_bytes("xb", "independent_var_shape")).withColumn("y", pack.from_bytes("yb", "dependent_var_shape", "int16"))
    return back.select("dist_key", "buffer_id", F.length("xb").alias("x_bytes"), F.length("yb").alias("y_bytes"),
                       F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v[63].cast("double")), 6).alias("total"),
                       F.aggregate("y", F.lit(0), lambda a, v: a + v[3]).alias("threes"))


@query("SELECT vec_id % 8 AS dist_key, count(*) AS rows FROM embeddings GROUP BY 1")
def rows_per_key(spark, d):
    from mselect.operators.aggregates import rows_per_key as op

    return op(packed(spark, d))


@query("SELECT doc_id AS id, md5(text) AS digest, (length(text) - 1) // 100 + 1 AS chunks, 1 AS ok FROM documents WHERE lang = 'en' AND length(text) > 0")
def reassemble_chunks(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 0")
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 100).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.transform(places, lambda i: F.substring(F.col("text"), i * 100 + 1, F.lit(100)))).alias("seq", "data"))
    pointers = docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.length("text").alias("total"))
    out = pack.reassemble_chunks(chunks, pointers, 100)
    return out.select("id", F.md5("data").alias("digest"), "chunks", F.col("ok").cast("int").alias("ok"))


@query("SELECT DISTINCT user_id AS worker, p AS partition FROM events, range(8) t(p) WHERE (user_id + p) % 3 = 0")
def placement(spark, d):
    workers = table(spark, d, "events").select(F.col("user_id").alias("worker")).distinct()
    matrix = workers.withColumn("available", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: ((F.col("worker") + p) % 3 == 0).cast("int")))
    return pack.placement(matrix)


_PHASE = "CASE event_type WHEN 'view' THEN 'train_valid' WHEN 'click' THEN 'idle' WHEN 'error' THEN 'initialization' WHEN 'signup' THEN 'exiting' ELSE 'data_transmission' END"


@query(f"WITH e AS (SELECT user_id AS worker, {_PHASE} AS phase, value FROM events) SELECT worker, round(coalesce(sum(value) FILTER (phase IN ('train_valid', "
       "'initialization', 'exiting')), 0), 4) AS train_valid, round(coalesce(sum(value) FILTER (phase = 'idle'), 0), 4) AS idle, "
       "round(coalesce(sum(value) FILTER (phase = 'data_transmission'), 0), 4) AS data_transmission, 0.0 AS model_hopping, 0.0 AS merge FROM e GROUP BY 1")
def pivot_phases(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id AS worker", f"{_PHASE} AS phase", "value AS seconds")
    out = pack.pivot_phases(rows, ["worker"])
    return out.select("worker", *[F.round(c, 4).alias(c) for c in ("train_valid", "idle", "data_transmission", "model_hopping", "merge")])


@query("SELECT CAST(user_id AS VARCHAR) AS model_key, CAST(event_id % 5 AS INT) AS epoch, value AS loss_valid FROM events")
def jobs_from_models(spark, d):
    job = F.struct((F.col("event_id") % 5).cast("int").alias("epoch"), F.col("value").alias("loss_valid"))
    models = table(spark, d, "events").select(F.create_map(F.col("user_id").cast("string"), F.array(job)).alias("jobs"))
    return pack.jobs_from_models(models)


# ---- configurations and registry; spaces come out of the tables

_SPACE = ("(SELECT DISTINCT l_discount AS learning_rate FROM lineitem), (SELECT DISTINCT l_tax AS lambda_value FROM lineitem), "
          "(SELECT DISTINCT CAST(l_linenumber * 32 AS INT) AS batch_size FROM lineitem), (SELECT DISTINCT l_returnflag AS model FROM lineitem)")


def _space(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.sort_array(F.collect_set("l_discount")).alias("learning_rate"), F.sort_array(F.collect_set("l_tax")).alias("lambda_value"),
                  F.sort_array(F.collect_set(F.col("l_linenumber") * 32)).alias("batch_size"), F.sort_array(F.collect_set("l_returnflag")).alias("model"))


@query(f"SELECT row_number() OVER (ORDER BY learning_rate, lambda_value, batch_size, model) - 1 AS ordinal, * FROM {_SPACE}")
def expand_grid(spark, d):
    return spaces.explode_grid(_space(spark, d))


@query("WITH v AS (SELECT min(l_discount) AS lr0, min(l_tax) AS t0, (SELECT min(l_discount) FROM lineitem WHERE l_discount > (SELECT min(l_discount) FROM lineitem)) AS lr1, "
       "(SELECT min(l_tax) FROM lineitem WHERE l_tax > (SELECT min(l_tax) FROM lineitem)) AS t1 FROM lineitem) SELECT i AS ordinal, CASE WHEN i < 38 THEN lr1 ELSE lr0 END AS learning_rate, "
       "CASE WHEN i < 38 THEN t1 ELSE t0 END AS lambda_value, CASE WHEN i < 38 THEN 64 ELSE 32 END AS batch_size, CASE WHEN i < 38 THEN 'N' ELSE 'A' END AS model FROM v, range(48) t(i)")
def expand_hetero(spark, d):
    return spaces.zip_space(_space(spark, d), 38, 10)


def _table_configs(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_discount").alias("learning_rate"), F.col("l_tax").alias("lambda_value"), (F.col("l_linenumber") * 32).alias("batch_size"),
        F.col("l_returnflag").alias("model")).distinct()


_LABEL = "concat('learning_rate:', l_discount, ',lambda_value:', l_tax, ',batch_size:', l_linenumber * 32, ',model:', l_returnflag)"


@query(f"SELECT row_number() OVER (ORDER BY name) AS model_id, name, description FROM (SELECT DISTINCT {_LABEL} AS name, l_returnflag AS description FROM lineitem)")
def register_models(spark, d):
    return spaces.register_models(_table_configs(spark, d)).select("model_id", "name", "description")


@query(f"WITH c AS (SELECT DISTINCT {_LABEL} AS name, l_linenumber * 32 AS b FROM lineitem), a AS (SELECT name, b, row_number() OVER (ORDER BY name) AS model_id FROM c) "
       "SELECT row_number() OVER (ORDER BY name, k) AS mst_key, model_id, concat('{\"batch_size\":', b, ',\"epochs\":1}') AS fit_params FROM a, range(2) t(k)")
def selection_table(spark, d):
    c = _table_configs(spark, d)
    arch = spaces.register_models(c)
    twice = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "ordinal", F.struct(spaces.config_label(spaces.config_struct()).alias("name"), "k"))
    return spaces.selection_table(twice, arch).select("mst_key", "model_id", "fit_params")


_U = "CAST('0x' || substr(md5(concat('7|', event_id, '|{}')), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT event_id, round(exp(ln(0.00001) + (ln(0.1) - ln(0.00001)) * {_U.format('learning_rate')}), 9) AS learning_rate, "
       f"CASE WHEN floor({_U.format('lambda_value')} * 2) = 0 THEN 0.0001 ELSE 0.000001 END AS lambda_value, CAST(floor({_U.format('batch_size')} * 241) AS INT) + 16 AS batch_size, "
       f"CASE WHEN floor({_U.format('model')} * 2) = 0 THEN 'resnet18' ELSE 'resnet34' END AS model FROM events")
def sample_space(spark, d):
    out = adaptive.draw(table(spark, d, "events").select("event_id"), spaces.GRIDS["search"], 7, "event_id")
    return out.withColumn("learning_rate", F.round("learning_rate", 9))


def _draw_sql(seed: int, key: str) -> str:
    """The drawn fields of a row; the learning rate as its logarithm."""
    u = "CAST('0x' || substr(md5(concat('{}|', {}, '|{}')), 1, 8) AS BIGINT) / 4294967296.0"
    return (f"ln(0.00001) + (ln(0.1) - ln(0.00001)) * {u.format(seed, key, 'learning_rate')} AS lr, CAST(floor({u.format(seed, key, 'lambda_value')} * 2) AS INT) AS l, "
            f"CAST(floor({u.format(seed, key, 'batch_size')} * 241) AS INT) + 16 AS b, CAST(floor({u.format(seed, key, 'model')} * 2) AS INT) AS m")


_LO, _WIDE = "ln(0.00001)", "(ln(0.1) - ln(0.00001))"
_BINS = (f"greatest(0, least(63, CAST(floor((lr - {_LO}) / {_WIDE} * 64) AS INT))) AS lr_bin, greatest(0, least(63, CAST(floor((b - 16) / 240.0 * 64) AS INT))) AS b_bin")


def _suggest_sql(proposals: int) -> str:
    """Parzen estimates over binned trials, all in log form."""
    def kernel(field: str, wide: str) -> str:
        bump = f"exp(-0.5 * pow((k.i - t.{field}) * {wide} / 64 / width, 2))"
        return (f"{field}_d AS (SELECT good, k.i, ln((sum(n * {bump}) + any_value(width) / {wide}) / (any_value(width) * (any_value(total) + 1))) AS d FROM (SELECT good, {field}, count(*) AS n "
                f"FROM trials GROUP BY ALL) t JOIN (SELECT good, total, {wide} / (1 + sqrt(total)) AS width FROM totals) USING (good), range(64) k(i) GROUP BY good, k.i)")

    def share(field: str) -> str:
        return (f"{field}_d AS (SELECT good, i, ln((1 + count(*) FILTER (WHERE {field} = i)) / (2.0 + count(*))) AS d FROM trials, range(2) k(i) GROUP BY good, i)")
    ratios = ", ".join(f"{f}_r AS (SELECT g.i, g.d - h.d AS r FROM {f}_d g JOIN {f}_d h ON g.i = h.i WHERE g.good AND NOT h.good)" for f in ("lr_bin", "b_bin", "l", "m"))
    return (f"WITH drawn AS (SELECT event_id, value, {_draw_sql(3, 'event_id')} FROM events), "
            f"trials AS (SELECT {_BINS}, l, m, row_number() OVER (ORDER BY value, event_id) <= ceil(0.25 * count(*) OVER ()) AS good FROM drawn), "
            f"totals AS (SELECT good, count(*) AS total FROM trials GROUP BY 1), {kernel('lr_bin', _WIDE)}, {kernel('b_bin', '240.0')}, {share('l')}, {share('m')}, {ratios}, "
            f"pool AS (SELECT trial_id, c, {_draw_sql(2018, chr(39) + chr(39) + ' || trial_id || ' + chr(39) + '#' + chr(39) + ' || c')} FROM range(1000000000, {1_000_000_000 + proposals}) p(trial_id), range(24) q(c)), "
            f"placed AS (SELECT trial_id, c, lr, l, b, m, {_BINS} FROM pool), "
            "scored AS (SELECT p.*, lr_bin_r.r + b_bin_r.r + l_r.r + m_r.r AS s FROM placed p JOIN lr_bin_r ON lr_bin_r.i = p.lr_bin JOIN b_bin_r ON b_bin_r.i = p.b_bin "
            "JOIN l_r ON l_r.i = p.l JOIN m_r ON m_r.i = p.m), "
            "best AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY round(s, 9) DESC, c) AS rank FROM scored) "
            "SELECT trial_id, round(exp(lr), 9) AS learning_rate, CASE WHEN l = 0 THEN 0.0001 ELSE 0.000001 END AS lambda_value, b AS batch_size, "
            "CASE WHEN m = 0 THEN 'resnet18' ELSE 'resnet34' END AS model FROM best WHERE rank = 1")


@query(_suggest_sql(64))
def suggest_next(spark, d):
    """Proposals after a trial for every event."""
    losses = table(spark, d, "events").select(F.col("event_id").alias("trial_id"), F.col("value").alias("loss"))
    trials = adaptive.draw(losses, spaces.GRIDS["search"], 3)
    out = adaptive.suggest_next(trials, spaces.GRIDS["search"], 64, 2018, 1_000_000_000)
    return out.withColumn("learning_rate", F.round("learning_rate", 9))


@query("WITH m AS (SELECT user_id AS trial_id, event_id % 5 AS e, avg(sqrt(value)) AS l FROM events WHERE user_id % 10 <> 0 GROUP BY ALL) SELECT t.trial_id, round(max_by(l, e), 6) AS loss "
       "FROM (SELECT DISTINCT user_id AS trial_id FROM events) t LEFT JOIN m USING (trial_id) GROUP BY 1")
def record_losses(spark, d):
    e = table(spark, d, "events")
    trials = e.select(F.col("user_id").alias("trial_id")).distinct()
    rows = e.where("user_id % 10 <> 0").select(F.col("user_id").alias("trial_id"), (F.col("event_id") % 5).alias("epoch"), (F.sqrt("value")).alias("loss_valid"))
    return adaptive.record_losses(trials, rows).withColumn("loss", F.round("loss", 6))


# ---- training; a network without hidden layers and one plain step per key can be followed in SQL

RATE = 4.0


def _states(spark, n=1, model="logistic", batch=1_000_000, inputs=64, rate=RATE):
    rows = [(i, rate / (i + 1), 0.0, batch, model) for i in range(n)]
    configs = spark.createDataFrame(rows, "ordinal INT, learning_rate DOUBLE, lambda_value DOUBLE, batch_size INT, model STRING")
    return loops.init_states(configs, inputs, CLASSES)


def _big_buffers(spark, d, keys):
    """One buffer per key, so that a key is one plain step."""
    e = examples(spark, d)
    return loops.prepare(pack.pack_train(e, 1_000_000, keys, dist=F.pmod("id", F.lit(keys)))[0], keys)


_CELLS = ("cells AS (SELECT vec_id, label, i - 1 AS j, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i) UNION ALL "
          "SELECT vec_id, label, 64, 1.0 FROM embeddings)")
# step 0 gradient of softmax regression from zero weights; place j * 10 + c, offsets last
_STEP = (f"{_CELLS}, step AS (SELECT {{key}} AS k, j, c, {RATE} * avg((CAST(label = c AS INT) - 0.1) * v) AS w, count(*) AS n FROM cells, range(10) t(c) GROUP BY 1, 2, 3)")


def _flat(df, name="w"):
    return df.select(*[c for c in df.columns if c != name], F.posexplode(name).alias("pos", name)).withColumn(name, F.round(F.col(name).cast("double"), 4))


@query(f"WITH {_STEP.format(key='vec_id % 4')} SELECT k AS dist_key, n, j * 10 + c AS pos, round(w, 4) AS w FROM step")
def fit_step(spark, d):
    return _flat(loops.fit_step(_big_buffers(spark, d, 4), _states(spark), optimizer="sgd").select("dist_key", "n", "w"))


@query(f"WITH {_STEP.format(key='0')} SELECT j * 10 + c AS pos, round(w, 4) AS w FROM step")
def fit_model_averaging(spark, d):
    states, _ = loops.fit_model_averaging(_big_buffers(spark, d, 4), _states(spark), 1, optimizer="sgd")
    return _flat(states.select("w"))


@query(f"WITH {_STEP.format(key='0')} SELECT j * 10 + c AS pos, round(w, 4) AS w FROM step")
def fit_synchronous(spark, d):
    layers = learner.layer_sizes("logistic", 64, CLASSES)
    data = loops.prepare(packed(spark, d), KEYS)
    w = loops.fit_synchronous(data, layers, learner.initial_weights(layers), RATE, 0.0, 1, optimizer="sgd")
    return _flat(spark.createDataFrame([(w.tolist(),)], "w ARRAY<FLOAT>"))


def _batch_sql(keys: int, per_key: int, steps: int) -> str:
    """Plain steps over each key's next ``per_key`` rows, at last what it has left, step by step."""
    parts = [_CELLS, f"place AS (SELECT vec_id, (row_number() OVER (PARTITION BY vec_id % {keys} ORDER BY vec_id) - 1) // {per_key} AS s FROM embeddings)",
             "epoch AS (SELECT max(s) + 1 AS e FROM place)", "w0 AS (SELECT j, c, 0.0::DOUBLE AS w FROM range(65) b(j), range(10) g(c))"]
    for s in range(steps):
        parts += [
            f"z{s} AS (SELECT vec_id, c, sum(v * w) AS z FROM cells JOIN w{s} USING (j) JOIN place USING (vec_id), epoch WHERE s = {s} % e GROUP BY ALL)",
            f"p{s} AS (SELECT vec_id, c, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z{s})",
            f"g{s} AS (SELECT j, c, avg((CAST(label = c AS INT) - p) * v) AS g FROM p{s} JOIN cells USING (vec_id) GROUP BY ALL)",
            f"w{s + 1} AS (SELECT j, c, w + {RATE} * g AS w FROM w{s} JOIN g{s} USING (j, c))",
        ]
    return f"WITH {', '.join(parts)} SELECT j * 10 + c AS pos, round(w, 4) AS w FROM w{steps}"


@query(_batch_sql(KEYS, 20, 6))
def fit_synchronous_batches(spark, d):
    layers = learner.layer_sizes("logistic", 64, CLASSES)
    w = loops.fit_synchronous(packed(spark, d), layers, learner.initial_weights(layers), RATE, 0.0, 6, batch=20 * KEYS, optimizer="sgd")
    return _flat(spark.createDataFrame([(w.tolist(),)], "w ARRAY<FLOAT>"))


_SCORES = ("s AS (SELECT vec_id, label, c, sum(v * w) AS z FROM cells JOIN {w} USING (j) GROUP BY ALL), "
           "q AS (SELECT vec_id, label, c, z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lp, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, c) AS r FROM s)")


@query(f"WITH {_STEP.format(key='0')}, {_SCORES.format(w='step')} SELECT round(-avg(lp), 4) AS loss, round(avg(CAST(r = 1 AS INT)), 4) AS metric, count(*) AS n "
       "FROM q WHERE c = label")
def evaluate(spark, d):
    data = _big_buffers(spark, d, 4)
    _, history = loops.fit_model_averaging(data, _states(spark), 1, optimizer="sgd")
    return history.select(F.round("loss", 4).alias("loss"), F.round("metric", 4).alias("metric"), "n")


@query(f"WITH {_STEP.format(key='0')}, {_SCORES.format(w='step')} SELECT vec_id AS id, c AS best, round(exp(lp), 4) AS score FROM q WHERE r = 1")
def predict(spark, d):
    layers = learner.layer_sizes("logistic", 64, CLASSES)
    data = loops.prepare(packed(spark, d), KEYS)
    w = loops.fit_synchronous(data, layers, learner.initial_weights(layers), RATE, 0.0, 1, optimizer="sgd")
    out = loops.predict(examples(spark, d), layers, w)
    return out.select("id", argmax("scores").alias("best"), F.round(F.array_max("scores"), 4).alias("score"))


def _hop_sql(models: int, keys: int) -> str:
    """Each model's plain steps over the keys in schedule order, written out step by step."""
    width, parts = max(models, keys), [_CELLS]
    parts.append("w0 AS (SELECT m, j, c, 0.0::DOUBLE AS w FROM range({}) a(m), range(65) b(j), range(10) g(c))".format(models))
    for s in range(width):
        # at step s the key of place i has model (s - i) mod width
        on = " OR ".join(f"(m = {(s - i) % width} AND vec_id % {keys} = {i})" for i in range(keys) if (s - i) % width < models) or "false"
        parts += [
            f"z{s} AS (SELECT m, vec_id, c, sum(v * w) AS z FROM cells JOIN w{s} USING (j) WHERE {on} GROUP BY ALL)",
            f"p{s} AS (SELECT m, vec_id, c, exp(z) / sum(exp(z)) OVER (PARTITION BY m, vec_id) AS p FROM z{s})",
            f"g{s} AS (SELECT m, j, c, avg((CAST(label = c AS INT) - p) * v) AS g FROM p{s} JOIN cells USING (vec_id) GROUP BY ALL)",
            f"w{s + 1} AS (SELECT m, j, c, w + coalesce({RATE} / (m + 1) * g, 0) AS w FROM w{s} LEFT JOIN g{s} USING (m, j, c))",
        ]
    return f"WITH {', '.join(parts)} SELECT m AS model_key, j * 10 + c AS pos, round(w, 4) AS w FROM w{width}"


@query(_hop_sql(2, 3))
def fit_model_hopper(spark, d):
    data = loops.place(pack.pack_train(examples(spark, d), 1_000_000, 3, dist=F.pmod("id", F.lit(3)))[0], 3)
    states, _ = loops.fit_model_hopper(data, _states(spark, 2), 1, optimizer="sgd")
    return _flat(states.select("model_key", "w"))


@query(_hop_sql(2, 3))
def resumed_hopper(spark, d):
    """The same run, its first epoch finished under its key by an earlier call, so that the second call only reads its steps."""
    from mselect.session import ensure_checkpoint_dir
    from mselect.sources.runs import Steps, fingerprint

    source = table(spark, d, "embeddings")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
    data = loops.place(pack.pack_train(examples(spark, d), 1_000_000, 3, dist=F.pmod("id", F.lit(3)))[0], 3)
    for _ in range(2):
        states, _ = loops.fit_model_hopper(data, _states(spark, 2), 1, optimizer="sgd", steps=Steps(spark, path, fingerprint(source, models=2, keys=3)))
    return _flat(states.select("model_key", "w"))


@query("SELECT DISTINCT 'success' AS status, e AS epoch, vec_id % 3 AS dist_key, m AS model_key, true AS done FROM embeddings, range(1, 3) t(e), range(2) s(m)")
def fit_job_table(spark, d):
    data = loops.place(packed(spark, d, keys=3), 3)
    _, jobs = loops.fit_job_table(data, _states(spark, 2, "sanity", 32, rate=0.01), 2, data)
    done = F.col("loss_train").isNotNull() & F.col("loss_valid").isNotNull() & (F.col("end_time") >= F.col("start_time"))
    return jobs.select("status", "epoch", "dist_key", "model_key", done.alias("done"))


@query("SELECT 0 AS model_key, 1 AS dist_key, count(*) AS n, true AS done FROM embeddings WHERE vec_id % 3 = 1")
def fit_targeted(spark, d):
    data = loops.prepare(packed(spark, d, keys=3), 3)
    _, job = loops.fit_targeted(data, _states(spark, 1, "sanity", 32, rate=0.01), 1, data)
    n = data.where("dist_key = 1").agg(F.sum(F.col("dependent_var_shape")[0]).alias("n"), F.lit(1).alias("dist_key"))
    return job.join(n, "dist_key").select("model_key", "dist_key", "n", F.col("loss_valid").isNotNull().alias("done"))


def _trial_sql(models: int, keys: int) -> str:
    """Loss of each model over all rows after ``_hop_sql``."""
    steps, width = _hop_sql(models, keys).rsplit(" SELECT m AS model_key", 1)[0], max(models, keys)
    return (f"{steps}, z AS (SELECT m, vec_id, label, c, sum(v * w) AS z FROM cells JOIN w{width} USING (j) GROUP BY ALL), "
            "q AS (SELECT m, label, c, z - ln(sum(exp(z)) OVER (PARTITION BY m, vec_id)) AS lp FROM z) "
            "SELECT m AS model_key, round(-avg(lp), 4) AS loss FROM q WHERE c = label GROUP BY m")


@query(_trial_sql(2, 3))
def fit_task_parallel(spark, d):
    data = loops.place(pack.pack_train(examples(spark, d), 1_000_000, 3, dist=F.pmod("id", F.lit(3)))[0], 3)
    out = loops.fit_task_parallel(data, _states(spark, 2), 1, data, optimizer="sgd")[1]
    return out.select("model_key", F.round("loss", 4).alias("loss"))


_RATES = [4.0, 2.0, 0.5]


@query(f"WITH {_CELLS}, r AS (SELECT i - 1 AS m, list_extract({_RATES}, i) AS rate FROM range(1, {len(_RATES) + 1}) t(i)), "
       "step AS (SELECT m, j, c, rate * avg((CAST(label = c AS INT) - 0.1) * v) AS w FROM cells, range(10) t(c), r WHERE vec_id % 4 <> 1 GROUP BY m, rate, j, c), "
       "z AS (SELECT m, vec_id, label, c, sum(v * w) AS z FROM cells JOIN step USING (j) WHERE vec_id % 4 = 1 GROUP BY ALL), "
       "q AS (SELECT m, vec_id, label, c, z - ln(sum(exp(z)) OVER (PARTITION BY m, vec_id)) AS lp, row_number() OVER (PARTITION BY m, vec_id ORDER BY z DESC, c) AS r FROM z) "
       "SELECT rate, 1 AS epoch, round(-avg(lp), 4) AS loss, round(avg(CAST(q.r = 1 AS INT)), 4) AS metric, count(*) AS n FROM q JOIN r USING (m) WHERE c = label GROUP BY rate")
def fit_grid(spark, d):
    """A grid over the learning rate, fitted on three rows of four and judged on the others."""
    space = {"learning_rate": _RATES, "lambda_value": [0.0], "batch_size": [1_000_000], "model": ["logistic"]}
    df = examples(spark, d).withColumn("held", (F.col("id") % 4 == 1).cast("int"))
    _, history, states = loops.fit_grid(df, space, 1, 1, 1_000_000, "held", optimizer="sgd")
    named = history.join(states.select("model_key", F.col("learning_rate").alias("rate")), "model_key")
    return named.select("rate", "epoch", F.round("loss", 4).alias("loss"), F.round("metric", 4).alias("metric"), "n")


@query()
def search(spark, d):
    data = loops.prepare(packed(spark, d, keys=2), 2)
    space = {"learning_rate": [0.001, 0.1], "lambda_value": [1e-4, 1e-6], "batch_size": [16, 64], "model": ["sanity", "logistic"]}
    return adaptive.search(spark, space, adaptive.hopper_trainer(data, data, 1), 4, 2)


@query("WITH m AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS place, user_id AS model_key FROM (SELECT DISTINCT user_id FROM events)) SELECT place, model_key, k AS dist_key, "
       "(place + k) % greatest(8, (SELECT count(*) FROM m)) AS step FROM m, range(8) t(k)")
def hop_schedule(spark, d):
    from mselect.operators.sequence import Ordered

    users = table(spark, d, "events").select(F.col("user_id").alias("model_key")).distinct()
    models = Ordered(users, [], ["model_key"]).position("place").done()
    return loops.schedule_by_place(models, 8, max(8, users.count()))


@query("SELECT user_id AS model_key, count(DISTINCT event_id % 40) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 40) >= 34")
def stop_finished(spark, d):
    epochs = table(spark, d, "events").groupBy(F.col("user_id").alias("model_key"), (F.col("event_id") % 40).alias("e")).agg(F.avg("value").alias("v"))
    states = ordered_values(epochs, ["model_key"], "e", "v", "history")
    return loops.stop_finished(states, 34).select("model_key", F.size("history").alias("n"))


@query("WITH r AS (SELECT vec_id, (row_number() OVER (ORDER BY md5(concat('2018|', vec_id)), vec_id) - 1) // 32 AS batch FROM embeddings) SELECT vec_id AS id, batch, e AS epoch "
       "FROM r, range(1, 4) t(e)")
def epoch_dataset(spark, d):
    return loops.epoch_dataset(examples(spark, d).select("id"), 2018, 32, 3)


@query("SELECT user_id AS model_id, max(c_name) AS model_name, count(DISTINCT event_id % 5) AS n, 5 AS epochs FROM events JOIN customer ON c_custkey = user_id GROUP BY 1")
def join_info_summary(spark, d):
    from mselect.plans.reports import join_info_summary as report

    e = table(spark, d, "events")
    means = e.groupBy(F.col("user_id").alias("model_id"), (F.col("event_id") % 5).alias("e")).agg(F.avg("value").alias("v"))
    info = ordered_values(means, ["model_id"], "e", "v", "validation_metrics")
    arch = table(spark, d, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("name"))
    summary = e.agg(F.sort_array(F.collect_set((F.col("event_id") % 5 + 1).cast("int"))).alias("metrics_iters"))
    return report(info, summary, arch).select("model_id", "model_name", F.size("validation_metrics").alias("n"), F.size("metrics_iters").alias("epochs"))


