"""Checked queries: scalar functions, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mselect.functions import architecture as arch
from mselect.functions import configs as cfg
from mselect.functions import features as feat
from mselect.functions import logs
from mselect.plans.base import (CLICK_CATEGORICAL, CLICK_NUMERIC, CLICKS_SQL, STAMP_SQL, bucket_sql, clicks, hash_sql,
                                query,
                                stamp, table)
from mselect.sources import readers, sinks

NUM = [f"n{i}" for i in range(len(CLICK_NUMERIC))]
CAT = [f"c{i}" for i in range(len(CLICK_CATEGORICAL))]


# ---- sources and sinks

@query("SELECT CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, len(embedding) AS n, "
       "CAST(label AS DOUBLE) AS label, 0 AS validation FROM embeddings")
def read_labeled(spark, d):
    rows = readers.labeled(table(spark, d, "embeddings").select(
        F.col("embedding").alias("features"), F.array("label").alias("labels")), False)
    return rows.select(F.col("features")[0].cast("double").alias("first"), F.col("features")[63].cast("double").alias("last"),
                       F.size("features").alias("n"), F.col("labels")[0].cast("double").alias("label"), "validation")


@query("SELECT validation, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS s FROM "
       "(SELECT *, 1 AS validation FROM embeddings WHERE vec_id % 10 = 0 UNION ALL "
       "SELECT *, 0 FROM embeddings WHERE vec_id % 10 <> 0) GROUP BY validation")
def read_dataset(spark, d):
    src = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.array("label").alias("labels"))
    both = readers.labeled(src.where("vec_id % 10 = 0"), True).unionByName(readers.labeled(src.where("vec_id % 10 <> 0"), False))
    return both.groupBy("validation").agg(F.count("*").alias("n"),
                                          F.round(F.sum(F.col("features")[0].cast("double")), 6).alias("s"))


_ZEROED = ", ".join([f"coalesce(n{i}, 0)" for i in range(13)] + [f"coalesce(c{i}, '0')" for i in range(26)])


@query(f"WITH {CLICKS_SQL} SELECT l_orderkey, l_linenumber, y AS label, md5(concat_ws('|', {_ZEROED})) AS digest FROM clicks")
def read_click_tsv(spark, d):
    line = F.concat_ws("\t", F.col("y").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in NUM + CAT])
    parsed = readers.parse_click_lines(clicks(spark, d).select("l_orderkey", "l_linenumber", line.alias("value")),
                                       keep=["l_orderkey", "l_linenumber"])
    return parsed.select("l_orderkey", "l_linenumber", F.col("_c0").alias("label"), F.md5(F.concat_ws(
        "|", *[F.col(f"_c{i}").cast("string") for i in range(1, 40)])).alias("digest"))


def _array_lines(spark, d):
    return table(spark, d, "embeddings").select(F.concat_ws(
        "|", F.col("vec_id").cast("string"), sinks.format_array_text("embedding", "label")).alias("value"))


_EMBED_SQL = ("SELECT vec_id AS id, label AS y, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, "
              "round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings")


def _summed(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 6)


@query(_EMBED_SQL)
def read_array_text(spark, d):
    r = _array_lines(spark, d).select(readers.parse_array_text("value").alias("r")).select("r.*")
    return r.select("id", "y", F.size("x").alias("n"), F.col("x")[0].cast("double").alias("first"),
                    _summed(F.col("x")).alias("total"))


@query("SELECT doc_id AS id, len(CAST(n_chars AS VARCHAR)) AS n, "
       "list_aggregate(list_transform(string_split(CAST(n_chars AS VARCHAR), ''), lambda x: CAST(x AS INT)), 'sum') AS digits "
       "FROM documents")
def read_array_text_digits(spark, d):
    lines = table(spark, d, "documents").select(F.concat(
        F.col("doc_id").cast("string"), F.lit("|{{1.5,2},{3e0}}|"), F.col("n_chars").cast("string")).alias("value"))
    r = lines.select(readers.parse_array_text("value", "list").alias("r")).select("r.*")
    return r.where("size(x) = 3 AND x[2] = 3.0").select(
        "id", F.size("y").alias("n"), F.aggregate("y", F.lit(0), lambda a, v: a + v).alias("digits"))


@query("SELECT vec_id AS id, label AS y, CAST(embedding[64] AS DOUBLE) AS last, len(embedding) AS n FROM embeddings")
def read_matrix_last_label(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.concat("embedding", F.array(F.col("label").cast("float"))).alias("row"))
    out = readers.read_matrix_last_label(rows, keep=["vec_id"])
    return out.select(F.col("vec_id").alias("id"), "y", F.col("x")[63].cast("double").alias("last"), F.size("x").alias("n"))


_PATH = "concat('/data/', source, '/', lang, '_', CAST(doc_id % 50 AS STRING), '.npz')"


@query(f"SELECT path, row_number() OVER (ORDER BY path) - 1 AS partition FROM (SELECT DISTINCT {_PATH} AS path FROM documents)")
def list_partitions(spark, d):
    return readers.number_paths(table(spark, d, "documents").selectExpr(f"{_PATH} AS path"))


@query("SELECT concat('worker', CAST(user_id % 8 AS VARCHAR)) AS worker, count(*) AS n, "
       "sum(length(concat(event_type, ' x'))) AS width FROM events GROUP BY 1")
def read_monitor_logs(spark, d):
    raw = table(spark, d, "events").selectExpr(
        "concat('/logs/cpu_utilization_worker', CAST(user_id % 8 AS STRING), '.log') AS file", "concat(event_type, ' x  ') AS value")
    rows = raw.select(readers.worker_of("file").alias("worker"), F.rtrim("value").alias("value"))
    return rows.groupBy("worker").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("width"))


@query("SELECT CAST(event_id % 5 AS INT) AS epoch, 'train' AS mode, value AS loss, value / 2 AS acc_top1, CAST(NULL AS DOUBLE) AS acc_top5, "
       "CAST(user_id AS INT) AS rank, CAST(event_id AS INT) AS model_index FROM events")
def read_rank_metrics(spark, d):
    lines = table(spark, d, "events").select(
        F.concat(F.lit("/x/all_logs_rank"), F.col("user_id").cast("string"), F.lit("_index"), F.col("event_id").cast("string"),
                 F.lit(".json")).alias("file"),
        F.concat(F.lit('{"'), (F.col("event_id") % 5).cast("string"), F.lit('": {"train": {"train_loss": '), F.col("value").cast("string"),
                 F.lit(', "train_acc_top1": '), (F.col("value") / 2).cast("string"), F.lit("}}}")).alias("value"))
    return readers.rank_metrics(lines)


@query("SELECT l_orderkey AS id, concat(CAST(l_orderkey AS VARCHAR), '|{', CAST(l_partkey AS VARCHAR), ',', CAST(l_suppkey AS VARCHAR), "
       "'}|', coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END, ' ')) AS value FROM lineitem")
def unload_parts(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.array("l_partkey", "l_suppkey").alias("x"),
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("y"))
    return sinks.unload_lines(rows)


@query("SELECT l_orderkey AS id, concat('{', CAST(l_partkey AS VARCHAR), ',', CAST(l_suppkey AS VARCHAR), '}|', "
       "CAST(l_linenumber AS VARCHAR), '|', l_returnflag) AS line FROM lineitem")
def format_array_text(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), sinks.format_array_text(
        F.array("l_partkey", "l_suppkey"), "l_linenumber", "l_returnflag").alias("line"))


# ---- scalar functions

_BUCKETS = {"a": "l_partkey", "b": "CAST(floor(l_extendedprice) AS BIGINT)", "c": "l_suppkey - 50",
            "e": "l_orderkey * l_partkey"}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{bucket_sql('(' + e + ')')} AS {n}" for n, e in _BUCKETS.items())
       + " FROM lineitem")
def bucketize(spark, d):
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    src = raw.selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _BUCKETS.items()])
    return src.withColumns({n: feat.bucketize(n) for n in _BUCKETS})


@query("SELECT event_id, " + hash_sql("props") + " AS a, " + hash_sql("CAST(user_id % 10 AS VARCHAR)", 16) + " AS b FROM events")
def hash_bucket(spark, d):
    src = table(spark, d, "events").select("event_id", "props", (F.col("user_id") % 10).cast("string").alias("u"))
    return src.select("event_id", feat.hash_bucket("props", algo="md5").alias("a"), feat.hash_bucket("u", 16, "md5").alias("b"))


def _murmur_sql(e: str) -> str:
    """MurmurHash3 of an ASCII text by list arithmetic on 128-bit numbers, little-endian blocks of four characters."""
    m = 4294967296

    def mul(a, b):
        return f"(({a}) * {b} % {m})"

    def rot(a, r):
        return f"((({a}) * {2 ** r} % {m}) + (({a}) // {2 ** (32 - r)}))"

    def byte(i):
        return f"(CASE WHEN {i} <= length(s) THEN ascii(substr(s, CAST({i} AS BIGINT), 1)) ELSE 0 END)::HUGEINT"

    def block(i):
        return f"({byte(f'{i} * 4 + 1')} + {byte(f'{i} * 4 + 2')} * 256 + {byte(f'{i} * 4 + 3')} * 65536 + {byte(f'{i} * 4 + 4')} * 16777216)"

    def scramble(k):
        return mul(rot(mul(k, 3432918353), 15), 461845907)

    blocks = f"list_transform(range(length(s) // 4), lambda i: {scramble(block('i'))})"
    mix = f"({rot('xor(h, k)', 13)} * 5 + 3864292196) % {m}"
    body = f"list_reduce(list_prepend(0::HUGEINT, {blocks}), lambda h, k: {mix})"
    tail = f"CASE WHEN length(s) % 4 = 0 THEN b ELSE xor(b, {scramble(block('(length(s) // 4)'))}) END"
    return (f"SELECT k, xor(h3, h3 // 65536) AS u FROM (SELECT k, {mul('xor(h2, h2 // 8192)', 3266489909)} AS h3 FROM "
            f"(SELECT k, {mul('xor(h1, h1 // 65536)', 2246822507)} AS h2 FROM (SELECT k, xor({tail}, length(s)::HUGEINT) AS h1 FROM "
            f"(SELECT k, s, {body} AS b FROM ({e})))))")


@query("SELECT k AS event_id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS BIGINT) AS h FROM ("
       + _murmur_sql("SELECT event_id AS k, concat(event_type, props) AS s FROM events") + ")")
def hash_murmur3(spark, d):
    return table(spark, d, "events").select("event_id", feat.murmur3(F.concat("event_type", "props")).alias("h"))


_PLACES = ", ".join([f"{bucket_sql(f'n{i}')} + {i * 50}" for i in range(13)]
                    + [f"{hash_sql(f'c{i}')} + {650 + i * 256}" for i in range(26)])


@query(f"WITH {CLICKS_SQL}, e AS (SELECT l_orderkey, l_linenumber, y, list_sort(list_filter([{_PLACES}], lambda x: x IS NOT NULL)) AS idx "
       "FROM clicks) SELECT l_orderkey, l_linenumber, y AS label, len(idx) AS n, array_to_string(idx, ',') AS idx FROM e")
def encode_row(spark, d):
    out = feat.encode_row(clicks(spark, d), "y", NUM, CAT, "md5", keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "label", F.size("val").alias("n"), F.array_join("idx", ",").alias("idx"))


@query("SELECT event_id, array_to_string(list_transform(range(16), lambda i: CASE WHEN i = event_id % 16 THEN 2 WHEN i = (event_id + 5) % 16 "
       "THEN 3 ELSE 0 END), ',') AS dense, least(event_id % 16, (event_id + 5) % 16) AS i0, "
       "greatest(event_id % 16, (event_id + 5) % 16) AS i1 FROM events")
def sparse_to_dense(spark, d):
    src = table(spark, d, "events").select("event_id", F.array(F.col("event_id") % 16, (F.col("event_id") + 5) % 16).alias("idx"),
                                           F.expr("array(CAST(2 AS FLOAT), CAST(3 AS FLOAT))").alias("val"))
    dense = src.withColumn("dense", feat.sparse_to_dense("idx", "val", 16))
    back = feat.dense_to_sparse("dense")
    return dense.select("event_id", F.array_join(F.transform("dense", lambda v: v.cast("int")), ",").alias("dense"),
                        back["idx"][0].alias("i0"), back["idx"][1].alias("i1"))


@query("SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CAST(i = label AS INT)), '') AS hot, label AS back, "
       "list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def one_hot(spark, d):
    src = table(spark, d, "embeddings").withColumn("y", feat.one_hot("label", 10))
    return src.select("vec_id", F.array_join("y", "").alias("hot"), feat.argmax("y").alias("back"),
                      feat.argmax("embedding").alias("best"))


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents WHERE source LIKE 'src1%'")
def label_index(spark, d):
    return feat.label_index(table(spark, d, "documents").select("doc_id", "source"), "source", "src1")


_MEAN, _STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


@query("SELECT vec_id, round(list_sum(list_transform(range(66), lambda i: (coalesce(CAST(embedding[i + 1] AS DOUBLE), 0) / 255 - "
       f"list_extract({_MEAN}, CAST(i % 3 + 1 AS INT))) / list_extract({_STD}, CAST(i % 3 + 1 AS INT)))), 6) AS total FROM embeddings")
def standardize(spark, d):
    # three channels: 64 numbers and two zeros
    x = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.lit(0.0), F.lit(0.0)))
    src = table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return src.select("vec_id", _summed(feat.standardize("x", _MEAN, _STD)).alias("total"))


@query("SELECT vec_id, CAST(embedding[CAST((i % 16) * 4 + i // 16 + 1 AS INT)] AS DOUBLE) AS v, i FROM embeddings, range(64) t(i)")
def channels_last_to_first(spark, d):
    src = table(spark, d, "embeddings").select("vec_id", feat.channels_last_to_first("embedding", 4, 4, 4).alias("x"))
    return src.select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


_CONFIG = ["l_discount AS learning_rate", "CAST(concat(CAST(CAST(round(l_tax * 100) AS INT) AS STRING), 'e-05') AS DOUBLE) AS lambda_value", "CAST(l_quantity AS INT) AS batch_size",
           "concat('net ', l_returnflag) AS model"]


def _configs(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_discount", "l_tax", "l_quantity", "l_returnflag").selectExpr("l_orderkey", *_CONFIG).select("l_orderkey", F.struct(
        "learning_rate", "lambda_value", "batch_size", "model").alias("c"))


# lambda values of 1e-05 and up to 8e-05; l_tax has two digits
_NUM_SQL = ("CASE WHEN l_tax = 0 THEN '0.0' ELSE concat(CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR), 'e-05') END")


@query(f"SELECT l_orderkey, concat('batch_size:', CAST(l_quantity AS INT), '|lambda_value:', {_NUM_SQL}, '|learning_rate:', "
       "l_discount, '|model:net_', l_returnflag) AS key, round(l_tax / 1000, 9) AS lambda_value, concat('net_', l_returnflag) AS model, "
       "CAST(l_quantity AS INT) AS batch_size, l_discount AS learning_rate FROM lineitem")
def config_key(spark, d):
    keyed = _configs(spark, d).select("l_orderkey", cfg.config_key("c").alias("key"))
    p = cfg.parse_config_key("key")
    return keyed.select("l_orderkey", "key", F.round(p["lambda_value"], 9).alias("lambda_value"), p["model"].alias("model"),
                        p["batch_size"].alias("batch_size"), p["learning_rate"].alias("learning_rate"))


@query(f"SELECT l_orderkey, concat('learning_rate:', l_discount, ',lambda_value:', {_NUM_SQL}, ',batch_size:', CAST(l_quantity AS INT), "
       "',model:net ', l_returnflag) AS label FROM lineitem")
def config_label(spark, d):
    return _configs(spark, d).select("l_orderkey", cfg.config_label("c").alias("label"))


@query("SELECT l_orderkey, concat('{\"loss\":\"categorical_crossentropy\",\"optimizer\":\"Adam(lr=', l_discount, "
       "')\",\"metrics\":[\"top_k_categorical_accuracy\"]}') AS compile_params, "
       "concat('{\"batch_size\":', CAST(l_quantity AS INT), ',\"epochs\":1}') AS fit_params FROM lineitem")
def fit_params(spark, d):
    return _configs(spark, d).select("l_orderkey", cfg.fit_params("c").alias("p")).select("l_orderkey", "p.*")


@query("SELECT event_id, event_type AS info, CAST(user_id AS VARCHAR) AS worker, CAST(NULL AS VARCHAR) AS missing FROM events")
def parse_kv(spark, d):
    line = F.concat(F.lit("EVENT: "), "event_type", F.lit(", WORKER: "), F.col("user_id").cast("string"), F.lit(", broken, A: B: C"))
    kv = table(spark, d, "events").select("event_id", "event_type", "user_id").select(
        "event_id", line.alias("line"), logs.parse_kv(line).alias("m"))
    same = logs.kv_value("line", "WORKER").eqNullSafe(F.col("m")["WORKER"]) & logs.kv_value("line", "A").isNull()
    return kv.where(same).select("event_id", F.col("m")["EVENT"].alias("info"), F.col("m")["WORKER"].alias("worker"),
                                 F.col("m")["A"].alias("missing"))


@query(f"SELECT event_id, event_type AS a_info, {STAMP_SQL} AS a_t, concat('Run: ', event_type) AS b_info, {STAMP_SQL} AS b_t, "
       f"event_type AS c_info, {STAMP_SQL} AS c_t, CASE WHEN event_type = 'view' THEN 'Start MST' ELSE concat('x: ', event_type) END AS d_info "
       "FROM events")
def parse_event_line(spark, d):
    t = stamp()
    unix = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("string")
    lines = table(spark, d, "events").select("event_id", "ts", "event_type").select(
        "event_id",
        logs.parse_event_line(F.concat(F.lit("INFO: "), "event_type", F.lit(": "), t, F.lit("  (seg0 slice1)")), "notice").alias("a"),
        logs.parse_event_line(F.concat(F.lit("Run: "), "event_type", F.lit(": "), t), "client").alias("b"),
        logs.parse_event_line(F.concat(F.lit("TIME: "), unix, F.lit(", EVENT: "), "event_type", F.lit(", WORKER: 0")), "unix").alias("c"),
        logs.parse_event_line(F.concat(F.when(F.col("event_type") == "view", F.lit("Start MST: view")).otherwise(
            F.concat(F.lit("x: "), "event_type")), F.lit(": "), t), "ddp").alias("e"))
    out = lines.select("event_id", *[F.col(f"{c}.info").alias(f"{n}_info") for c, n in (("a", "a"), ("b", "b"), ("c", "c"), ("e", "d"))],
                       *[F.col(f"{c}.t").alias(f"{c}_t") for c in "abc"])
    return out.withColumns({f"{c}_t": stamp(f"{c}_t") for c in "abc"})


@query("SELECT event_id, value AS cpu, CAST(user_id AS DOUBLE) + 0.5 AS memory, 'sda' AS dev, value + 1 AS mb_read, value + 2 AS mb_wrtn, "
       "'sdb' AS dev2, CAST(user_id AS DOUBLE) AS mb_wrtn2, value AS rx, value * 2 AS tx, 2 AS fields FROM events")
def parse_monitor_lines(spark, d):
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    cpu = F.concat(v, F.lit("%,"), u, F.lit(".5%"))
    disk = F.concat(F.lit("Device tps MB_read/s MB_wrtn/s MB_read MB_wrtn sda 1.0 2.0 3.0 "), (F.col("value") + 1).cast("string"), F.lit(" "),
                    (F.col("value") + 2).cast("string"), F.lit(" sdb 0 0 0 0 "), u)
    net = F.concat(F.lit("EXPERIMENT_IFACE: eth1, rxkB/s: "), v, F.lit(", txkB/s: "), (F.col("value") * 2).cast("string"))
    p = table(spark, d, "events").select("event_id", "value", "user_id").select("event_id", logs.parse_percent(cpu, 0).alias("cpu"), logs.parse_percent(cpu, 1).alias("memory"),
                                         logs.parse_disk(disk).alias("k"), logs.parse_net(net).alias("m"))
    k, m = F.col("k"), F.col("m")
    return p.select("event_id", "cpu", "memory", k[0]["device"].alias("dev"), k[0]["MB_read"].alias("mb_read"),
                    k[0]["MB_wrtn"].alias("mb_wrtn"), k[1]["device"].alias("dev2"), k[1]["MB_wrtn"].alias("mb_wrtn2"),
                    m["rxkB/s"].alias("rx"), m["txkB/s"].alias("tx"), F.size("m").alias("fields"))


@query("SELECT p_partkey, concat(p_size, ',', 3) AS shape, p_partkey % 100 + 2 AS classes, concat('Model arch layers:', chr(10), "
       "'Dense[', p_size, ']', chr(10), '   |', chr(10), '   V', chr(10), 'Activation', chr(10), '   |', chr(10), '   V', chr(10), "
       "'Dense[', p_partkey % 100 + 2, ']', chr(10)) AS layers FROM part")
def arch_layers(spark, d):
    size, units = F.col("p_size").cast("string"), (F.col("p_partkey") % 100 + 2).cast("string")
    layers = F.concat(F.lit('[{"class_name":"Dense","config":{"batch_input_shape":[null,'), size, F.lit(',3],"units":'), size,
                      F.lit('}},{"class_name":"Activation","config":{"a":"relu"}},{"class_name":"Dense","config":{"units":'), units, F.lit("}}]"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"config":'), layers, F.lit("}"))).otherwise(
        F.concat(F.lit('{"config":{"name":"s","layers":'), layers, F.lit("}}")))
    src = table(spark, d, "part").select("p_partkey", text.alias("a"))
    return src.select("p_partkey", F.array_join(arch.arch_input_shape("a"), ",").alias("shape"),
                      arch.num_classes("a").alias("classes"), arch.layer_text("a").alias("layers"))


@query("SELECT vec_id, 65 AS n, CAST(label AS DOUBLE) AS head, 3 AS layers, 16 AS n2, CAST(embedding[49] AS DOUBLE) AS third FROM embeddings")
def flatten_weights(spark, d):
    e = F.col("embedding")
    layers = F.array(F.slice(e, 1, 32), F.slice(e, 33, 16), F.slice(e, 49, 16))
    src = table(spark, d, "embeddings").select("vec_id", arch.flatten_weights(layers, "label").alias("c"), arch.flatten_weights(layers).alias("f"))
    shapes = F.array(F.array(F.lit(4), F.lit(8)), F.array(F.lit(16)), F.array(F.lit(2), F.lit(8)))
    back = src.withColumn("b", arch.unflatten_weights("f", shapes))
    return back.select("vec_id", F.size("c").alias("n"), F.col("c")[0].cast("double").alias("head"), F.size("b").alias("layers"),
                       F.size(F.col("b")[1]).alias("n2"), F.col("b")[2][0].cast("double").alias("third"))


@query("SELECT event_id, round(1 - value / 500, 9) AS error, round(value / 3600, 9) AS hours, round(value / (3600 * 8 * 5), 9) AS machine FROM events")
def unit_conversions(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.round(cfg.error_rate(F.col("value") / 500), 9).alias("error"), F.round(cfg.to_hours("value"), 9).alias("hours"),
        F.round(cfg.machine_hours("value", 8, 5), 9).alias("machine"))


@query("SELECT user_id % 7 AS worker, CAST(sum(strlen(l) + 1) OVER (PARTITION BY user_id % 7 ORDER BY event_id) - strlen(l) - 1 AS BIGINT) AS \"offset\", l AS value "
       "FROM (SELECT user_id, event_id, concat(event_id, ' ', event_type, ' ', props) AS l FROM events)")
def read_log_ranges(spark, d):
    from mselect.session import ensure_checkpoint_dir
    from mselect.sources.loglines import read_log_ranges as read

    # a file a worker, its lines in the order of their events
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loglines-{uuid.uuid4().hex}"
    lines = table(spark, d, "events").select((F.col("user_id") % 7).alias("worker"), "event_id", F.concat_ws(" ", "event_id", "event_type", "props").alias("value"))
    lines.repartition("worker").sortWithinPartitions("worker", "event_id").drop("event_id").write.partitionBy("worker").text(path)
    return read(spark, path, 4096).select(F.regexp_extract("file", r"worker=(\d+)", 1).cast("long").alias("worker"), "offset", "value")
