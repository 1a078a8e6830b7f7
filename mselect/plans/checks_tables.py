"""Checked queries: filters, joins, unions, aggregates, order, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from mselect.operators import aggregates as agg
from mselect.operators import permuting
from mselect.operators import ranking as rank
from mselect.operators import relational as rel
from mselect.operators import sequence as seq
from mselect.plans.base import JOBS_SQL, STAMP_SQL, jobs, query, stamp, table

# ---- filters and projections


@query(f"WITH {JOBS_SQL} SELECT event_id, model_key, epoch FROM jobs WHERE dist_key = 3")
def target_partition(spark, d):
    return rel.target_partition(jobs(spark, d), 3).select("event_id", "model_key", "epoch")


_START, _END = "2024-01-05 00:00:00", "2024-01-12 12:00:00"


@query(f"SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '{_START}' AND ts < TIMESTAMP '{_END}'")
def time_slice(spark, d):
    return rel.time_slice(table(spark, d, "events"), _START, _END, "ts").select("event_id", "value")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9479 SECOND, '%Y-%m-%d %H:%M:%S') AS a, strftime((SELECT min(ts) FROM events "
       "WHERE event_type LIKE '%purchase%'), '%Y-%m-%d %H:%M:%S') AS b FROM orders")
def shift_start(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start_time"))
    log = table(spark, d, "events").select(F.col("ts").alias("t"), F.col("event_type").alias("value"))
    moved = rel.shift_start(o, seconds=9479).withColumn("a", stamp("start_time"))
    return rel.shift_start(moved, log=log, marker="purchase").select("o_orderkey", "a", stamp("start_time").alias("b"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def name_like(spark, d):
    return rel.name_like(table(spark, d, "part"), "ring", "p_name").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'")
def lookup_model(spark, d):
    return rel.lookup_model(table(spark, d, "orders"), "5-LOW", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, event_type FROM events WHERE (event_type LIKE '%view%' OR event_type LIKE '%error%') AND props NOT LIKE '%9%'")
def keep_lines(spark, d):
    from mselect.functions.logs import keep_lines as keep

    lines = table(spark, d, "events").select("event_id", "event_type", F.concat("event_type", F.lit(" "), "props").alias("value"))
    return keep(lines, ["view", "error"], ["9"]).select("event_id", "event_type")


@query("SELECT o.o_orderkey AS id, o.o_totalprice AS price, c.c_name AS customer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def rename_after_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rel.rename_after_join(both, ["id", "key", "price", "key_dup", "customer"], ["key", "key_dup"])


@query("SELECT event_id, value AS a, CAST(CASE WHEN user_id % 2 = 0 THEN user_id END AS DOUBLE) AS b FROM events")
def to_numeric(spark, d):
    texts = table(spark, d, "events").select("event_id", F.col("value").cast("string").alias("a"),
                                             F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("b"))
    return rel.to_numeric(texts, ["a", "b"])


# ---- joins

@query("SELECT l_partkey AS model_id, count(*) AS n, round(sum(l_quantity), 6) AS q, max(p_name) AS name FROM lineitem JOIN part "
       "ON l_partkey = p_partkey GROUP BY l_partkey")
def info_with_arch(spark, d):
    info = table(spark, d, "lineitem").select(F.col("l_partkey").alias("model_id"), "l_quantity")
    arch = table(spark, d, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("name"))
    return rel.info_with_arch(info, arch).groupBy("model_id").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("q"), F.max("name").alias("name"))


@query("WITH s AS (SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) "
       "SELECT l_orderkey AS a, l_linenumber AS b, l_partkey, n FROM lineitem LEFT JOIN s ON a = l_orderkey AND b = l_linenumber")
def left_composite(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "a", "l_linenumber": "b"})
    s = li.where("l_returnflag = 'R'").groupBy("a", "b").agg(F.count("*").alias("n"))
    return rel.left_composite(li.select("a", "b", "l_partkey"), s, ["a", "b"])


# customers as segments and suppliers as devices, hosts by a number that some segments' hosts lack
_SEGMENTS = ["concat('host', CAST(c_custkey % 35 AS STRING)) AS hostname", "CAST(c_custkey % 9 - 1 AS INT) AS content",
             "CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'm' END AS role", "c_custkey AS dbid"]
_DEVICES = ["concat('host', CAST(s_suppkey % 30 AS STRING)) AS hostname", "s_suppkey"]
_SEG_SQL = f"seg AS (SELECT {', '.join(_SEGMENTS)} FROM customer), dev AS (SELECT {', '.join(_DEVICES)} FROM supplier)"


def _segments(spark, d):
    return (table(spark, d, "customer").selectExpr(*_SEGMENTS),
            table(spark, d, "supplier").selectExpr(*_DEVICES))


@query(f"WITH {_SEG_SQL} SELECT DISTINCT seg.hostname FROM seg JOIN dev USING (hostname) WHERE role = 'p' AND content <> -1")
def hosts_with_device(spark, d):
    return rel.hosts_with_device(*_segments(spark, d))


@query("SELECT d.doc_id AS file, CAST(d.doc_id % 25 AS INT) AS class_index, n_name AS label_text FROM documents d JOIN nation ON n_nationkey = d.doc_id % 25")
def relabel(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"))
    truth = table(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("doc_id") % 25).cast("int").alias("class_index"))
    mapping = table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("label_text"))
    return rel.relabel(files, truth, mapping)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_members(spark, d):
    return rel.semi_members(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("SELECT event_id, event_type AS event, CASE WHEN event_type IN ('view', 'click') THEN 'train_valid' WHEN event_type = 'error' THEN 'idle' "
       "ELSE 'merge' END AS phase FROM events")
def map_events(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"))
    known = ev.select("event").distinct().withColumn("phase", F.when(F.col("event").isin("view", "click"), "train_valid").when(
        F.col("event") == "error", "idle").otherwise("merge"))
    return rel.map_events(ev, known)


@query("SELECT DISTINCT event_type AS event FROM events WHERE event_type NOT IN ('view', 'click')")
def unknown_events(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("event"))
    return rel.unknown_events(ev, ev.where("event IN ('view', 'click')").distinct())


@query("SELECT l_returnflag AS table_name, l_orderkey AS buffer_id, count(*) AS n, max(o_orderkey) AS shape FROM lineitem JOIN orders "
       "ON l_orderkey = o_orderkey GROUP BY ALL")
def with_shapes(spark, d):
    blobs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("table_name"), F.col("l_orderkey").alias("buffer_id"))
    flags = F.explode(F.array(*map(F.lit, "ANR"))).alias("table_name")
    shapes = table(spark, d, "orders").select(flags, F.col("o_orderkey").alias("buffer_id"), F.col("o_orderkey").alias("shape"))
    return rel.with_shapes(blobs, shapes).groupBy("table_name", "buffer_id").agg(F.count("*").alias("n"), F.max("shape").alias("shape"))


# run times by method and size out of orders: status is the method, customer group the size
_RUNS = ("SELECT CASE o_orderstatus WHEN 'F' THEN 'udaf' WHEN 'O' THEN 'ctq' ELSE 'ma' END AS method, CAST(pow(2, o_custkey % 4) AS INT) AS size, "
         "round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY ALL")


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(
        F.when(F.col("o_orderstatus") == "F", "udaf").when(F.col("o_orderstatus") == "O", "ctq").otherwise("ma").alias("method"),
        F.pow(F.lit(2), F.col("o_custkey") % 4).cast("int").alias("size")).agg(F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query(f"WITH r AS ({_RUNS}) SELECT a.size, round(a.seconds, 1) AS over_time, round(b.seconds, 1) AS under_time, round(a.seconds / b.seconds, 6) AS speedup "
       "FROM r a JOIN r b USING (size) WHERE a.method = 'udaf' AND b.method = 'ctq'", name="pair_runs")
def pair_runs(spark, d):
    from mselect.plans.reports import strategy_speedup

    out = strategy_speedup(_runs(spark, d))
    return out.select("size", F.round("over_time", 1).alias("over_time"), F.round("under_time", 1).alias("under_time"), F.round("speedup", 6).alias("speedup"))


@query("SELECT DISTINCT user_id AS model_key, k AS dist_key FROM events, range(8) t(k)")
def model_partition_pairs(spark, d):
    return rel.model_partition_pairs(table(spark, d, "events").select(F.col("user_id").alias("model_key")).distinct(), 8)


@query(f"WITH {_SEG_SQL}, p AS (SELECT * FROM seg WHERE role = 'p' AND content <> -1), dc AS (SELECT hostname, count(*) AS devices FROM dev GROUP BY 1), "
       "sc AS (SELECT hostname, count(*) AS segments FROM p GROUP BY 1) SELECT hostname, content AS segment_id, segments, coalesce(devices, 0) AS devices, "
       "CAST(coalesce(devices, 0) > 0 AND coalesce(devices, 0) < segments AS INT) AS shared FROM p JOIN sc USING (hostname) LEFT JOIN dc USING (hostname)")
def by_host_counts(spark, d):
    return rel.by_host_counts(*_segments(spark, d)).withColumn("shared", F.col("shared").cast("int"))


# ---- set operations

@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 3 = 0")
def union_splits(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return rel.union_splits(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"))


@query("SELECT vec_id, len(embedding) AS width, CASE WHEN label = 0 THEN 'v' ELSE 't' END AS table_name FROM embeddings")
def concat_shapes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("width"))
    return rel.concat_shapes(e.where("label = 0"), e.where("label <> 0"), "v", "t").drop("label")


@query("SELECT event_id AS k, value AS rx, CAST(NULL AS BIGINT) AS tx, 'a' AS iface FROM events UNION ALL SELECT l_orderkey, NULL, l_partkey, 'b' FROM lineitem")
def append_frames(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").alias("rx"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("tx"))
    return rel.append_frames({"a": a, "b": b}, "iface")


@query("WITH s AS (SELECT CAST(event_id % 10 AS INT) AS epoch, round(avg(sqrt(value)), 6) AS metric FROM events GROUP BY 1), "
       "a AS (SELECT CAST(user_id % 10 AS INT) AS switch, CAST(event_id % 10 AS INT) AS epoch, round(avg(sqrt(value)), 6) AS metric FROM events GROUP BY 1, 2) "
       "SELECT k AS switch, s.epoch, s.metric FROM s, range(10) t(k) WHERE s.epoch < k UNION ALL SELECT switch, epoch, metric FROM a WHERE epoch >= switch")
def stitch_history(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 10).cast("int").alias("epoch"), (F.col("user_id") % 10).cast("int").alias("switch"), "value")
    s = e.groupBy("epoch").agg(F.round(F.avg(F.sqrt("value")), 6).alias("metric"))
    a = e.groupBy("switch", "epoch").agg(F.round(F.avg(F.sqrt("value")), 6).alias("metric"))
    return rel.stitch_history(s, a, 10)


# ---- aggregates

_MEANS = "round(avg(loss_train), 6) AS loss_train, round(avg(metric_train), 6) AS metric_train, round(avg(loss_valid), 6) AS loss_valid, round(avg(metric_valid), 6) AS metric_valid"


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {JOBS_SQL} SELECT epoch, model_key, {_MEANS} FROM jobs GROUP BY epoch, model_key")
def mean_by_epoch_model(spark, d):
    return _rounded(agg.mean_by_epoch_model(jobs(spark, d)), ["loss_train", "metric_train", "loss_valid", "metric_valid"])


@query(f"WITH {JOBS_SQL}, m AS (SELECT model_key, epoch, avg(metric_valid) AS v FROM jobs GROUP BY ALL) SELECT model_key, "
       "epoch - 1 AS place, round(v, 6) AS metric FROM m")
def model_summary(spark, d):
    out = agg.model_summary(jobs(spark, d))
    return out.select("model_key", F.posexplode("metrics").alias("place", "metric")).withColumn("metric", F.round("metric", 6))


_MODE = ["CAST(event_id % 5 AS INT) AS epoch", "CAST(user_id % 8 AS INT) AS mst_key", "CASE WHEN user_id % 3 = 0 THEN 'TRAIN' ELSE 'VALID' END AS mode",
         "event_type AS config", "sqrt(value) AS train_loss", "sqrt(value + 1) AS valid_loss", "value / 503 AS error", "value / 491.3 AS error_1"]


@query(f"WITH r AS (SELECT {', '.join(_MODE)} FROM events) SELECT epoch, mst_key, mode, config, round(avg(train_loss), 6) AS train_loss, "
       "round(avg(valid_loss), 6) AS valid_loss, round(avg(error), 6) AS error, round(avg(error_1), 6) AS error_1 FROM r GROUP BY ALL")
def mean_by_epoch_mode(spark, d):
    rows = table(spark, d, "events").selectExpr(*_MODE)
    return _rounded(agg.mean_by_epoch_mode(rows), ["train_loss", "valid_loss", "error", "error_1"])


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'train_valid' ELSE 'idle' END AS phase, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def phase_totals(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("event"), F.col("value").alias("seconds"))
    known = ev.select("event").distinct().withColumn("phase", F.when(F.col("event").isin("view", "click"), "train_valid").otherwise("idle"))
    return _rounded(agg.phase_totals(ev, known), ["seconds"], 4)


# cumulative counters per worker and device out of events
_DISK = ["CASE WHEN user_id % 8 = 7 THEN 'master' ELSE concat('worker', CAST(user_id % 8 AS STRING)) END AS worker", "event_type AS device",
         "CAST(event_id AS DOUBLE) * 2 AS MB_read", "CAST(event_id AS DOUBLE) * 3 + value AS MB_wrtn"]
_IO_SQL = (f"k AS (SELECT {', '.join(_DISK)} FROM events), g AS (SELECT worker, device, max(MB_read) - min(MB_read) AS MB_i, max(MB_wrtn) - min(MB_wrtn) AS MB_o "
           "FROM k WHERE worker <> 'master' GROUP BY ALL)")


def _disk(spark, d):
    return table(spark, d, "events").selectExpr(*_DISK)


@query(f"WITH {_IO_SQL} SELECT worker, device, round(MB_i, 4) AS MB_i, round(MB_o, 4) AS MB_o, round(MB_i + MB_o, 4) AS MB_io FROM g")
def device_io(spark, d):
    return _rounded(agg.device_io(_disk(spark, d)), ["MB_i", "MB_o", "MB_io"], 4)


@query(f"WITH {_IO_SQL}, w AS (SELECT worker, sum(MB_i) AS i, sum(MB_o) AS o FROM g GROUP BY 1) SELECT round(avg(i) / 1024, 6) AS mean_GB_i, "
       "round(sum(i) / 1024, 6) AS sum_GB_i, round(avg(o) / 1024, 6) AS mean_GB_o, round(sum(o) / 1024, 6) AS sum_GB_o FROM w")
def worker_io(spark, d):
    return _rounded(agg.worker_io(agg.device_io(_disk(spark, d)), True), ["mean_GB_i", "sum_GB_i", "mean_GB_o", "sum_GB_o"])


_NET = ["CASE WHEN user_id % 8 = 7 THEN 'master' ELSE concat('worker', CAST(user_id % 8 AS STRING)) END AS worker",
        "CASE WHEN event_id % 2 = 0 THEN 'EXP' ELSE 'CONTROL' END AS iface", "sqrt(value) AS rx", "sqrt(value + 1) AS tx"]


@query(f"WITH n AS (SELECT {', '.join(_NET)} FROM events) SELECT CASE WHEN worker = 'master' THEN 'master' ELSE 'worker' END AS side, iface, "
       "round(avg(rx), 6) AS mean_rx, max(rx) AS max_rx, round(avg(tx), 6) AS mean_tx, max(tx) AS max_tx, round(avg(rx + tx), 6) AS mean_rxtx, "
       "round(max(rx + tx), 6) AS max_rxtx FROM n GROUP BY ALL")
def network_stats(spark, d):
    return _rounded(agg.network_stats(table(spark, d, "events").selectExpr(*_NET)), ["mean_rx", "mean_tx", "mean_rxtx", "max_rxtx"])


@query(f"WITH n AS (SELECT {', '.join(_NET)} FROM events WHERE event_id % 2 = 0) SELECT round(((SELECT avg(rx) FROM n WHERE worker = 'master') + "
       "(SELECT avg(rx) FROM n WHERE worker <> 'master') * (SELECT count(DISTINCT worker) FROM n WHERE worker <> 'master')) * 7200 / 1024 / 1024, 6) AS total_gb")
def network_total(spark, d):
    return _rounded(agg.network_total(table(spark, d, "events").selectExpr(*_NET), 7200), ["total_gb"])


@query("WITH m AS (SELECT user_id % 8 AS w, avg(sqrt(value)) AS v FROM events WHERE user_id % 8 <> 7 GROUP BY 1) SELECT round(avg(v), 6) AS utilization FROM m")
def mean_of_means(spark, d):
    rows = table(spark, d, "events").selectExpr(_NET[0], "sqrt(value) AS utilization")
    return _rounded(agg.mean_of_means(rows), ["utilization"])


@query("SELECT user_id AS model, count(DISTINCT event_id % 10) AS n, round(max_by(m, e), 6) AS last FROM (SELECT user_id, event_id % 10 AS e, event_id, "
       "avg(sqrt(value)) OVER (PARTITION BY user_id, event_id % 10) AS m FROM events) GROUP BY 1")
def metrics_as_list(spark, d):
    means = table(spark, d, "events").groupBy(F.col("user_id").alias("model"), (F.col("event_id") % 10).alias("epoch")).agg(F.avg(F.sqrt("value")).alias("metric"))
    out = agg.metrics_as_list(means)
    return out.select("model", F.size("validation_metrics").alias("n"), F.round(F.element_at("validation_metrics", -1), 6).alias("last"))


@query("SELECT user_id // 8 AS batch, event_id % 10 AS epoch, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time FROM events GROUP BY 1, 2")
def batch_end_times(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), (F.col("event_id") % 10).alias("epoch"), F.col("ts").alias("t"))
    return agg.batch_end_times(rows, 8).withColumn("end_time", stamp("end_time"))


@query(f"WITH {_SEG_SQL} SELECT hostname, greatest(1, count(*)) AS segments FROM seg WHERE role = 'p' AND content <> -1 GROUP BY 1")
def count_by_host(spark, d):
    return agg.count_by_host(_segments(spark, d)[0])


@query(f"WITH {_SEG_SQL} SELECT greatest(1, count(*)) AS segments FROM seg WHERE role = 'p' AND content <> -1")
def segment_count(spark, d):
    return agg.segment_count(_segments(spark, d)[0])


_RANKED = ("SELECT vec_id, label, i - 1 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) AS r FROM embeddings, range(1, 65) t(i)")


@query(f"WITH s AS ({_RANKED}) SELECT k, round(avg(CAST(r <= k AS DOUBLE)), 6) AS accuracy FROM s, (VALUES (1), (5)) t(k) WHERE c = label GROUP BY k")
def topk_hits(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding").alias("scores"), "label")
    return _rounded(agg.topk_hits(p, 1).withColumn("k", F.lit(1)).unionByName(agg.topk_hits(p, 5).withColumn("k", F.lit(5))), ["accuracy"])


@query(f"WITH s AS ({_RANKED}) SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY r) AS best FROM s WHERE r <= 3 GROUP BY 1")
def topk(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(agg.top_classes(F.col("embedding"), 3), ",").alias("best"))


@query("WITH b AS (SELECT user_id % 8 AS p, event_id // 32 AS b, avg(sqrt(value)) AS m FROM events GROUP BY ALL) SELECT round((SELECT avg(m) FROM b), 6) AS whole, "
       "round((SELECT avg(m) FROM b WHERE p = 7), 6) AS last")
def batch_then_mean(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 8).alias("p"), F.floor(F.col("event_id") / 32).alias("batch"), (F.sqrt("value")).alias("value"))
    whole = agg.batch_then_mean(rows, "value", partition="p").select(F.lit(0).alias("k"), F.round("value", 6).alias("whole"))
    last = agg.batch_then_mean(rows, "value", partition="p", reset_per_partition=True).select(F.lit(0).alias("k"), F.round("value", 6).alias("last"))
    return whole.join(last, "k").drop("k")


@query("SELECT label AS model, i - 1 AS pos, round(sum((vec_id % 7 + 1) * CAST(embedding[i] AS DOUBLE)) / sum(vec_id % 7 + 1), 6) AS w, "
       "CAST(sum(vec_id % 7 + 1) AS DOUBLE) AS n FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def weighted_merge(spark, d):
    s = table(spark, d, "embeddings").select(F.col("label").alias("model"), (F.col("vec_id") % 7 + 1).alias("n"), F.col("embedding").alias("w"))
    return _rounded(agg.weighted_merge(s, ["model"]), ["w"])


# ---- order-dependent operators

@query("SELECT user_id AS worker, event, round(s, 6) AS seconds FROM (SELECT user_id, concat('Between-', lag(event_type) OVER w, '-', event_type) AS event, "
       "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE s IS NOT NULL")
def event_gaps(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("t"), F.col("event_type").alias("info"), F.col("event_id").alias("pos"))
    return _rounded(seq.event_gaps(log), ["seconds"])


@query("SELECT user_id AS file, event_id AS pos, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER "
       "(PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS config FROM events")
def fill_config(spark, d):
    lines = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), "event_type", "props")
    return seq.fill_config(lines, F.when(F.col("event_type") == "signup", F.col("props")), ["file"], ["pos"]).select("file", "pos", "config")


_GLOBAL = ("concat('RUN', CAST(user_id % 3 AS VARCHAR), CASE event_type WHEN 'view' THEN ', Start time ' WHEN 'click' THEN ', End time ' "
           f"ELSE ', TOTAL EXECUTION TIME ' END, {STAMP_SQL})")


@query(f"WITH l AS (SELECT event_id, {STAMP_SQL} AS t, event_type FROM events WHERE user_id % 3 = 1), g AS (SELECT *, "
       "lag(event_type) OVER (ORDER BY event_id) AS before FROM l), o AS (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) "
       "OVER (ORDER BY event_id) AS opener, last_value(CASE WHEN event_type <> 'click' THEN t END IGNORE NULLS) OVER (ORDER BY event_id) AS opened FROM g) "
       "SELECT CASE WHEN opener = 'view' THEN opened END AS start_time, t AS end_time FROM o WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1")
def run_intervals(spark, d):
    kind = F.when(F.col("event_type") == "view", ", Start time ").when(F.col("event_type") == "click", ", End time ").otherwise(", TOTAL EXECUTION TIME ")
    log = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(
        F.lit("RUN"), (F.col("user_id") % 3).cast("string"), kind, stamp()).alias("value"))
    out = seq.run_intervals(log, "RUN1")
    return out.select(stamp("start_time").alias("start_time"), stamp("end_time").alias("end_time"))


@query("SELECT event_id, round(avg(sqrt(value)) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS running FROM events")
def running_mean(spark, d):
    out = seq.running_mean(table(spark, d, "events").select("event_type", "event_id", (F.sqrt("value")).alias("value")), ["event_type"], ["event_id"], "value")
    return _rounded(out.select("event_id", "running"), ["running"])


@query(f"WITH r AS ({_RUNS}) SELECT method, size, round(seconds / first_value(seconds) OVER w, 6) AS normalized, "
       "round(first_value(seconds) OVER w / seconds, 6) AS speedup FROM r WINDOW w AS (PARTITION BY method ORDER BY size)")
def scaling_report(spark, d):
    from mselect.plans.reports import scaling_report as report

    return _rounded(report(_runs(spark, d)).select("method", "size", "normalized", "speedup"), ["normalized", "speedup"])


@query(f"WITH r AS ({_RUNS}) SELECT a.method, a.size, round(CASE WHEN a.method IN ('udaf', 'ma') THEN b.seconds ELSE a.seconds END, 1) AS data_transmission, "
       "round(CASE WHEN a.method IN ('udaf', 'ma') THEN 1 + a.seconds - b.seconds ELSE 1 END, 1) AS model_hopping FROM r a JOIN r b USING (size) WHERE b.method = 'ctq'")
def minus_baseline(spark, d):
    r = _runs(spark, d).withColumnRenamed("seconds", "data_transmission").withColumn("model_hopping", F.lit(1.0))
    return _rounded(seq.minus_baseline(r, "ctq"), ["data_transmission", "model_hopping"], 1)


@query("WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
       "SELECT event_id, user_id, i // 16 AS batch FROM p WHERE i // 16 < n // 16")
def minibatch_index(spark, d):
    return seq.minibatch_index(table(spark, d, "events").select("event_id", "user_id"), 16, ["event_id"], ["user_id"], drop_last=True)


@query("SELECT event_id, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS micros FROM events")
def relative_hours(spark, d):
    out = seq.relative_hours(table(spark, d, "events").select("event_id", "ts"), ["ts"])
    return out.select("event_id", F.round(F.col("ts") * 3.6e9).cast("long").alias("micros"))


@query("SELECT o_orderkey, i AS epoch, round(o_custkey + (o_totalprice - o_custkey) * i / 10.0, 4) AS x FROM orders, range(1, 11) t(i)")
def linspace_epochs(spark, d):
    x = seq.linspace_epochs(F.col("o_custkey").cast("double"), F.col("o_totalprice"), 10)
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(x).alias("i", "x")).select("o_orderkey", (F.col("i") + 1).alias("epoch"), F.round("x", 4).alias("x"))


@query(f"WITH {JOBS_SQL}, f AS (SELECT model_key, min(start_time) AS m FROM jobs GROUP BY 1), o AS (SELECT model_key, row_number() OVER (ORDER BY m, model_key) AS ordinal FROM f) "
       "SELECT event_id, dist_key AS task, ordinal, epoch_us(start_time) - (SELECT min(epoch_us(start_time)) FROM jobs) AS start_micros, "
       "CAST(event_id % 50 AS DOUBLE) AS total_time FROM jobs JOIN o USING (model_key)")
def job_gantt(spark, d):
    j = jobs(spark, d).withColumn("end_time", F.timestamp_add("SECOND", (F.col("event_id") % 50).cast("int"), F.col("start_time")))
    out = seq.job_gantt(j, worker="dist_key", model="model_key")
    return out.select("event_id", "task", "ordinal", F.round(F.col("start_time") * 3.6e9).cast("long").alias("start_micros"), "total_time")


@query("WITH b AS (SELECT user_id AS batch, min(value) AS error FROM events GROUP BY 1) SELECT batch, error, min(error) OVER (ORDER BY batch) AS best FROM b")
def search_best(spark, d):
    from mselect.plans.reports import search_best as report

    return report(table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("value").alias("error")))


# ---- ranking, sampling, splitting

@query("SELECT l_orderkey, model, batch_size, ordinal FROM (SELECT l_orderkey, l_returnflag AS model, CAST(l_quantity AS INT) AS batch_size, l_partkey AS ordinal FROM lineitem)")
def sort_configs(spark, d):
    return rank.sort_configs(table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("int").alias("batch_size"), F.col("l_partkey").alias("ordinal")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 20")
def limit_offset(spark, d):
    return rank.limit_offset(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, 20, ["o_totalprice", "o_orderkey"])


_BEST = ("m AS (SELECT epoch, model_key, avg(metric_valid) AS v, avg(loss_valid) AS l FROM jobs GROUP BY ALL), "
         "w AS (SELECT model_key FROM m WHERE epoch = (SELECT max(epoch) FROM m) ORDER BY {} LIMIT 1)")


@query(f"WITH {JOBS_SQL}, {_BEST.format('v DESC, model_key')} SELECT epoch, model_key, round(1 - v, 6) AS y FROM m JOIN w USING (model_key)")
def best_model(spark, d):
    return _rounded(rank.best_model(jobs(spark, d)), ["y"])


@query(f"WITH {JOBS_SQL}, {_BEST.format('l, model_key')} SELECT epoch, model_key, round(l, 6) AS y FROM m JOIN w USING (model_key)")
def best_model_loss(spark, d):
    return _rounded(rank.best_model(jobs(spark, d), "loss"), ["y"])


@query(f"WITH r AS (SELECT {', '.join(_MODE)} FROM events), m AS (SELECT epoch, mst_key, config, avg(error) AS e, avg(error_1) AS e1 FROM r WHERE mode = 'VALID' GROUP BY ALL), "
       "w AS (SELECT mst_key FROM m WHERE epoch = (SELECT max(epoch) FROM m) ORDER BY e1, mst_key LIMIT 1) SELECT epoch + 1 AS epoch, round(e1, 6) AS error "
       "FROM m JOIN w USING (mst_key)")
def find_best(spark, d):
    return _rounded(rank.find_best(table(spark, d, "events").selectExpr(*_MODE), "da", top_5=False), ["error"])


_DDP = ["CAST(event_id % 5 AS INT) AS epoch", "CAST(user_id % 8 AS INT) AS model_index", "CASE WHEN user_id % 3 = 0 THEN 'train' ELSE 'valid' END AS mode",
        "value / 503 AS acc_top5", "value / 607 AS acc_top1", "value AS loss"]


@query(f"WITH r AS (SELECT {', '.join(_DDP)} FROM events), m AS (SELECT epoch, model_index, avg(acc_top5) AS a FROM r WHERE mode = 'valid' GROUP BY ALL), "
       "w AS (SELECT model_index FROM m WHERE epoch = (SELECT max(epoch) FROM m) ORDER BY a DESC, model_index LIMIT 1) "
       "SELECT epoch + 1 AS epoch, round(1 - a, 6) AS error FROM m JOIN w USING (model_index)")
def learning_curve(spark, d):
    from mselect.plans.reports import learning_curve as report

    return _rounded(report(table(spark, d, "events").selectExpr(*_DDP), "ddp"), ["error"])


@query("WITH m AS (SELECT user_id AS model_id, event_id % 5 AS e, avg(value / 503) AS v FROM events GROUP BY ALL), f AS (SELECT model_id FROM m WHERE e = 4 "
       "ORDER BY v DESC, model_id LIMIT 1) SELECT e + 1 AS epoch, round(1 - v, 6) AS error FROM m JOIN f USING (model_id)")
def find_best_by_final_metric(spark, d):
    means = table(spark, d, "events").groupBy(F.col("user_id").alias("model_id"), (F.col("event_id") % 5).alias("e")).agg(F.avg(F.col("value") / 503).alias("v"))
    rows = agg.ordered_values(means, ["model_id"], "e", "v", "validation_metrics")
    rows = rows.withColumn("metrics_iters", F.sequence(F.lit(1), F.size("validation_metrics"))).withColumn(
        "validation_metrics_final", F.when(F.size("validation_metrics") == 5, F.element_at("validation_metrics", -1)))
    return _rounded(rank.find_best(rows, "udaf"), ["error"])


@query("SELECT event_id, value FROM events")
def sort_by_final_metric(spark, d):
    return rank.sort_by_final_metric(table(spark, d, "events").select("event_id", "value"), "value")


@query("SELECT event_id, value FROM events")
def shuffle(spark, d):
    return rank.shuffle(table(spark, d, "events").select("event_id", "value"), 2018, "event_id")


def _permutation_sql(seed: int, epochs: int, batch: int) -> str:
    """The network over every cell of the rectangle, a table a round, then walks back into the range."""
    steps = []
    for r, (f, s, g) in enumerate(permuting.round_keys(seed)):
        t = f"((r * {f} + epoch * {g} + {s}) % {permuting.WORD})"
        steps.append(f"r{r + 1} AS (SELECT x, epoch, r AS l, (l + (({t} * {t}) >> 15)) % (SELECT {'b' if r % 2 else 'a'} FROM s) AS r FROM r{r})")
    return (f"WITH RECURSIVE c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM events), s AS (SELECT n, a, (n + a - 1) // a AS b FROM c), "
            f"r0 AS (SELECT x, epoch, x % (SELECT a FROM s) AS l, x // (SELECT a FROM s) AS r FROM range((SELECT a * b FROM s)) q(x), range(1, {epochs + 1}) e(epoch)), "
            f"{', '.join(steps)}, cells AS (SELECT x, epoch, r * (SELECT a FROM s) + l AS v FROM r{permuting.ROUNDS}), "
            "walk AS (SELECT x, epoch, v FROM cells WHERE x < (SELECT n FROM s) UNION ALL "
            "SELECT w.x, w.epoch, cells.v FROM walk w JOIN cells ON cells.x = w.v AND cells.epoch = w.epoch WHERE w.v >= (SELECT n FROM s)) "
            f"SELECT event_id, epoch, v AS shuffled, v // {batch} AS minibatch, v % {batch} AS \"offset\" FROM walk "
            "JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS x FROM events) USING (x) WHERE v < (SELECT n FROM s)")


@query(_permutation_sql(2018, 3, 32))
def shuffled_epochs(spark, d):
    from mselect.operators.sequence import Ordered

    e = Ordered(table(spark, d, "events").select("event_id"), [], ["event_id"]).position().done()
    return permuting.shuffled_epochs(e, e.count(), 2018, 32, 3).drop("pos")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('42|', o_orderkey)), o_orderkey) AS r, count(*) OVER () AS n FROM orders) "
       "WHERE r <= round_even(0.025 * n, 0)")
def sample_exact(spark, d):
    return rank.sample_exact(table(spark, d, "orders").select("o_orderkey"), 0.025, 42, "o_orderkey")


@query("SELECT event_id, CAST(CAST('0x' || substr(md5(concat('2018|', event_id)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 AS INT) AS validation FROM events")
def split_rows(spark, d):
    return rank.split_rows(table(spark, d, "events").select("event_id"), keys=["event_id"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 8")
def sanity_head(spark, d):
    return rank.sanity_head(table(spark, d, "orders").select("o_orderkey"), 8, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def single(spark, d):
    return rank.single(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 7, "o_orderkey")
