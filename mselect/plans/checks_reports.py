"""Checked queries: reports on runs and streams, over log lines derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mselect.plans import reports as rep
from mselect.plans.base import STAMP_SQL, query, stamp, table
from mselect.streaming import streams

_TYPES = ["click", "error", "purchase", "signup", "view"]


def _notice(spark, d):
    return table(spark, d, "events").select(
        (F.col("user_id") % 8).alias("worker"), F.col("event_id").alias("pos"),
        F.concat(F.lit("INFO: "), "event_type", F.lit(": "), stamp(), F.lit("  (seg"), (F.col("user_id") % 8).cast("string"), F.lit(" slice1)")).alias("value"))


def _phases(spark):
    rows = [(f"Between-{a}-{b}", "idle" if a == b else "train_valid" if b in ("view", "click") else "data_transmission")
            for a in _TYPES for b in _TYPES]
    return spark.createDataFrame(rows, "event STRING, phase STRING")


@query("WITH g AS (SELECT event_type AS b, lag(event_type) OVER w AS a, epoch(date_trunc('second', ts)) - epoch(lag(date_trunc('second', ts)) OVER w) AS s "
       "FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY date_trunc('second', ts), event_id)) SELECT CASE WHEN a = b THEN 'idle' "
       "WHEN b IN ('view', 'click') THEN 'train_valid' ELSE 'data_transmission' END AS phase, CAST(sum(s) AS DOUBLE) AS seconds FROM g WHERE a IS NOT NULL GROUP BY 1")
def phase_breakdown(spark, d):
    return rep.phase_breakdown(_notice(spark, d), _phases(spark))


_METHODS = ["ctq", "udaf", "ma", "da", "spark"]
_METHOD_SQL = "CASE user_id % 5 WHEN 0 THEN 'ctq' WHEN 1 THEN 'udaf' WHEN 2 THEN 'ma' WHEN 3 THEN 'da' ELSE 'spark' END"
_PHASE_SQL = ("CASE WHEN event_id % 7 = 0 THEN 'model_hopping' WHEN event_id % 7 = 1 THEN 'merge' WHEN event_type = 'view' THEN 'train_valid' WHEN event_type = 'click' THEN 'idle' "
              "WHEN event_type = 'error' THEN 'initialization' WHEN event_type = 'signup' THEN 'exiting' ELSE 'data_transmission' END")


@query(f"WITH e AS (SELECT {_METHOD_SQL} AS method, event_id % 4 AS size, {_PHASE_SQL} AS phase, sqrt(value) AS s FROM events), "
       "p AS (SELECT method, size, coalesce(sum(s) FILTER (phase IN ('train_valid', 'initialization', 'exiting')), 0) AS tv, coalesce(sum(s) FILTER (phase = 'data_transmission'), 0) AS dt, "
       "coalesce(sum(s) FILTER (phase = 'model_hopping'), 0) AS mh, coalesce(sum(s) FILTER (phase IN ('idle', 'merge')), 0) AS own FROM e GROUP BY ALL), "
       "b AS (SELECT size, dt AS bdt, mh AS bmh FROM p WHERE method = 'ctq'), x AS (SELECT method, size, "
       "CASE WHEN method IN ('da', 'spark') THEN tv - 118 - bmh ELSE tv END AS train_valid, CASE WHEN method IN ('da', 'spark') THEN 118 WHEN method IN ('udaf', 'ma') THEN bdt ELSE dt END AS data_transmission, "
       "CASE WHEN method IN ('da', 'spark') THEN bmh WHEN method IN ('udaf', 'ma') THEN mh + dt - bdt ELSE mh END AS model_hopping, own AS method_specific FROM p JOIN b USING (size)) "
       "SELECT method, size, " + ", ".join(f"round({f} / (3600 * 8 * 5) * 1000, 6) AS {f}" for f in ("train_valid", "data_transmission", "model_hopping", "method_specific")) + " FROM x")
def per_epoch_breakdown(spark, d):
    rows = table(spark, d, "events").selectExpr(f"{_METHOD_SQL} AS method", "event_id % 4 AS size", f"{_PHASE_SQL} AS phase", "sqrt(value) AS seconds")
    out = rep.per_epoch_breakdown(rows, file_load_seconds=118.0)
    return out.select("method", "size", *[F.round(F.col(f) * 1000, 6).alias(f) for f in ("train_valid", "data_transmission", "model_hopping", "method_specific")])


def _log(spark, d, *lines, name="cpu_utilization"):
    """Two or three lines per event (timestamp, values), as a monitor of the event's worker would write them."""
    e = table(spark, d, "events").withColumn("line", F.array(stamp(), *lines))
    return e.select(F.concat(F.lit("worker"), (F.col("user_id") % 8).cast("string")).alias("worker"),
                    F.concat(F.lit(f"{name}_worker"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("file"),
                    F.col("event_id"), F.posexplode("line").alias("at", "value")).select(
        "worker", "file", F.struct("event_id", "at").alias("pos"), "value")


def _cpu(spark, d):
    # every eleventh value line is cut short and does not parse
    good = F.concat((F.col("user_id") % 100).cast("string"), F.lit("%,"), F.col("value").cast("string"), F.lit("%"))
    return _log(spark, d, F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(good))


@query(f"SELECT concat('worker', user_id % 8) AS worker, {STAMP_SQL} AS t, CAST(user_id % 100 AS DOUBLE) AS utilization, value AS memory FROM events WHERE event_id % 11 <> 0")
def pair_records(spark, d):
    out = rep.pair_records(_cpu(spark, d), "cpu")
    return out.select("worker", stamp("t").alias("t"), "utilization", "memory")


_START, _END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
_INSIDE = f"date_trunc('second', ts) >= TIMESTAMP '{_START}' AND date_trunc('second', ts) < TIMESTAMP '{_END}'"


@query(f"WITH m AS (SELECT user_id % 8 AS w, avg(user_id % 100) AS u, avg(value) AS v FROM events WHERE event_id % 11 <> 0 AND {_INSIDE} GROUP BY 1) "
       "SELECT round(avg(u), 5) AS utilization, round((SELECT avg(v) FROM m), 5) AS memory FROM m")
def utilization(spark, d):
    cpu = rep.utilization(_cpu(spark, d), _START, _END).select(F.lit(0).alias("k"), F.round("utilization", 5).alias("utilization"))
    memory = rep.utilization(_cpu(spark, d), _START, _END, value="memory").select(F.lit(0).alias("k"), F.round("memory", 5).alias("memory"))
    return cpu.join(memory, "k").drop("k")


@query(f"WITH k AS (SELECT user_id % 8 AS w, event_id AS a, event_id * 3 AS b FROM events WHERE {_INSIDE}), g AS (SELECT w, max(a) - min(a) AS r, max(b) - min(b) AS o FROM k GROUP BY 1) "
       "SELECT round(avg(r + o * 2), 5) AS mean_MB_io, round(sum(r + o * 2), 5) AS sum_MB_io FROM g")
def disk_report(spark, d):
    i, b = F.col("event_id").cast("string"), (F.col("event_id") * 3).cast("string")
    line = F.concat(F.lit("Device tps MB_read/s MB_wrtn/s MB_read MB_wrtn sda 0 0 0 "), i, F.lit(" "), b, F.lit(" sdb 0 0 0 5 "), b)
    out = rep.disk_report(_log(spark, d, line, name="disk"), _START, _END)
    return out.select(F.round("mean_MB_io", 5).alias("mean_MB_io"), F.round("sum_MB_io", 5).alias("sum_MB_io"))


@query(f"WITH n AS (SELECT user_id % 8 = 7 AS master, value AS rx FROM events WHERE {_INSIDE}) SELECT round(((SELECT avg(rx) FROM n WHERE master) + "
       "(SELECT avg(rx) FROM n WHERE NOT master) * 7) * 86400 * 15 / 1024 / 1024, 4) AS total_gb")
def network_report(spark, d):
    v = F.col("value").cast("string")
    control = F.concat(F.lit("CONTROL_IFACE: eth0, rxkB/s: "), v, F.lit(", txkB/s: 1.5"))
    exp = F.concat(F.lit("EXPERIMENT_IFACE: eth1, rxkB/s: "), v, F.lit(", txkB/s: "), v)
    lines = _log(spark, d, control, exp, name="network").withColumn("worker", F.when(F.col("worker") == "worker7", "master").otherwise(F.col("worker")))
    _, total = rep.network_report(lines, _START, _END)
    return total.select(F.round("total_gb", 4).alias("total_gb"))


@query("WITH l AS (SELECT event_id, event_type, epoch(date_trunc('second', ts)) AS t FROM events WHERE user_id % 3 = 1), o AS (SELECT *, "
       "last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id) AS opener, "
       "last_value(CASE WHEN event_type <> 'click' THEN t END IGNORE NULLS) OVER (ORDER BY event_id) AS opened FROM l) "
       "SELECT CASE WHEN opener IN ('view', 'error', 'signup', 'purchase') THEN round((t - opened) / 3600, 6) END AS hours FROM o WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1")
def run_time(spark, d):
    kind = F.when(F.col("event_type") == "click", ", End time ").otherwise(", Start time ")
    log = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(
        F.lit("RUN"), (F.col("user_id") % 3).cast("string"), kind, stamp()).alias("value"))
    return rep.run_time(log, "RUN1").select(F.round("hours", 6).alias("hours"))


@query("WITH k AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id "
       "ROWS UNBOUNDED PRECEDING) AS config, epoch(date_trunc('second', ts)) AS u FROM events) SELECT CAST(user_id AS INT) AS mst_key, CAST(event_id % 5 AS DOUBLE) AS epoch, "
       "CAST(u AS DOUBLE) AS unix_time, CASE WHEN event_type = 'view' THEN 'VALID' ELSE 'TRAIN' END AS mode, CASE WHEN event_type <> 'view' THEN value END AS train_loss, "
       "CASE WHEN event_type = 'view' THEN value END AS valid_loss, config FROM k WHERE event_type <> 'signup'")
def model_log_table(spark, d):
    unix = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("string")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("MST: "), "props")).otherwise(F.concat(
        F.lit("UNIX TIME: "), unix, F.lit(", EPOCH: "), (F.col("event_id") % 5).cast("string"),
        F.when(F.col("event_type") == "view", ", VALID LOSS: ").otherwise(", TRAIN LOSS: "), F.col("value").cast("string")))
    # the configuration ends at the second ": ", as a log line is cut there
    lines = table(spark, d, "events").select(F.concat(F.lit("/run/"), F.col("user_id").cast("string"), F.lit(".log")).alias("file"),
                                             F.col("event_id").alias("pos"), F.replace(line, F.lit('": '), F.lit('":')).alias("value"))
    out = rep.model_log_table(lines)
    return out.select("mst_key", "epoch", "unix_time", "mode", "train_loss", "valid_loss", F.replace("config", F.lit('":'), F.lit('": ')).alias("config"))


@query("WITH ends AS (SELECT user_id // 8 AS batch, event_id % 10 AS epoch, max(ts) AS t FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (ORDER BY batch, epoch) - 1 AS i FROM ends), "
       "m AS (SELECT user_id AS mst_idx, count(DISTINCT event_id % 10) AS n FROM events GROUP BY 1), q AS (SELECT *, (row_number() OVER (ORDER BY mst_idx) - 1) // 8 AS bag FROM m) "
       "SELECT q.bag, mst_idx, n, round((epoch_us(min(t)) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 6) AS first, count(*) AS points FROM q JOIN p ON i // 10 = bag "
       "AND true GROUP BY q.bag, mst_idx, n")
def search_report(spark, d):
    e = table(spark, d, "events")
    ends = e.groupBy(F.floor(F.col("user_id") / 8).alias("batch"), (F.col("event_id") % 10).alias("epoch")).agg(F.max("ts").alias("end_time"))
    means = e.groupBy(F.col("user_id").alias("mst_idx"), (F.col("event_id") % 10).alias("epoch")).agg(F.avg("value").alias("metric"))
    from mselect.operators.aggregates import metrics_as_list

    lists = metrics_as_list(means, "mst_idx")
    out = rep.search_report(ends, lists, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("bag", "mst_idx", F.size("validation_metrics").alias("n"), F.round(F.array_min("hours"), 6).alias("first"), F.size("hours").alias("points"))


# ---- streams

def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)


@query("WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS s, user_id % 8 AS k, sqrt(value) AS v FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, "
       "concat('worker', k) AS worker, round(avg(v), 6) AS utilization, count(*) AS n FROM w WHERE s + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE GROUP BY s, k")
def stream_utilization(spark, d):
    src = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("t"), F.concat(F.lit("worker"), (F.col("user_id") % 8).cast("string")).alias("worker"),
                                   F.sqrt("value").alias("utilization"))
    out = streams.drain(streams.stream_utilization(src))
    return out.select(stamp("window_start").alias("window_start"), "worker", F.round("utilization", 6).alias("utilization"), "n")


@query("SELECT CAST(user_id AS VARCHAR) AS worker, event, round(s, 6) AS seconds FROM (SELECT user_id, concat('Between-', lag(event_type) OVER w, '-', event_type) AS event, "
       "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE s IS NOT NULL")
def stream_event_gaps(spark, d):
    src = _stream(spark, d).select(F.col("user_id").alias("worker"), F.col("ts").alias("t"), F.col("event_type").alias("info"), F.col("event_id").alias("pos"))
    return streams.drain(streams.stream_event_gaps(src)).withColumn("seconds", F.round("seconds", 6))


@query("WITH g AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS e0, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events "
       "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT CAST(user_id AS VARCHAR) AS worker, concat('Between-', e0, '-', event_type) AS event, "
       "round(s, 6) AS seconds FROM g WHERE s <= 86400 AND ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_late_gaps(spark, d):
    src = _stream(spark, d).select(F.col("user_id").alias("worker"), F.col("ts").alias("t"), F.col("event_type").alias("info"), F.col("event_id").alias("pos"))
    return streams.drain(streams.stream_late_gaps(src)).withColumn("seconds", F.round("seconds", 6))
