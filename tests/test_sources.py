import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.operators import relational as rel
from mselect.plans import reports
from mselect.plans.phases import PHASES_OF_EVENTS, phase_table
from mselect.sources import readers, sinks


def test_click_file(spark, tmp_path):
    full = "\t".join(["1"] + ["5"] * 13 + ["x"] * 26)
    gaps = "\t".join(["0"] + [""] * 13 + [""] * 26)
    (tmp_path / "c.tsv").write_text(f"{full}\n{gaps}\n")
    df = readers.read_click_tsv(spark, str(tmp_path / "c.tsv"))
    assert len(df.columns) == 40
    assert rows(df.select("_c0", "_c1", "_c39")) == [(0, 0, "0"), (1, 5, "x")]


def test_dataset_from_files(spark, tmp_path):
    for i, name in enumerate(("v", "t")):
        spark.createDataFrame([([1.0, 2.0], [i])], "features array<double>, labels array<int>").write.parquet(str(tmp_path / name))
    df = readers.read_dataset(spark, [str(tmp_path / "v")], [str(tmp_path / "t")])
    assert rows(df) == [([1.0, 2.0], [0.0], 1), ([1.0, 2.0], [1.0], 0)]


def test_unload_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, [i + 0.5, 2.0], i % 3) for i in range(20)], "id bigint, x array<float>, y int")
    sinks.unload_parts(df, str(tmp_path / "out"), 4)
    files = list((tmp_path / "out").glob("part-*"))
    assert 0 < len(files) <= 4
    assert rows(readers.read_array_text(spark, str(tmp_path / "out"))) == rows(df)


def test_array_text_nested_and_digits(spark):
    df = spark.createDataFrame([("7|{{1,2},{3e1,4}}|01",)], "value string")
    assert df.select(readers.parse_array_text("value", "list").alias("r")).select("r.*").first() == (7, [1, 2, 30, 4], [0, 1])


def test_run_log_order_over_many_splits(spark, tmp_path):
    lines = [f"line {i}  " for i in range(20000)]
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_run_log(spark, str(tmp_path / "run.log"))
        assert df.rdd.getNumPartitions() > 3
        assert [r.value for r in df.orderBy("file", "pos").collect()] == [x.rstrip() for x in lines]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_monitor_folder_to_report(spark, tmp_path):
    for w, base in (("worker0", 10), ("worker1", 30), ("master", 90)):
        text = "\n".join(f"2021-01-01 00:00:0{i}\n{base + i}%,50%" for i in range(4))
        (tmp_path / f"cpu_utilization_{w}.log").write_text(text + "\n")
    logs = readers.read_monitor_logs(spark, str(tmp_path))
    assert {r[0] for r in logs.select("worker").distinct().collect()} == {"worker0", "worker1", "master"}
    got = reports.utilization(logs, "2021-01-01 00:00:01", "2021-01-01 00:00:03").first()[0]
    assert got == pytest.approx((11.5 + 31.5) / 2)


def test_list_partitions(spark, tmp_path):
    for n in ("b.npz", "a.npz", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = rows(readers.list_partitions(spark, str(tmp_path), "npz"))
    assert [(p.rsplit("/", 1)[-1], n) for p, n in got] == [("a.npz", 0), ("b.npz", 1)]


def test_rank_metrics_file(spark, tmp_path):
    (tmp_path / "all_logs_rank2_index5.json").write_text('{"0": {"train": {"train_loss": 1.0, "train_acc_top1": 0.5, "train_acc_top5": 0.75}, "valid": {"valid_loss": 2.0}}}\n')
    assert rows(readers.read_rank_metrics(spark, str(tmp_path))) == [(0, "train", 1.0, 0.5, 0.75, 2, 5), (0, "valid", 2.0, None, None, 2, 5)]


def _png(path, width, height):
    import struct
    import zlib

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_dirs(spark, tmp_path):
    _png(tmp_path / "cat" / "a.png", 4, 2)
    _png(tmp_path / "cat" / "b.png", 4, 2)
    _png(tmp_path / "dog" / "c.png", 3, 3)
    _png(tmp_path / "stray.png", 1, 1)
    df = readers.read_image_dirs(spark, str(tmp_path))
    assert rows(df.select("label", "img_name", "width", F.length("x"))) == [("cat", "a.png", 4, 24), ("cat", "b.png", 4, 24), ("dog", "c.png", 3, 27)]
    assert {r[0] for r in readers.read_image_dirs(spark, str(tmp_path), 1).select("label").collect()} == {"cat"}
    _png(tmp_path / "dog" / "d.png", 4, 3)
    with pytest.raises(ValueError, match="dog"):
        readers.read_image_dirs(spark, str(tmp_path))


@pytest.fixture
def name(spark):
    n = "t_lifecycle"
    sinks.drop_table(spark, n)
    yield n
    sinks.drop_table(spark, n)


def test_table_life_cycle(spark, name):
    df = spark.createDataFrame([([1.0], [1])], "x array<double>, y array<int>")
    with pytest.raises(ValueError, match="does not exist"):
        sinks.load_table(df, name, append=True)
    sinks.load_table(df, name, paired=("x", "y"))
    with pytest.raises(ValueError, match="exists already"):
        sinks.load_table(df, name)
    sinks.load_table(df, name, append=True)
    assert spark.table(name).count() == 2
    sinks.truncate(spark, name)
    assert spark.table(name).count() == 0 and sinks.table_exists(spark, name)
    with pytest.raises(Exception, match="differ in length"):
        sinks.load_table(spark.createDataFrame([([1.0, 2.0], [1])], "x array<double>, y array<int>"), name, True, ("x", "y"))


def test_load_many(spark, tmp_path, name):
    for n in "ab":
        spark.createDataFrame([(n,)], "v string").write.parquet(str(tmp_path / n))
    paths = [str(tmp_path / n) for n in "ab"]
    assert sinks.load_many(spark, paths, name) and not sinks.load_many(spark, paths, name)
    assert sinks.load_many(spark, paths, name, force=True)
    assert rows(spark.table(name)) == [("a",), ("b",)]


def test_read_cached(spark, name):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.read_cached(spark, name, build).count() == 3
    assert len(calls) == 1
    readers.read_cached(spark, name, build, force=True)
    assert len(calls) == 2


def test_epoch_state_replaces_one_epoch(spark, tmp_path):
    p = str(tmp_path / "state")
    sinks.save_epoch_state(spark.range(2), p, 1)
    sinks.save_epoch_state(spark.range(3), p, 2)
    sinks.save_epoch_state(spark.range(1), p, 2)
    assert rows(spark.read.parquet(p).groupBy("epoch").count()) == [(1, 2), (2, 1)]


def test_partition_pruning_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "packed")
    spark.range(40).selectExpr("id", "CAST(id % 4 AS INT) AS dist_key").write.partitionBy("dist_key").parquet(p)
    plan = rel.target_partition(spark.read.parquet(p), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dist_key" in plan


def test_lookup_errors(spark):
    df = spark.createDataFrame([("f1",)], "file string")
    truth = spark.createDataFrame([("f1", 9)], "file string, class_index int")
    mapping = spark.createDataFrame([(0, "cat")], "line int, label_text string")
    with pytest.raises(Exception, match="no label for f1"):
        rel.relabel(df, truth, mapping).collect()
    with pytest.raises(LookupError):
        rel.lookup_model(mapping.withColumnRenamed("label_text", "name"), "dog")
    events = spark.createDataFrame([("boo",)], "event string")
    with pytest.raises(Exception, match="unknown event boo"):
        rel.map_events(events, phase_table(spark, "ma")).collect()


def test_phase_tables():
    assert {m: len(v) for m, v in PHASES_OF_EVENTS.items()} == {"ctq": 22, "ma": 16, "udaf": 16, "ctq_old": 16, "standalone": 7, "ddp": 17}


def test_phase_breakdown_of_a_standalone_log(spark):
    lines = ["TIME: 10, EVENT: PRELOAD_COMPLETED, WORKER: 0", "TIME: 12, EVENT: TRAIN_LAUNCHED, WORKER: 0",
             "TIME: 20, EVENT: TRAIN_COMPLETED, WORKER: 0", "TIME: 21, EVENT: VALID_LAUNCHED, WORKER: 0", "TIME: 25, EVENT: VALID_COMPLETED, WORKER: 0"]
    log = spark.createDataFrame([(0, i, v) for i, v in enumerate(lines)], "worker int, pos int, value string")
    got = reports.phase_breakdown(log, phase_table(spark, "standalone"), "unix")
    assert rows(got) == [("idle", 3.0), ("train_valid", 12.0)]


def test_marker_shift(spark):
    span = spark.sql("SELECT TIMESTAMP_NTZ '2021-01-01 00:00:00' AS start_time, TIMESTAMP_NTZ '2021-01-02 00:00:00' AS end_time")
    log = spark.sql("SELECT TIMESTAMP_NTZ '2021-01-01 05:00:00' AS t, 'go now' AS value")
    assert rel.shift_start(span, log=log, marker="go").first()[0] == dt.datetime(2021, 1, 1, 5)
    assert rel.shift_start(span, seconds=60).first()[0] == dt.datetime(2021, 1, 1, 0, 1)
    with pytest.raises(ValueError):
        rel.shift_start(span, log=log, marker="stop")
