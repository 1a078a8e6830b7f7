import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.functions import architecture as arch
from mselect.functions import configs, features, logs


def test_buckets_at_every_boundary(spark):
    bounds = [1.5 ** j - 0.51 for j in range(50)]
    values = sorted({int(np.floor(b)) + k for b in bounds for k in (-1, 0, 1, 2)} | {-5, -1, 0, 1, 2**40, -(2**40)})

    def slow(v):
        if v == 0:
            return None
        for i, b in enumerate(bounds):
            if v < b:
                return i
        return 49

    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", features.bucketize("v").alias("b")).collect()
    assert {r.v: r.b for r in got} == {v: slow(v) for v in values}
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS v").select(features.bucketize("v")).first()[0] is None


def test_murmur3_known_values(spark):
    # published test values of the 32-bit x86 variant with seed 0
    known = {"": 0, "a": 1009084850, "hello": 613153351, "hello, world": 345750399, "The quick brown fox jumps over the lazy dog": 776992547}
    df = spark.createDataFrame([(k,) for k in known], "s string")
    assert {r[0]: r[1] for r in df.select("s", features.murmur3("s")).collect()} == known
    arrays = spark.createDataFrame([(list(known) + [None],), ([],)], "a array<string>").select(features.murmur3_all("a")).collect()
    assert [r[0] for r in arrays] == [list(known.values()) + [None], []]


def test_encode_fields(spark):
    good = ["1"] + ["3"] * 13 + ["ab"] * 26
    absent = ["0"] + ["0"] * 13 + ["0"] * 26
    df = spark.createDataFrame([(good,), (absent,), (["1", "2"],)], "f array<string>")
    r = features.encode_fields(df, "f").collect()
    h = 256 and spark.sql("SELECT 'ab' AS s").select(F.pmod(features.murmur3("s"), F.lit(256))).first()[0]
    assert r[0].idx == [f * 50 + 4 for f in range(13)] + [650 + f * 256 + h for f in range(26)]
    assert set(r[0].val) == {1.0} and r[0].label == "1" and not r[0].malformed
    assert r[1].idx == [] and not r[1].malformed
    assert r[2].idx == [] and r[2].malformed


def test_dense_sparse_round_trip(spark):
    df = spark.createDataFrame([([1, 4], [2.0, 3.0])], "i array<bigint>, v array<float>")
    dense = df.select(features.sparse_to_dense("i", "v", 6).alias("d"))
    assert dense.first()[0] == [0, 2, 0, 0, 3, 0]
    assert dense.select(features.dense_to_sparse("d").alias("s")).select("s.*").first() == ([1, 4], [2.0, 3.0])


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (-1,), (None,)], "y int")
    assert [r[0] for r in df.select(features.one_hot("y", 3)).collect()] == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0]]


@pytest.mark.parametrize("value", [1e-4, 1e-6, 1.5e-4, 1e-5, 0.001, 0.1, 0.00012, 3.25e-7, 0.0, 1.0])
def test_number_text_as_python(spark, value):
    assert spark.range(1).select(configs.number_text(F.lit(value))).first()[0] == str(value)


def test_config_key_round_trip(spark):
    df = spark.createDataFrame([(1e-4, 1e-6, 32, "vgg 16")], configs.CONFIG_SCHEMA).select(F.struct("*").alias("c"))
    keyed = df.select(configs.config_key("c").alias("k"), configs.config_label("c").alias("l"))
    assert keyed.first() == ("batch_size:32|lambda_value:1e-06|learning_rate:0.0001|model:vgg_16",
                             "learning_rate:0.0001,lambda_value:1e-06,batch_size:32,model:vgg 16")
    assert keyed.select(configs.parse_config_key("k").alias("p")).select("p.*").first() == (1e-4, 1e-6, 32, "vgg_16")


def test_parse_kv_strict(spark):
    df = spark.createDataFrame([("A: 1, B: 2",), ("A: 1, bad",)], "value string")
    assert df.select(logs.parse_kv("value").alias("m")).collect()[1].m == {"A": "1"}
    with pytest.raises(Exception, match="malformed"):
        df.select(logs.parse_kv("value", strict=True)).collect()


def test_event_lines(spark):
    def info(line, style):
        return spark.createDataFrame([(line,)], "v string").select(logs.parse_event_line("v", style).alias("e")).select("e.info", F.col("e.t").cast("string")).first()

    assert info("INFO: Start x: 2021-01-01 00:00:01  (seg0 slice1)", "notice") == ("Start x", "2021-01-01 00:00:01")
    assert info("a: b: 2021-01-01 00:00:01", "client") == ("a: b", "2021-01-01 00:00:01")
    assert info("End loading data 3: 2021-01-01 00:00:01", "ddp")[0] == "End loading data"
    assert info("TIME: 60, EVENT: TRAIN_LAUNCHED, WORKER: 0", "unix") == ("TRAIN_LAUNCHED", "1970-01-01 00:01:00")
    assert info("nothing here", "client")[1] is None


def test_disk_and_network_lines(spark):
    text = "Device: tps MB_read/s MB_wrtn/s MB_read MB_wrtn sda 1 2 3 40 50 sdb 1 2 3 4 5 "
    d = spark.range(1).select(logs.parse_disk(F.lit(text)).alias("d")).first().d
    assert [(x.device, x.MB_read, x.MB_wrtn) for x in d] == [("sda", 40.0, 50.0), ("sdb", 4.0, 5.0)]
    for bad in (text.replace("sdb 1", "sdb x"), text.replace("sda 1 2", "sda 1 -"), text[:-5]):
        assert spark.range(1).select(logs.parse_disk(F.lit(bad)).alias("d")).first().d is None
    n = spark.range(1).select(logs.parse_net(F.lit("CONTROL_IFACE: eth0, rxkB/s: 1.5, txkB/s: 2")).alias("n"), logs.parse_net(F.lit("x: 1")).alias("m")).first()
    assert n.n == {"rxkB/s": 1.5, "txkB/s": 2.0} and n.m is None


def test_architecture(spark):
    layers = '[{"class_name":"Dense","config":{"batch_input_shape":[null,4],"units":10}},{"class_name":"Activation","config":{}}]'
    df = spark.createDataFrame([('{"config":%s}' % layers,), ('{"config":{"layers":%s}}' % layers,)], "a string")
    assert rows(df.select(arch.arch_input_shape("a"), arch.num_classes("a"), arch.layer_text("a"))) == [
        ([4], 10, "Model arch layers:\nDense[10]\n   |\n   V\nActivation\n")] * 2
    for bad in ('{"config":3}', '{"config":[{"class_name":"A","config":{}}]}'):
        with pytest.raises(Exception, match="architecture"):
            spark.createDataFrame([(bad,)], "a string").select(arch.num_classes("a")).collect()


def test_unflatten_checks_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "w array<float>")
    ok = df.select(arch.unflatten_weights("w", F.expr("array(array(1, 2), array(1))"))).first()[0]
    assert ok == [[1.0, 2.0], [3.0]]
    with pytest.raises(Exception, match="shapes"):
        df.select(arch.unflatten_weights("w", F.expr("array(array(4))"))).collect()


def test_lines_of_one_worker_by_whole_number(spark):
    lines = spark.createDataFrame([("a WORKER: 1, x",), ("WORKER: 10",), ("(seg1 host)",), ("(seg10 host)",), ("",)], "value string")
    assert rows(logs.lines_of_worker(lines, 1, "unix")) == [("a WORKER: 1, x",)]
    assert rows(logs.lines_of_worker(lines, 10, "db")) == [("(seg10 host)",)]


def test_encode_row_hashes_all_texts_in_one_call(spark):
    values = [("a", "0", None), ("", "ä", "x"), (None, None, None), ("0", "b" * 90, "a")]
    df = spark.createDataFrame([(i, 3, *v) for i, v in enumerate(values)], "y int, n int, a string, b string, c string")
    for hashes in (256, 100):
        out = features.encode_row(df, "y", ["n"], ["a", "b", "c"], "md5", hashes=hashes)
        single = df.select("y", *[features.hash_bucket(c, hashes, "md5").alias(c) for c in "abc"]).collect()
        want = {r.y: [50 + f * hashes + r[c] for f, c in enumerate("abc") if r[c] is not None] for r in single}
        assert {r.label: r.idx[1:] for r in out.collect()} == want
        assert "md5(" not in out._jdf.queryExecution().executedPlan().toString()
    assert features.encode_row(df, "y", ["n"], [], "md5").count() == 4 and features.encode_row(df.limit(0), "y", ["n"], ["a"], "md5").collect() == []
