import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from mselect.functions.features import argmax
from mselect.operators import packing as pack
from mselect.operators import relational as rel


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, [float(i), float(i % 7)], "abc"[i % 3]) for i in range(101)], "id bigint, x array<float>, y string").cache()


@pytest.mark.parametrize("limit", [None, 5])
def test_unpack_restores_rows(data, limit):
    packed, summary = pack.pack_train(data, 8, 4, blocks=limit)
    assert summary.first().class_values == ["a", "b", "c"]
    sizes = rows(packed.select("dist_key", "buffer_id", F.col("dependent_var_shape")[0]))
    for k in range(4):
        mine = [n for key, _, n in sizes if key == k]
        assert mine[:-1] == [8] * (len(mine) - 1) and 0 < mine[-1] <= 8
        assert [b for key, b, _ in sizes if key == k] == list(range(len(mine)))
    back = pack.unpack(packed).select(F.col("x")[0].cast("int").alias("i"), argmax("y").alias("c"))
    assert rows(back) == [(i, i % 3) for i in sorted(range(101), key=lambda i: repr((i, i % 3)))]


def test_validation_reuses_classes(spark, data):
    _, summary = pack.pack_train(data.where("y <> 'a'"), 8, 2, norm=2.0)
    valid = pack.pack_valid(data.where("id < 3"), summary, 8, 1)
    r = valid.first()
    assert r.dependent_var == [[0, 0], [1, 0], [0, 1]] and r.unseen == 1
    assert r.independent_var[2] == [1.0, 1.0]


def test_unpack_fails_on_uneven_buffers(spark):
    bad = spark.createDataFrame([(0, 0, [[1.0], [2.0]], [[1]])], "dist_key int, buffer_id int, independent_var array<array<float>>, dependent_var array<array<smallint>>")
    with pytest.raises(Exception, match="differ in length"):
        pack.unpack(bad).collect()


def test_flat_index_wraps(spark):
    p = spark.createDataFrame([(0, 0, [3, 1]), (0, 1, [2, 1]), (1, 0, [4, 1])], "dist_key int, buffer_id int, dependent_var_shape array<int>")
    got = [r[1:] for r in rows(pack.flat_index(p, 7)) if r[0] == 0]
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1), (5, 0, 0), (6, 0, 1)]
    assert len(rows(pack.flat_index(p))) == 9
    assert rows(pack.flat_index(p)) == rows(pack.flat_index(p, blocks=40))


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([([[1.5, 2.0], [3.0, -1.0]], [2, 2]), (None, [0, 0])], "x array<array<float>>, s array<int>")
    raw = df.select(pack.to_bytes("x").alias("b"), "s").cache()
    assert bytes(raw.first().b) == np.array([[1.5, 2], [3, -1]], dtype="<f4").tobytes()
    assert [r[0] for r in raw.select(pack.from_bytes("b", "s")).collect()] == [[[1.5, 2.0], [3.0, -1.0]], None]


def test_chunks(spark):
    parts = [(1, 0, "abc"), (1, 1, "de"), (2, 0, "ab"), (2, 1, "c"), (3, 0, "abc"), (1, 1, "de"), (9, 0, "x")]
    chunks = spark.createDataFrame(parts, "id int, seq int, data string")
    pointers = spark.createDataFrame([(1, 5), (2, 3), (3, 4)], "id int, total int")
    assert rows(pack.reassemble_chunks(chunks, pointers, 3)) == [(1, "abcde", 2, True), (2, "abc", 2, False), (3, "abc", 1, False)]


@pytest.mark.parametrize("workers", [8, 4, 2, 1])
def test_layouts(spark, workers):
    m = pack.worker_layout(spark.range(workers).withColumnRenamed("id", "worker"), workers)
    got = rows(pack.placement(m))
    assert sorted(p for _, p in got) == list(range(8)) and {w: sum(x == w for x, _ in got) for w, _ in got} == {w: 8 // workers for w in range(workers)}


def test_redistribute_evens_out(spark, data):
    packed = pack.pack(data, 4, 1, ["a", "b", "c"]).drop("unseen")
    moved = pack.redistribute(packed, 3)
    assert rows(pack.unpack(moved).select(F.col("x")[0])) == rows(pack.unpack(packed).select(F.col("x")[0]))
    assert moved.select("dist_key").distinct().count() == 3


def test_hosts(spark):
    seg = spark.createDataFrame([(-1, "p", "m"), (0, "p", "h1"), (1, "p", "h1"), (2, "p", "h2"), (3, "m", "h3")], "content int, role string, hostname string")
    dev = spark.createDataFrame([("h1",), ("h3",), ("m",)], "hostname string")
    assert rows(rel.hosts_with_device(seg, dev)) == [("h1",)]
    assert rows(rel.by_host_counts(seg, dev).select("hostname", "segment_id", "devices", "shared")) == [("h1", 0, 1, True), ("h1", 1, 1, True), ("h2", 2, 0, False)]


@pytest.mark.parametrize("kind", ["double", "boolean", "int", "date"])
def test_valid_table_takes_classes_of_any_type(spark, kind):
    df = spark.range(12).select(F.col("id"), F.array(F.lit(1.0)).alias("x"), (
        F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 2).cast("int")) if kind == "date" else (F.col("id") % 2).cast(kind)).alias("y"))
    _, summary = pack.pack_train(df, 4, 2)
    valid = pack.pack_valid(df, summary, 4, 2)
    assert valid.agg(F.sum("unseen")).first()[0] == 0 and valid.first().dependent_var_shape[1] == 2


def test_very_many_classes(spark):
    """A million classes: no cap, no values in the plan, one place a row."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select("id", F.array(F.lit(1.0)).alias("x"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("y"))
    classes = pack.class_table(df)
    packed = pack.pack(df.where("id % 1000 = 7"), 50, 4, classes, sparse=True)
    assert len(packed._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = packed.select("dependent_var", "dependent_var_shape", "unseen").collect()
    assert sorted(c for r in got for (c,) in r.dependent_var) == list(range(7, n, 1000))
    assert all(r.dependent_var_shape[1] == n and r.unseen == 0 for r in got)


def test_sparse_labels_are_the_dense_ones(spark):
    rows_ = [(i, [float(i)], None if i == 5 else "abcz"[i % 4]) for i in range(20)]
    df = spark.createDataFrame(rows_, "id bigint, x array<double>, y string")
    args = (df, 6, 2, ["a", "b", "c"])
    dense = pack.pack(*args).orderBy("dist_key", "buffer_id").collect()
    assert pack.dense_labels(pack.pack(*args, sparse=True)).orderBy("dist_key", "buffer_id").collect() == dense
    assert sum(r.unseen for r in dense) == 6


def test_locate_meets_flat_index(spark):
    p = spark.createDataFrame([(0, 0, [3, 1]), (0, 1, [0, 1]), (0, 2, [2, 1]), (1, 0, [1, 1]), (1, 1, [9, 1]), (1, 2, [1, 1]), (2, 0, [0, 1])],
                              "dist_key int, buffer_id int, dependent_var_shape array<int>")
    asked = spark.createDataFrame([(k, i, "x") for k in (0, 1, 2, 7, None) for i in range(-3, 30)] + [(0, None, "y"), (0, 1, "z"), (0, 1, "z")],
                                  "dist_key int, i int, buffer_id string")
    index = {(k, i): (b, o) for k, i, b, o in pack.flat_index(p).collect()}
    total = {0: 5, 1: 11}
    for wrap in (False, True):
        for blocks in (None, 5):
            got = pack.locate(asked, p, wrap, blocks=blocks)
            assert got.columns == ["dist_key", "i", "buffer_id", "offset"]
            want = []
            for k, i, _ in asked.collect():
                at = i % total[k] if wrap and k in total and i is not None else i
                want.append((k, i, *index.get((k, at), (None, None))))
            assert rows(got) == sorted(want, key=repr)
    assert pack.locate(asked, p.where("false")).where("buffer_id IS NULL").count() == asked.count()
    assert pack.locate(asked.where("false"), p).count() == 0


def test_locate_enters_few_bins(spark):
    """One huge buffer among small ones doesn't fill the bins of all."""
    p = spark.createDataFrame([(0, b, [100000 if b == 5 else 3, 1]) for b in range(200)], "dist_key int, buffer_id int, dependent_var_shape array<int>")
    asked = spark.range(0, 100597, 7).select(F.lit(0).alias("dist_key"), F.col("id").alias("i"))
    got = pack.locate(asked, p)
    assert got.where("buffer_id IS NULL").count() == 0
    assert got.where("buffer_id = 5 AND `offset` <> i - 15").count() == 0 and got.where("buffer_id > 5").count() > 80
