"""ARC to WARC: exact round trips, both versions, revisits."""

import gzip
from hashlib import sha256

import pytest

from mselect.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a b/", "20200102030405", "text/html", b"one\n\ntwo"), ("", "2020", "", b""), ("u", "bad", "x", b"\n" * 5)]
    got = list(warc.parse_arc(warc.arc_bytes(records, version, "n.arc")))
    assert [r["data"] for r in got] == [r[3] for r in records]
    assert [r["date"] for r in got] == ["2020-01-02T03:04:05Z", "2020-01-01T00:00:00Z", None]
    assert [r["uri"] for r in got] == ["http://a%20b/", "-", "u"] and all(r["problem"] is None for r in got)


def test_arc_breaks():
    data = warc.arc_bytes([("u", "2020", "t", b"0123456789")], 1, "n")
    assert [r["problem"] for r in warc.parse_arc(data[:-5])] == ["length"]
    assert [r["problem"] for r in warc.parse_arc(data + b"no header\n")] == [None, "header line"]
    assert list(warc.parse_arc(b"")) == []


def pages():
    long = "é" * 60
    return [(1, "http://x/1", long), (5, "http://x/5", long), (3, None, long), (2, "u\nv", "short"), (4, "u", "short"), (6, "u", None),
            (7, "u", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 10), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 10), (1, "again", long),
            (None, "none", long)]


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(*p, 0) for p in pages()], "page_id long, url string, html string, record_id int")
    marked = warc.mark_revisits(warc.arc_records(warc.pages_to_arc(df, file_bytes=200)))
    path = str(tmp_path / "out")
    warc.write_warc(marked, path, 2)
    got = warc.read_warc(spark, path).collect()
    least = {}
    for i, _, t in pages():
        b = (t or "").encode()
        if i is not None and len(b) >= 100:
            least[b] = min(i, least.get(b, i))
    want = []
    for i, _, t in pages():
        b = (t or "").encode()
        first = least.get(b)
        revisit = first is not None and i is not None and i != first
        want.append((i, len(b), sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, ((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    assert {r.date for r in got} == {"2024-01-01T00:00:00Z"}
    ids = {r.record_id: r for r in got}
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 1
    for f in files:
        for fields, _ in warc.parse_warc(gzip.decompress(f.read_bytes())):
            if fields["warc-type"] == "revisit":
                assert ids[fields["warc-refers-to"]].source_id == int(fields["warc-refers-to-source-id"])


def test_real_files_and_the_empty_table(spark, tmp_path):
    data = warc.arc_bytes([("http://x/", "20200102030405", "image/png", b"\x89PNG\r\n\r\n")], 2, "n")
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(data))
    row = warc.arc_records(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(bytes(r.payload), r.mime, r.source_id) for r in row] == [(b"\x89PNG\r\n\r\n", "image/png", None)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    out = str(tmp_path / "none")
    warc.write_warc(warc.mark_revisits(warc.arc_records(warc.pages_to_arc(empty))), out)
    assert warc.read_warc(spark, out).collect() == []
