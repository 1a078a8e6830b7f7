"""Lines keep their places whatever the byte ranges, as a table and as a stream."""

import io
import random

import pytest

from conftest import rows
from mselect.sources import loglines
from mselect.streaming.streams import drain


def serial(data):
    out, at = [], 0
    while at < len(data):
        feed = data.find(b"\n", at)
        end = len(data) if feed < 0 else feed
        out.append((at, data[at:end]))
        at = end + 1
    return out


def test_any_split_gives_a_serial_read(monkeypatch):
    random.seed(1)
    for case in range(300):
        monkeypatch.setattr(loglines, "READ_BYTES", random.choice([1, 2, 3, 7, 64]))
        data = bytes(random.choice(b"ab\n\n\r ") if case % 2 else random.choice(b"abcdefghij\n") for _ in range(random.randrange(60)))
        size = random.randrange(1, 12)
        got = [x for r in loglines.cut("f", 0, len(data), size) for x in loglines.lines_of(io.BytesIO(data), r.begin, r.end)]
        assert got == serial(data), (data, size)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "logs"
    (root / "sub").mkdir(parents=True)
    (root / "a.log").write_bytes(b"one  \n\ntwo\xff\nthree" + "ä".encode() * 50 + b"\n" + b"x" * 5000 + b"\nlast")
    (root / "sub" / "b.log").write_bytes(b"\n" * 40)
    (root / "empty.log").write_bytes(b"")
    (root / "_SUCCESS").write_bytes(b"hidden\n")
    (root / ".a.crc").write_bytes(b"hidden\n")
    return root


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_table(spark, folder, size):
    got = rows(loglines.read_log_ranges(spark, str(folder), size))
    want = [(str(f), at, line.decode("utf-8", "replace").rstrip(" ")) for f in (folder / "a.log", folder / "sub" / "b.log")
            for at, line in serial(f.read_bytes())]
    assert got == sorted(want, key=repr)


def test_one_file_none_and_missing(spark, folder, tmp_path):
    assert loglines.read_log_ranges(spark, f"file:{folder}/sub/b.log", 3).count() == 40
    (tmp_path / "none").mkdir()
    assert loglines.read_log_ranges(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        loglines.read_log_ranges(spark, str(tmp_path / "absent")).count()


def test_stream_reads_appended_lines_once(spark, tmp_path):
    logs, out = tmp_path / "in", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a").write_bytes(b"1\n2\nhal")
    (logs / "b").write_bytes(b"")

    def go():
        return rows(drain(loglines.stream_log_ranges(spark, str(logs), 3), out).select("offset", "value"))

    assert go() == sorted([(0, "1"), (2, "2")], key=repr)
    (logs / "d").write_bytes(b"no line yet")
    assert len(go()) == 2
    with open(logs / "a", "ab") as f:
        f.write(b"f\n\nend")
    (logs / "c").write_bytes(b"new\n")
    assert go() == sorted([(0, "1"), (2, "2"), (4, "half"), (9, ""), (0, "new")], key=repr)


def test_small_ranges_share_tasks_and_read_little_more_than_their_bytes(tmp_path):
    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            block = super().read(n)
            Counted.total += len(block)
            return block

    data = b"".join(b"%d line\n" % i for i in range(400_000))
    (tmp_path / "a").write_bytes(data)
    parts = loglines._TableReader({"path": str(tmp_path), "rangeBytes": "4096"}).partitions()
    assert [(p.begin, p.end, p.size) for p in parts] == [(0, 4 << 20, 4096), (4 << 20, len(data), 4096)]
    assert [p.end - p.begin for p in loglines.tasks("f", 0, 300 << 20, 64 << 20)] == [64 << 20] * 4 + [44 << 20]
    got = [x for r in loglines.cut("a", 0, len(data), 4096) for x in loglines.lines_of(Counted(data), r.begin, r.end)]
    assert got == serial(data) and Counted.total < 4 * len(data)
