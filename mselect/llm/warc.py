"""Legacy web archives (ARC, versions 1 and 2) to WARC.

An ARC file begins with a record that names the version and the fields of the header lines that follow. Each record is a header line,
as many bytes as its last field declares, and a newline. The converter gives each record what WARC asks for and ARC lacks: an
identifier made from the record itself, an ISO timestamp, a type and a digest. Copies of a payload become revisits.

Archives are read and written by Spark alone, so any store will do. A WARC record ends with two line ends, which is just the
line separator the text writer is given; reading goes by declared lengths.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mselect.llm.common import written

END = "\r\n\r\n"
#: Header fields of the two versions, as the archives name them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_STAMP = re.compile(r"\d{4,14}\Z")


def arc_bytes(records: list[tuple[str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (URL, date, content type, data) records."""
    def line(url: str, ip: str, date: str, kind: str, offset: int, length: int) -> bytes:
        first = [re.sub(r"\s", "%20", url) or "-", ip, date, re.sub(r"\s", "", kind) or "-"]
        more = [] if version == 1 else ["200", "-", "-", str(offset), name]
        return " ".join([*first, *more, str(length)]).encode() + b"\n"

    head = f"{version} 0 mselect\n{FIELDS[version]}\n\n".encode()
    out = [line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", 0, len(head)), head, b"\n"]
    at = sum(map(len, out))
    for url, date, kind, data in records:
        part = [line(url, "0.0.0.0", date, kind, at, len(data)), data, b"\n"]
        out += part
        at += sum(map(len, part))
    return b"".join(out)


def stamp(date: str) -> str | None:
    """An ISO 8601 time in UTC from the digits of an ARC date, of which the end may be missing; None if it isn't a time."""
    if not _STAMP.match(date):
        return None
    full = date + "00000101000000"[len(date):]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file but the first. A record that breaks off or has a bad header line is the last, with a ``problem``."""
    fields, at = None, 0
    while at < len(data):
        if data[at: at + 1] == b"\n" and fields:  # some writers leave an extra line
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at: stop if stop >= 0 else len(data)]
        begin = at + len(line) + 1
        names = fields or FIELDS[1].split()
        if fields is None and len(line.split(b" ")) >= 10:
            names = FIELDS[2].split()
        values = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            yield {"problem": "header line", "uri": None, "ip": None, "date": None, "mime": None, "data": b"", "line": line}
            return
        length = int(values[-1])
        body, at = data[begin: begin + length], begin + length + 1
        got = dict(zip(names, values))
        if fields is None:  # the version block: the version's number, then the names of the fields
            lines = body.decode("utf-8", "replace").split("\n")
            fields = lines[1].split() if len(lines) > 1 and len(lines[1].split()) >= 5 else names
            continue
        yield {"problem": None if len(body) == length else "length", "uri": got.get("URL"), "ip": got.get("IP-address"),
               "date": stamp(got.get("Archive-date", "")), "mime": got.get("Content-type"), "data": body, "line": line}


def split_http(data: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its empty line, and the payload; no head if it doesn't begin as one."""
    if not data.startswith(b"HTTP/"):
        return b"", data
    head, mark, payload = data.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", data)


def _header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb": *([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


_RECORD = ("record_id string, source_id long, uri string, date string, mime string, problem string, http binary, payload binary, "
           "payload_bytes long, payload_digest string")


def arc_records(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row for each record of ARC files given as bytes, for example by Spark's ``binaryFile`` reader; ``.gz`` bytes are unpacked.

    A null file has no record. ``source_id`` is the number in an ``X-Source-Id`` head line, if there is one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                out = {c.split()[0]: [] for c in _RECORD.split(", ")}
                for r in parse_arc(data):
                    http, payload = split_http(r["data"])
                    digest = sha256(payload).hexdigest()
                    own = sha256(b"\n".join((r["line"], http, digest.encode()))).digest()
                    source = _header(http, b"X-Source-Id")
                    row = (f"<urn:uuid:{uuid.UUID(bytes=own[:16], version=5)}>", int(source) if source else None, r["uri"], r["date"], r["mime"],
                           r["problem"], http, payload, len(payload), digest)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                if out["uri"]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(out.values(), [
                            pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.string()])], list(out))
    return archives.select(content).mapInArrow(run, _RECORD)


def mark_revisits(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add (record_type, refers_to, refers_id, refers_uri, refers_date).

    Of records with equal payloads of at least ``least_bytes`` those with the smallest source_id are responses and the others revisit the
    first of these; all others are responses. Only identifiers are compared and grouped; payloads travel once, by source_id.
    """
    ids = written(records.where(F.col("payload_bytes") >= least_bytes).select(
        "source_id", "record_id", "payload_digest", "uri", "date"), "identifiers")
    first = ids.where(F.col("source_id").isNotNull()).groupBy("payload_digest").agg(
        F.min(F.struct("source_id", "record_id", "uri", "date")).alias("first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1").drop("_n")
    later = ids.join(first, "payload_digest").where("source_id <> first.source_id").select(
        "record_id", F.col("first.source_id").alias("refers_to"), F.col("first.record_id").alias("refers_id"),
        F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date")).dropDuplicates(["record_id"])
    return records.join(later, "record_id", "left").withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def warc_text(marked: DataFrame) -> DataFrame:
    """(value) each record as WARC, without the two line ends that close it. Revisits keep the HTTP head alone."""
    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    one_line = F.regexp_replace("uri", r"[\r\n]", "%0A")
    is_http = F.octet_length("http") > 0
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(is_http | revisit, F.col("record_type")).otherwise("resource")),
        field("WARC-Record-ID", F.col("record_id")), field("WARC-Target-URI", one_line), field("WARC-Date", F.col("date")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), field("WARC-Source-Id", F.col("source_id")),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.col("refers_id")), field("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        field("WARC-Refers-To-Date", F.col("refers_date")), field("WARC-Refers-To-Source-Id", F.col("refers_to")),
        field("WARC-Payload-Length", F.when(revisit, F.col("payload_bytes"))),
        field("Content-Type", F.when(is_http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    return marked.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write_warc(marked: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write records as gzipped WARC files of at most ``records_per_file`` records below ``path``."""
    (warc_text(marked).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = stop + 4
        length = int(fields["content-length"])
        yield fields, data[begin: begin + length]
        at = begin + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, record_id, record_type, refers_to, payload_bytes, payload_digest, uri, date) of the WARC files below ``path``.

    Length and digest of a response are those of the payload read; a revisit has those it declares. One file is in memory at a time.
    """
    schema = ("source_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
              "uri string, date string")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows = []
                for f, block in parse_warc(gzip.decompress(cell.as_py()) if cell.as_py() else b""):
                    revisit = f["warc-type"] == "revisit"
                    payload = b"" if revisit else split_http(block)[1]
                    source, refers = f.get("warc-source-id"), f.get("warc-refers-to-source-id")
                    rows.append((int(source) if source else None, f["warc-record-id"], "revisit" if revisit else "response",
                                 int(refers) if refers else None, int(f["warc-payload-length"]) if revisit else len(payload),
                                 f["warc-payload-digest"].removeprefix("sha256:") if revisit else sha256(payload).hexdigest(),
                                 f.get("warc-target-uri"), f.get("warc-date")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)],
                                                     [c.split()[0] for c in schema.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, schema)


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = 4_000_000) -> DataFrame:
    """(content) pages as ARC files of about ``file_bytes``, versions 1 and 2 in turn. A null html is empty, a null url is ``-``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def flush():
            data = arc_bytes(held, 1 + number % 2, f"pages-{number}.arc")
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

        for batch in batches:
            for i in range(batch.num_rows):
                source, address, text = (batch.column(c)[i].as_py() for c in range(3))
                head = "HTTP/1.1 200 OK\r\n" + ("" if source is None else f"X-Source-Id: {source}\r\n") + "Content-Type: text/html\r\n\r\n"
                data = head.encode() + (text or b"")
                held.append((address or "-", "20240101000000", "text/html", data))
                size += len(data)
                if size >= file_bytes:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()
    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary")).mapInArrow(run, "content binary")
