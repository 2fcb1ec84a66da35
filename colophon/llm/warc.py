"""Converter of legacy ARC archives to WARC.

An ARC record is one header line and as many bytes as the line declares.  Version 1 lines hold url,
IP address, 14-digit date, content type and length; version 2 adds result code, checksum, location,
offset and file name before the length.  From them the converter makes the parts of a WARC record:
an identifier (a name-based UUID of the record's key and digest), an ISO timestamp, a type by scheme
and content, and SHA-1 digests of block and payload in bare base32.

Archives are written by Spark's text writer, one record a line with ``\\r\\n\\r\\n`` as line end,
compressed, in files of bounded size.  Records of equal payloads become revisits of the first.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colophon.llm.common import mapped, slices, table
from colophon.session import reuse, shared_folder

#: fields of a header line by version
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length")}
BYTES_AT_ONCE = 4 << 20
#: bytes of records in one archive file, about
FILE_BYTES = 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = re.compile(r"[\x00-\x20\x7f]")


class ArcError(ValueError):
    """A header line or a declared length that does not hold."""


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_record(url: str, body: bytes, version: int = 1, ip: str = "0.0.0.0", date: str = "20000101000000", mime: str = "text/html") -> bytes:
    """A record of a legacy archive; white space and controls of the url are percent-encoded."""
    values = {"url": SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-", "ip": ip, "date": date, "mime": mime, "code": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def read_arc(data: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """Records of one or more archives.  A version block, where one leads, tells the version of what follows."""
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError("a header line without end")
        parts = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        opens = parts[0].startswith("filedesc://")
        known = 1 if opens and len(parts) == len(FIELDS[1]) else 2 if opens else version
        if known is None:
            known = 2 if len(parts) == len(FIELDS[2]) else 1
        if len(parts) != len(FIELDS[known]):
            raise ArcError(f"{len(parts)} fields in a header of version {known}")
        head = dict(zip(FIELDS[known], parts))
        if not head["length"].isdigit() or end + 1 + int(head["length"]) > len(data):
            raise ArcError("a declared length that the archive does not hold")
        body = data[end + 1 : end + 1 + int(head["length"])]
        at = end + 1 + len(body)
        if opens:  # the block's second line begins with the version number
            number = body.split(b" ", 1)[0]
            version = int(number) if number in (b"1", b"2") else known
        yield ArcRecord(head["url"], head["ip"], head["date"], head["mime"], body)


def timestamp(date: str) -> str:
    """ISO form of a date of 4 to 14 digits; what is missing is the earliest, and no digits are 1970."""
    digits = re.match(r"\d*", date)[0]
    padded = (digits if len(digits) >= 4 else "1970")[:14]
    padded += "00000101000000"[len(padded) :]
    return f"{padded[:4]}-{padded[4:6]}-{padded[6:8]}T{padded[8:10]}:{padded[10:12]}:{padded[12:14]}Z"


def payload_of(record: ArcRecord) -> bytes:
    """What follows the HTTP headers of a response; all of any other body."""
    if not record.body.startswith(b"HTTP/"):
        return record.body
    head, blank, payload = record.body.partition(b"\r\n\r\n")
    return payload if blank else b""


def kind_of(record: ArcRecord) -> str:
    if record.url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if record.body.startswith(b"HTTP/") else "resource"


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def warc_record(record: ArcRecord, key: object, refers_to: object = None) -> str:
    """The WARC record without its closing line breaks.  A revisit keeps the HTTP headers and the digest."""
    payload = payload_of(record)
    digest = sha1(payload)
    block = record.body if refers_to is None else record.body[: len(record.body) - len(payload)]
    kind = kind_of(record) if refers_to is None else "revisit"
    mime = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response", "revisit": "application/http; msgtype=response"}.get(kind, record.mime)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {timestamp(record.date)}", f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", f"X-Payload-Length: {len(payload)}", f"X-Key: {'' if key is None else key}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block.decode("utf-8", "replace")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError("not at the beginning of a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[at:end].decode().split("\r\n")[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record that does not end where it declares")
        at = end + 8 + n
        yield head, block


def arcs(pages: DataFrame) -> DataFrame:
    """Legacy records of pages: ``page_id``, ``version`` (1 and 2 in turn) and ``arc``; null html is empty."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BYTES_AT_ONCE):
            versions = [2 if (k or 0) % 2 else 1 for k in batch.column("page_id").to_pylist()]
            made = [arc_record(u or "", HTTP + (h or "").encode(), v) for u, h, v in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), versions)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(versions, pa.int32()), pa.array(made, pa.binary())], ["page_id", "version", "arc"])

    return mapped(rows, work, f"page_id {kind}, version int, arc binary")


def digested(records: DataFrame) -> DataFrame:
    """The rows of ``arcs`` with digest and size of the payload."""
    fields = records.schema.simpleString()[7:-1].replace(":", " ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "arc", BYTES_AT_ONCE):
            payloads = [payload_of(next(read_arc(a, v))) for a, v in zip(batch.column("arc").to_pylist(), batch.column("version").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sha1(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())], [*batch.schema.names, "payload_digest", "payload_bytes"])

    return mapped(records, work, f"{fields}, payload_digest string, payload_bytes bigint")


def converted(records: DataFrame) -> DataFrame:
    """WARC records of rows ``page_id``, ``version``, ``arc`` and ``refers_to``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "arc", BYTES_AT_ONCE):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "version", "arc", "refers_to")]
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(next(read_arc(a, v)), k, r) for k, v, a, r in zip(*columns)], pa.string())], ["value"])

    return mapped(records.select("page_id", "version", "arc", "refers_to"), work, "value string")


def write_archives(pages: DataFrame, least_bytes: int = 0) -> str:
    """Writes a WARC record a row of ``pages`` and returns the archives' folder.

    Of rows with equal payloads of ``least_bytes`` bytes or more, the one of the least ``page_id`` is
    the response (with its like, if that id repeats) and the others revisit it; rows without an id
    revisit too, unless no row has one.
    """
    small = reuse(digested(arcs(pages)).select("page_id", "payload_digest", "payload_bytes"), "digests")
    size, n = small.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    again = small.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    full = digested(arcs(pages)).join(again, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    folder = shared_folder(pages.sparkSession, "warc")
    per_file = max(1, int(FILE_BYTES // (size / n + 1024))) if n else 1
    converted(full).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """Every record of the archives: key, payload size and digest (checked against the payload), type, key referred to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 1):
            rows = []
            for head, block in read_warc(zlib.decompress(batch.column("content")[0].as_py(), 31)):
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                payload = payload_of(ArcRecord("", "", "", "", block))
                if head["warc-type"] != "revisit" and sha1(payload) != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} fails its digest")
                key, refers = head["x-key"], head.get("x-refers-to-key")
                rows.append((int(key) if key else None, int(head["x-payload-length"]), digest, head["warc-type"], int(refers) if refers else None))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return mapped(files, work, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op10_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """Contract: converts every page to WARC, reads the archives back, and describes each record."""
    return read_archives(spark, write_archives(table(spark, sf_dir, "pages")))
