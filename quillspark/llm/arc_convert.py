"""Legacy web archives: ARC files, their conversion to WARC, and reading WARC back.

ARC and WARC files are written by Spark's text writer, a record per value, and gzip-compressed as whole files,
so any file system that Spark knows will do. Each file is bounded by a number of records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names of a record line by archive version, as the version block declares them. Fixed by the format.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
BATCH_BYTES = 4 << 20
PARSED = "page_id long, url string, date string, content_type string, http string, payload binary, payload_bytes long, payload_digest string"


def _inflate(content: bytes) -> bytes:
    """The bytes of a file of gzip members, or content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out)


def write_arc(pages: DataFrame, path: str, file_records: int = 4000, date: str = "20240101000000") -> None:
    """Write pages(page_id, url, html) as ARC files; files of odd partitions are version 2, the others version 1.

    A record's content is an HTTP response whose X-Page-Id header carries the page's id. White space and
    control characters in URLs are percent-encoded, as the record line is split at spaces; a null URL is "-".
    Null html is an empty body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, written = ("2" if part % 2 else "1"), 0
        fields = FIELDS[version]
        for b in batches:
            values, size = [], 0
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if written % file_records == 0:
                    about = f"{version} 0 quillspark\n{' '.join(fields)}\n"
                    head = {"URL": f"filedesc://part-{part}-{written}.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(about))}
                    values.append(" ".join(head.get(f, "-") for f in fields) + "\n" + about)
                written += 1
                body = html or ""
                n = len(body.encode())
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {n}\r\n\r\n"
                at = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url) if url else "-"
                head = {"URL": at, "IP-address": "192.0.2.1", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(http) + n)}
                values.append(f"{' '.join(head.get(f, '-') for f in fields)}\n{http}{body}")
                size += n
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
                    values, size = [], 0
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    # the first of every file_records + 1 values of a partition is a version block, so each file begins with one
    pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", file_records + 1).text(path)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, content) of the records of one ARC file, without version blocks."""
    at, fields = 0, FIELDS["1"]
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(line[-1])
        body = content[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record of {length} bytes at {at} is cut off")
        at = end + 1 + length
        if line[0].startswith("filedesc:"):
            version = body.split(b" ", 1)[0].decode("ascii", "replace")
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = FIELDS[version]
            continue
        if len(line) != len(fields):
            raise ValueError(f"record line has {len(line)} fields, version {'2' if len(fields) > 5 else '1'} has {len(fields)}")
        yield dict(zip(fields, line, strict=True)), body


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, body, and header fields of an HTTP response; all is body if it is none."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, {}
    head = block[: cut + 4]
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return head, block[cut + 4 :], {k.strip().lower(): v.strip() for k, v in pairs}


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], weigh: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    for r in rows:
        held.append(r)
        size += 200 + len(r[weigh] or b"")
        if size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _page_id(fields: dict[str, str]) -> int | None:
    return int(fields["x-page-id"]) if fields.get("x-page-id") else None


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files of either version: page_id, url, date, content_type, http, payload, its bytes and SHA-1."""

    def parse(content: bytes) -> Iterator[tuple]:
        for line, block in arc_records(content):
            head, body, fields = _http(block)
            d = line["Archive-date"]
            date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
            yield _page_id(fields), line["URL"], date, line["Content-type"], head.decode("utf-8", "replace"), body, len(body), hashlib.sha1(body).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        for b in batches:
            for content in b.column(0):
                yield from _batches(parse(_inflate(content.as_py())), kinds, 5)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, PARSED)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, file_records: int = 4000) -> None:
    """Convert ARC files to WARC/1.1 response and revisit records.

    Identifiers come from what a record holds, so a rerun gives the same ones; timestamps from the archive
    date; digests are SHA-1 of the payload. Of records with equal payloads of at least LEAST_REVISIT bytes the
    one with the largest page id is a response and the others revisit it; records without an id are
    responses. Repeated rows of the largest id are all responses.

    Digests are pre-aggregated before the shuffle and only those that occur twice are joined back; a very
    common payload makes one skewed join key, which AQE splits.
    """
    records = read_arc(spark, arc_path)
    groups = records.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("least_id"))
    groups = groups.where("first_id > least_id").select(F.col("payload_digest").alias("digest"), "first_id")
    on = (records["payload_digest"] == groups["digest"]) & (records["payload_bytes"] >= LEAST_REVISIT) & (records["page_id"] < groups["first_id"])
    r = records.join(groups, on, "left")
    revisit = F.col("first_id").isNotNull()
    uuid = lambda page: F.regexp_replace(F.md5(F.concat_ws("\n", F.lit("warc"), page.cast("string"), "payload_digest")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    block = F.concat(F.col("http"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid(F.coalesce("page_id", F.lit(-1))), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uuid(F.col("first_id")), F.lit(">"))), line("WARC-Refers-To-Page", F.col("first_id")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length),
        F.lit("\r\n"),
    )
    r.select(F.concat(head, block).alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(warc_path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of one WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = content[at:end].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head[1:])}
        length = int(fields["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length or content[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"record of {length} bytes at {at} is cut off")
        yield fields, block
        at = end + 8 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id.

    The payload of a response is measured and must have the digest its header states; a revisit has its
    payload's length and digest from its headers.
    """

    def parse(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(content):
            _, body, http = _http(block)
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            if len(digest) == 32:
                digest = base64.b32decode(digest).hex()
            size = int(http.get("content-length", 0))
            if kind == "response":
                size = len(body)
                if hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
            refers = fields.get("warc-refers-to-page")
            yield _page_id(http), size, digest, kind, int(refers) if refers else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string())]
        for b in batches:
            for content in b.column(0):
                yield from _batches(parse(_inflate(content.as_py())), kinds, 5)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)
