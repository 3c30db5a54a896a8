"""Legacy ARC archives, their conversion to WARC, and the reading of WARC archives.

``parse_arc`` reads the version block, learns from it which fields a header line has, and takes as many bytes as each
line declares. ``convert`` turns each record into a WARC record with an identifier, timestamp, type and digest of the
same meaning. Archives are written by Spark's own committer as compressed text whose rows end in the two line breaks
that end a WARC record, so a lost executor leaves no half-written archive, and any file system that Spark writes to
will do. A file holds so few records that its bytes are bounded too. Reading takes archive files as binary and goes
through them record by record, by declared lengths.

Version 1 lines: URL, IP address, date, content type, length. Version 2 lines: URL, IP address, date, content type,
result code, checksum, location, offset, file name, length.

Defined results: a null payload counts as empty and a null URL as "-"; payloads of at least ``min_revisit_bytes`` that
are equal share one response, that of the smallest page_id, and shorter ones are all responses; rows that repeat this
smallest page_id are responses too; a null page_id comes back as null and comes after all others, so such rows are
revisits of a page with an id, or all responses if none has one; very long payloads get files of fewer records; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, scratch_path, small_batches

#: Fields of the header lines of both versions, as the formats fix them.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
END = "\r\n\r\n"
#: Bytes of payload in one archive file at most (a longer one has a file of its own), and records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 1 << 29, 2000
PAGE_HEADER = "X-Page-Id"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    version: int


def arc_version_block(version: int, name: str, date: str) -> bytes:
    fields = {
        1: "URL IP-address Archive-date Content-type Archive-length",
        2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
    }[version]
    body = f"{version} 0 quarry\n{fields}\n\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body


def arc_record(version: int, url: str, date: str, body: bytes, name: str = "-", offset: int = 0) -> bytes:
    url = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    if version == 1:
        head = f"{url} 0.0.0.0 {date} text/html {len(body)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} text/html 200 - - {offset} {name} {len(body)}\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive after its version block, which says how to read their header lines."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        at = stop + 1
        if line[0].startswith("filedesc:"):
            length = int(line[-1])
            version = int(data[at : at + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            at += length
            continue
        if not version:
            raise ValueError("an ARC archive begins with its version block")
        names = ARC_FIELDS[version]
        if len(line) != len(names):
            raise ValueError(f"{len(line)} fields in a header line of version {version}")
        field = dict(zip(names, line, strict=True))
        length = int(field["length"])
        if at + length > len(data):
            raise ValueError("an ARC record is shorter than it declares")
        yield ArcRecord(field["url"], field["ip"], field["date"], field["content_type"], data[at : at + length], version)
        at += length


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message, with the empty line, and its payload; all is payload if it isn't HTTP."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    stop = body.find(b"\r\n\r\n")
    return (body, b"") if stop < 0 else (body[: stop + 4], body[stop + 4 :])


def record_id(url: str, date: str, key: str) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{date} {url} {key}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(record: ArcRecord, original: tuple[str, str, str] | None = None, key: str = "") -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of ``original`` (record id, URL, date)."""
    head, payload = http_parts(record.body)
    if record.content_type == "text/html" and head or record.url.startswith("http"):
        kind, media = "response", "application/http; msgtype=response"
    else:
        kind, media = "resource", record.content_type
    block = record.body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else kind}",
        f"WARC-Record-ID: {record_id(record.url, record.date, key)}",
        f"WARC-Date: {warc_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if original:
        block = head
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {original[0]}",
            f"WARC-Refers-To-Target-URI: {original[1]}",
            f"WARC-Refers-To-Date: {original[2]}",
        ]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def parse_warc(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC archive, read one after the other."""
    while first := archive.readline():
        if not first.strip(b"\r\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
        fields = {}
        while line := archive.readline().decode("utf-8", "surrogatepass").rstrip("\r\n"):
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = archive.read(length)
        if len(block) < length:
            raise ValueError("a WARC record is shorter than it declares")
        yield fields, block


def page_arc(page_id: int | None, url: str, payload: bytes, date: str) -> bytes:
    """A page as an ARC archive of one record; odd pages in version 2, the others in version 1."""
    version = 1 + (page_id or 0) % 2
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = arc_version_block(version, "pages.arc", date)
    return block + arc_record(version, url, date, head.encode() + payload, "pages.arc", len(block))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "20240101000000") -> None:
    """Pages (page_id, url, html) as compressed WARC archives under ``path``, by way of ARC records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    first = (
        keyed.filter(F.col("n") >= min_revisit_bytes)
        .groupBy("digest", "n")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
        .select(F.col("digest").alias("d"), F.col("n").alias("m"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    marked = keyed.join(first, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")

    def run(batches):
        for batch in small_batches(batches, 500):
            out = []
            for x in batch.to_pylist():
                (record,) = parse_arc(page_arc(x["page_id"], x["url"], x["html"].encode("utf-8", "surrogatepass"), date))
                original = None
                if x["first_id"] is not None and x["first_id"] != x["page_id"]:
                    original = (record_id(x["first_url"] or "-", date, str(x["first_id"])), x["first_url"] or "-", warc_date(date))
                out.append(convert(record, original, str(x["page_id"])).decode("utf-8"))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    # Pages of usual length fill files of many records; the few longer ones get files of as many as fit.
    usual = ARCHIVE_BYTES // ARCHIVE_RECORDS
    longest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
    kinds = [(marked, ARCHIVE_RECORDS)]
    if longest > usual:
        kinds = [(marked.filter(F.col("n") <= usual), ARCHIVE_RECORDS), (marked.filter(F.col("n") > usual), max(1, ARCHIVE_BYTES // longest))]
    for part, records in kinds:
        made = part.select("page_id", "url", "html", "first_id", "first_url").mapInArrow(run, "value string")
        made.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: its page, digest of the payload, type and what it refers to."""
    schema = "record_id string, refers_to_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string"

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                stream = io.BytesIO(data.as_py())
                rows = []
                for f, block in parse_warc(gzip.GzipFile(fileobj=stream) if stream.getbuffer()[:2] == b"\x1f\x8b" else stream):
                    head, payload = http_parts(block)
                    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:] if x)}
                    kind = f["warc-type"]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        size = int(http["content-length"])
                    else:
                        size = len(payload)
                        if sha1_base32(payload) != digest:
                            raise ValueError(f"the payload of {f['warc-record-id']} is not what its digest says")
                    rows.append({"record_id": f["warc-record-id"], "refers_to_id": f.get("warc-refers-to"), "record_type": kind, "target_uri": f["warc-target-uri"], "page_id": int(http[PAGE_HEADER.lower()]) if http[PAGE_HEADER.lower()] else None, "payload_bytes": size, "payload_digest": digest})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARCHIVE_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


ARCHIVE_SCHEMA = pa.schema([("record_id", pa.string()), ("refers_to_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read these back, and name the page that each revisit refers to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    records = materialize(read_archives(spark, path), "warc-records")
    named = records.filter("record_type <> 'revisit'").select(F.col("record_id").alias("rid"), F.col("page_id").alias("named"))
    wanted = records.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("rid")).distinct()
    named = named.join(wanted, "rid", "left_semi").groupBy("rid").agg(F.min("named").alias("named"))
    out = records.join(named, F.col("refers_to_id") == F.col("rid"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("named").alias("refers_to"), "record_id", "target_uri")
