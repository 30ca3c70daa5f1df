"""Legacy archive converter (op 9): ARC files to WARC records and archives, and back.

ARC version 1 header lines have five fields (URL, IP, date, type, length), version 2 ten (URL, IP, date, type, result code,
checksum, location, offset, file name, length); a file's first record says which. Bodies are cut by the declared
lengths alone. Each record becomes a WARC record with an identifier made from its content, a date from its
14 digits or fewer, a type by deduplication (response, or revisit of a record with an equal payload) and SHA-1 digests. A revisit
names its response by WARC-Refers-To, -Target-URI and -Date, and each archive begins with a warcinfo record.

ARC files are parsed twice: first for the keys of their records, on which types are found, so pages with equal payloads, however
many, are only keys in that join; then for the records themselves, each the compressed member of a response, which meet their types
by record identifier on the way to the archives. So no records lie on disk beside the shuffle and the archives; a revisit's member
is made anew. The pages must be the same at both readings.

An archive is a run of gzip members, one for each record, in a row of a Parquet table in the shared folder
(Spark has no writer of raw bytes); `export` writes the same bytes as .warc.gz files to a local folder.

Pages come without what a crawl knows, so `to_arc` makes it up from the page: version (by file), IP (from the host), date (some
with fewer digits) and content type.

Defined results: null html is an empty payload; null url is an empty one; of records with equal payloads of
at least MIN_REVISIT bytes the one with the largest page_id is the response; rows that share that page_id are all
responses, and equal rows have equal identifiers; null page_id is the smallest; further columns (of any name) are ignored; an empty
table gives none. A payload is held whole, some ten times. The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import materialise, ship_package

MIN_REVISIT = 0
LOWEST = -(1 << 63)
V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Bytes of records in one archive row.
ARCHIVE = 4 << 20


class ArcError(ValueError):
    pass


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    body: bytes


def _token(text: str) -> str:
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 256 else "%20", text) or "-"


def arc_file(records: list[ArcRecord], version: int = 1, name: str = "quill.arc") -> bytes:
    fields = V1 if version == 1 else V2
    about = b"%d 0 quill\n%s\n\n" % (version, fields)
    head = f"filedesc://{name} 0.0.0.0 19960101000000 text/plain"
    out = [f"{head} {len(about)}\n".encode() if version == 1 else f"{head} 200 - - 0 {name} {len(about)}\n".encode(), about, b"\n"]
    for r in records:
        line = f"{_token(r.url)} {r.ip} {r.date} {r.kind}"
        if version == 2:
            code = r.body[9:12].decode("ascii", "replace") if r.body.startswith(b"HTTP/") else "200"
            line += f" {code} - - 0 {name}"
        out += [f"{line} {len(r.body)}\n".encode(), r.body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block. A header that doesn't fit, or a length beyond the end, is an ArcError."""
    at, fields = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no end of the header line at {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if not fields:
            if not line[0].startswith("filedesc://"):
                raise ArcError("the file doesn't begin with a version block")
        elif len(line) != fields:
            raise ArcError(f"{len(line)} fields at {at}; the version has {fields}")
        try:
            size = int(line[-1])
        except ValueError:
            raise ArcError(f"no length at {at}") from None
        body = data[end + 1 : end + 1 + size]
        if size < 0 or len(body) < size:
            raise ArcError(f"{size} bytes declared at {at}, {len(body)} there")
        at = end + 1 + size
        if not fields:
            about = body.split(b"\n")
            fields = len(about[1].split()) if len(about) > 1 else 0
            if about[0].split()[0] not in (b"1", b"2") or fields not in (5, 10):
                raise ArcError(f"unknown version block {about[:2]!r}")
            continue
        yield ArcRecord(line[0], line[1], line[2], line[3], body)


def warc_date(digits: str) -> str:
    """ISO date of an ARC date; missing digits are the earliest, an impossible date is the epoch."""
    full = (re.sub(r"\D", "", digits) + "19960101000000"[len(re.sub(r"\D", "", digits)) :])[:14]
    try:
        return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a body without a head is all payload."""
    if body.startswith(b"HTTP/"):
        end = body.find(b"\r\n\r\n")
        if end >= 0:
            return body[: end + 4], body[end + 4 :]
    return b"", body


def record_id(url: str, date: str, digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page}')}>"


KINDS = ("text/html", "text/plain", "application/xhtml+xml", "no-type")


def crawled(page: int | None, url: str) -> tuple[str, str, str]:
    """IP, date and content type of a page, made up: the same page has the same, every seventh date lacks the time of day, every 29th the day."""
    k = zlib.crc32(repr(page).encode())
    host = zlib.crc32(url.split("/")[2].encode()) if url.count("/") > 1 else 0
    date = (datetime.datetime(1996, 1, 1) + datetime.timedelta(seconds=k % 400_000_000)).strftime("%Y%m%d%H%M%S")
    return f"10.{host >> 16 & 255}.{host >> 8 & 255}.{host & 255}", date[: 6 if k % 29 == 0 else 8 if k % 7 == 0 else 14], KINDS[k % 4 if k % 5 == 0 else 0]


def to_arc(pages: DataFrame, version: int | None = None) -> DataFrame:
    """Pages as ARC files of one version or of both, about ARCHIVE bytes each: column arc."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(tk.pieces(batches, "html", ARCHIVE)):
            records = []
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                ip, date, kind = crawled(page, url or "")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
                records.append(ArcRecord(url or "", ip, date, kind, head + (html or "").encode()))
            yield pa.RecordBatch.from_arrays([pa.array([arc_file(records, version or 1 + n % 2)], pa.binary())], names=["arc"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "arc binary")


def _page(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


KEYS = "page_id long, uri string, date string, payload_digest string, payload_bytes long, record_id string"
CONVERTED = "uri string, ip string, date string, head binary, payload_digest string, record_id string, member binary"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _parsed(arcs: DataFrame, schema: str, row: Callable[[ArcRecord, bytes, bytes, int | None, str, str, str], tuple]) -> DataFrame:
    """A row for each record of ARC files, made from the record, its head and payload, page, date, digest and identifier."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("arc"):
                rows = []
                for r in parse_arc(data.as_py()):
                    head, payload = split_http(r.body)
                    page, date, digest = _page(head), warc_date(r.date), sha1(payload)
                    rows.append(row(r, head, payload, page, date, digest, record_id(r.url, date, digest, page)))
                yield _batch(rows, schema)

    return arcs.mapInArrow(run, schema)


def keys(arcs: DataFrame) -> DataFrame:
    """What decides the types of the records of ARC files."""
    return _parsed(arcs, KEYS, lambda r, head, payload, page, date, digest, name: (page, r.url, date, digest, len(payload), name))


def convert(arcs: DataFrame) -> DataFrame:
    """The records of ARC files as responses: the gzip member of each, and what a revisit needs."""
    return _parsed(arcs, CONVERTED, lambda r, head, payload, page, date, digest, name: (r.url, r.ip, date, head, digest, name, _member(warc_record("response", name, r.url, r.ip, date, digest, r.body))))


def revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """record_id, and what the record refers to, of all keys with an equal payload in one of a larger page_id. They are combined map-side by digest and length; equal rows have one identifier and one row."""
    own = F.coalesce("page_id", F.lit(LOWEST))
    near = records.filter(F.col("payload_bytes") >= least).select(own.alias("own"), "uri", "date", "record_id", "payload_digest", "payload_bytes")
    firsts = near.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("own", "record_id", "uri", "date")).alias("o"), F.count("*").alias("n")).filter("n > 1")
    late = near.select("record_id", "own", "payload_digest", "payload_bytes").join(firsts, ["payload_digest", "payload_bytes"]).filter(F.col("own") != F.col("o.own"))
    return late.select("record_id", F.col("o.record_id").alias("to_id"), F.col("o.uri").alias("to_uri"), F.col("o.date").alias("to_date")).dropDuplicates(["record_id"])


def _member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def warc_record(kind: str, name: str, uri: str, ip: str, date: str, digest: str, block: bytes, to: tuple[str, str, str] | None = None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {to[0]}", f"WARC-Refers-To-Target-URI: {to[1]}", f"WARC-Refers-To-Date: {to[2]}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 1996-01-01T00:00:00Z", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archives(records: DataFrame, late: DataFrame) -> DataFrame:
    """Records and the revisits among them as archives: column archive, gzip members one after the other."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ("record_id", "uri", "ip", "date", "payload_digest", "head", "to_id", "to_uri", "to_date", "member")
        for n, batch in enumerate(tk.pieces(batches, "member", ARCHIVE)):
            out = [_member(warc_info(f"quill-{part:06d}-{n:05d}.warc.gz"))]
            for name, uri, ip, date, digest, head, *to, member in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                out.append(member if to[0] is None else _member(warc_record("revisit", name, uri, ip, date, digest, head, tuple(to))))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    # A revisit's own member isn't needed any more.
    joined = records.join(late, "record_id", "left").withColumn("member", F.when(F.col("to_id").isNull(), F.col("member")).otherwise(F.lit(b"")))
    return joined.mapInArrow(run, "archive binary")


def members(data: bytes) -> Iterator[bytes]:
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    return fields, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, uri string, date string, record_id string, payload binary"


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives. A response's length and digest come from the payload that is there, and its digest must be the declared one."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("archive"):
                rows = []
                for fields, block in map(parse_warc, members(data.as_py())):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    declared, late = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not late and sha1(payload) != declared:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                    rows.append((_page(head), None if late else len(payload), declared, fields["WARC-Type"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"], payload if payloads and not late else None))
                yield _batch(rows, READ)

    return files.mapInArrow(run, READ)


def resolved(records: DataFrame) -> DataFrame:
    """Read records with refers_to (the page_id of a revisit's response), and revisits' payload_bytes from there."""
    responses = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("there"))
    return records.join(responses, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "there")).drop("there")


def write(pages: DataFrame, version: int | None = None, least: int = MIN_REVISIT) -> DataFrame:
    """Pages to ARC, ARC to WARC archives in the shared folder; returns the archives read back."""
    ship_package(pages.sparkSession)
    arcs = to_arc(pages, version)
    return materialise(archives(convert(arcs), revisits(materialise(keys(arcs), "keys"), least)), "warc")


def export(files: DataFrame, folder: str) -> int:
    """Archives as .warc.gz files in a folder of this machine; returns their number."""
    n = 0
    for n, row in enumerate(files.select("archive").toLocalIterator(), 1):
        with open(f"{folder}/quill-{n:05d}.warc.gz", "wb") as f:
            f.write(row.archive)
    return n


def digest(pages: DataFrame) -> DataFrame:
    records = materialise(read(write(pages), payloads=False).drop("payload"), "read")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
