"""Web archives: legacy ARC records become WARC records, archives are written and read back.

An ARC file starts with a version block, `filedesc://name ip date text/plain [result checksum location offset file]
length`, whose second line gives the version and whose third names the fields. Version 1 headers have five fields (URL,
IP, date, type, length); version 2 headers ten (URL, IP, date, type, result code, checksum, location, offset, file name,
length). A record is a header line, exactly `length` bytes, and a newline. Fields are counted from the right, so a URL
that holds spaces stays whole.

Each record becomes a WARC/1.0 record with what ARC lacks made up from it, the same at every attempt: WARC-Record-ID is
a name-based UUID of URL, date and block digest; WARC-Date is the 14-digit date in ISO form; WARC-Type follows the scheme
and the content (warcinfo for filedesc, response for HTTP, resource otherwise); block and payload digests are SHA-1.

Archives are text that Spark writes with the end of a WARC record, CRLF CRLF, as line separator, gzipped, to any file
system that Spark knows; the committer makes a lost task harmless. A file is one gzip member. They are read back as whole
files of at most RECORDS records and some FILE_BYTES, parsed by declared Content-Length. Blocks are bytes, whatever their
encoding.

Of records with equal payloads of at least LEAST bytes, that of the largest page_id is the response and others are
revisits without payload. Hot payloads are counted before any shuffle and matched under a salt.

Defined results: null html is an empty payload; null url is written as `urn:none`. Null page_id: the record has none,
gives no name to a response, and is itself a response unless a named page has the payload. Pages repeated under one id
with one payload are all responses, for a revisit of itself would lose the payload. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read, shared_dir

LEAST = 1000
RECORDS = 2000
FILE_BYTES = 64 << 20
SALTS = 64
FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}
DATE = "20260101000000"


# --- ARC ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes


def arc_file(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, type, body) records."""
    out = bytearray()

    def put(url: str, date: str, kind: str, body: bytes) -> None:
        more = "" if version == 1 else f" 200 {zlib.crc32(body):08x} - {len(out)} {name}"
        out.extend(f"{url} 0.0.0.0 {date} {kind}{more} {len(body)}\n".encode() + body + b"\n")

    put(f"filedesc://{name}", DATE, "text/plain", f"{version} {int(version == 2)} tidegate\n{' '.join(FIELDS[version])}\n".encode())
    for r in records:
        put(*r)
    return bytes(out)


def plain(data: bytes) -> bytes:
    """data, or what its gzip members hold, one after the other."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data.lstrip(b"\0")  # padding
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, gzipped or not, the version block first. Raises ValueError where a header or length can't be right."""
    at, version = 0, 0
    data = plain(data)
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line:  # blank lines between records
            at = end + 1
            continue
        length = line.rpartition(" ")[2]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"bad declared length at byte {at}: {line[:200]!r}")
        body = data[end + 1 : end + 1 + int(length)]
        if not version:
            if not line.startswith("filedesc:"):
                raise ValueError("no version block")
            version = int(body.split(b" ", 1)[0] or 0)
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        names = FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields at byte {at}, not {len(names)}: {line[:200]!r}")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), body)
        at = end + 1 + int(length)
        if data[at : at + 1] == b"\n":
            at += 1


# --- WARC --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    @property
    def head_bytes(self) -> int:
        """Length of the HTTP head with the blank line that ends it, by CRLF or bare LF; a head without end is all of the block."""
        if "msgtype" not in self.headers.get("Content-Type", ""):
            return 0
        ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := self.block.find(mark)) >= 0]
        return min(ends, default=len(self.block))

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head; the block itself where there is none."""
        return self.block[self.head_bytes :]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def convert(arc: ArcRecord) -> WarcRecord:
    f = arc.fields
    d = (f["date"] + "00000101000000"[len(f["date"]) :])[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    http = arc.body.startswith(b"HTTP/")
    kind = "warcinfo" if f["url"].startswith("filedesc:") else "response" if http else "resource"
    block = sha1(arc.body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{f['url']} {date} {block}")
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"], "Content-Type": "application/http; msgtype=response" if http else f["type"], "WARC-Block-Digest": block}
    out = WarcRecord(headers, arc.body)
    headers["WARC-Payload-Digest"] = sha1(out.payload)
    if kind == "warcinfo":
        headers["WARC-Filename"] = headers.pop("WARC-Target-URI").removeprefix("filedesc://")
    return out


def serialize(r: WarcRecord) -> bytes:
    """Without the two line ends that close a record: the writer's separator."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()) + f"Content-Length: {len(r.block)}\r\n\r\n"
    return head.encode() + r.block


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers.pop("Content-Length"))
        at = end + 4 + n + 4
        if at > len(data):
            raise ValueError("a record is cut off")
        yield WarcRecord(headers, data[end + 4 : end + 4 + n])


# --- tables ------------------------------------------------------------------------------------------------------
def to_arc(pages: DataFrame, size: int = 200, most: int = 16 << 20) -> DataFrame:
    """arc (binary): ARC files of up to `size` pages and some `most` bytes each (or one page), by turns of version 1 and 2.
    page_id travels in the HTTP head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, records, held = 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([arc_file(1 + k % 2, f"part-{k}.arc", records)], pa.binary())], ["arc"])

        for b in batches:
            for page, url, html in zip(b.column(0), b.column(1), b.column(2), strict=True):
                body = (html.as_py() or "").encode("utf-8", "replace")
                id_line = "" if page.as_py() is None else f"X-Page-Id: {page.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{id_line}\r\n"
                if records and (len(records) >= size or held + len(body) > most):
                    k += 1
                    yield flush()
                    records, held = [], 0
                records.append((quote(url.as_py() or "urn:none", safe=":/?#[]@!$&'()*+,;=%~-._"), DATE, "text/html", head.encode() + body))
                held += len(body)
        if records:
            k += 1
            yield flush()

    return map_arrow(pages.select("page_id", "url", "html"), run, "arc binary")


RECORD = "page_id long, head string, record_id string, block binary, head_bytes int, head_digest string, payload_bytes long, payload_digest string"


def from_arc(arcs: DataFrame) -> DataFrame:
    """RECORD for each record in ARC files but the version block: head is the WARC headers of the converted record, without
    length; head_bytes and head_digest are those of the HTTP head alone, which is all that a revisit keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.string())
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for data in b.column(0):
                out = []
                for arc in parse_arc(data.as_py()):
                    r = convert(arc)
                    if r.headers["WARC-Type"] == "warcinfo":
                        continue
                    http = r.block[: r.head_bytes]
                    page = [x[11:] for x in http.decode("utf-8", "replace").splitlines() if x.startswith("X-Page-Id: ")]
                    payload = r.payload
                    out.append((int(page[0]) if page else None, "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()), r.headers["WARC-Record-ID"], r.block, len(http), sha1(http), len(payload), hashlib.sha1(payload).hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return map_arrow(arcs, run, RECORD)


def revisits(records: DataFrame) -> DataFrame:
    """records and refers_to, refers_to_id: page_id and record id of the response that a record revisits, null for responses."""
    named = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("first")
    first = records.filter(f"payload_bytes >= {LEAST}").groupBy("payload_digest", "payload_bytes").agg(named, F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = first.select("payload_digest", "payload_bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("page_id", "head"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "payload_bytes", "salt"], "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(*records.columns, F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.record_id")).alias("refers_to_id"))


def as_text(records: DataFrame) -> DataFrame:
    """value (string): the bytes of each record as WARC, whatever their encoding."""
    again = F.col("refers_to").isNotNull()
    # the block of a revisit is its HTTP head alone
    block = F.when(again, F.expr("substring(block, 1, head_bytes)")).otherwise(F.col("block"))
    kind = F.regexp_replace(F.regexp_replace("head", "^WARC-Type: [a-z]+\r\n", "WARC-Type: revisit\r\n"), "WARC-Block-Digest: [^\r]*", F.concat(F.lit("WARC-Block-Digest: "), "head_digest"))
    profile = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), "refers_to_id", F.lit("\r\n"))
    head = F.when(again, F.concat(kind, profile)).otherwise(F.col("head"))
    extra = F.concat_ws("", F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"), F.lit("\r\n")), F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")))
    text = F.concat(F.lit("WARC/1.0\r\n"), head, extra, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return records.select(F.concat(text.cast("binary"), block).cast("string").alias("value"))


def write(records: DataFrame, path: str, largest: int = 0) -> None:
    """largest: bytes of the largest record, which bounds the records of a file: it is read whole."""
    most = max(1, min(RECORDS, FILE_BYTES // max(1, largest)))
    as_text(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


READ = "page_id long, record_type string, target_uri string, record_id string, warc_date string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_back(spark, path: str, payloads: bool = True) -> DataFrame:
    """READ for each record of the archives under path. payload_bytes and payload_digest are those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for data in b.column(0):
                out = []
                for r in parse_warc(plain(data.as_py())):
                    h = r.headers
                    hexed = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    whole = h["WARC-Type"] != "revisit"
                    if whole and (len(r.payload) != int(h["X-Payload-Length"]) or hashlib.sha1(r.payload).hexdigest() != hexed):
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} is not what its header says")
                    page, refers = (int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    out.append((page, h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Date"], int(h["X-Payload-Length"]), hexed, refers, r.payload if payloads and whole else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return map_arrow(files, run, READ)


def archive(pages: DataFrame) -> str:
    """Write pages as WARC archives, by way of ARC, in the shared folder; returns the path."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write(revisits(from_arc(to_arc(pages))), path, largest)
    return path


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = archive(read(spark, sf_dir, "pages"))
    return read_back(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM r
"""
