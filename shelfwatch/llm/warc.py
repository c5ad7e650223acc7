"""Legacy web archives: ARC files become WARC files, and WARC files are read back.

ARC: a file begins with a version block whose second line says the version and whose third names the fields of the
record lines that follow (version 1: five fields, version 2: ten); each record has the length that its line declares.
Conversion gives each record a WARC identifier (a name-based UUID of what the ARC record says, so reruns agree), an ISO
date from the 14-digit one, a type (``response`` for an HTTP exchange, else ``resource``) and SHA-1 digests.

Records with equal payloads: that with the smallest page id stays a response, the others become ``revisit`` records
without payload.  WARC files are gzipped, a member a record.  They are written by Spark's text writer, whose rows are
runs of members of some ``SEGMENT_BYTES`` and whose line separator is an empty gzip member, ``SEGMENTS_PER_FILE`` rows
a file; so a file has a bounded size, but for a record that is larger itself, and its name is the writer's.  Archives of
both kinds are read record by record, decompressed piece by piece.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

SEGMENT_BYTES = 4 << 20  # of records, before compression
SEGMENTS_PER_FILE = 16
PIECE = 1 << 20  # bytes decompressed at a time
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PAGE_HEADER = "X-Page-Id"
FIELDS = {  # of the record lines by version
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs
_KINDS = [("record_id", pa.string()), ("warc_type", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("ip", pa.string()), ("mime", pa.string()),
          ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_SCHEMA = "record_id string, warc_type string, warc_date string, target_uri string, ip string, mime string, http binary, payload binary, payload_bytes long, payload_digest string"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits, by DataFrame functions: each 10 of them are 8 base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def arc_head(name: str, version: int, date: str, origin: str = "shelfwatch") -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 {origin}\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + (f"200 - - 0 {name} " if version == 2 else "")
    return f"{line}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, uri: str, ip: str, date: str, mime: str, body: bytes, name: str = "-", offset: int = 0) -> bytes:
    """One ARC record. White space in the address is percent-encoded, as a record line needs."""
    uri = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri) or "-"
    middle = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{uri} {ip} {date} {mime} {middle}{len(body)}\n".encode() + body + b"\n"


class Stream:
    """Bytes of an archive, plain or gzipped in any number of members, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.more = self._members(data) if data[:2] == b"\x1f\x8b" else iter([data])
        self.held, self.at = b"", 0

    @staticmethod
    def _members(data: bytes):
        view, at = memoryview(data), 0
        while at < len(data):
            z, given = zlib.decompressobj(31), view[at: at + PIECE]
            while not z.eof:
                out = z.decompress(given, PIECE)
                if out:
                    yield out
                given = z.unconsumed_tail
                if not given and not z.eof and not out:
                    raise ValueError("a gzip member that is cut off")
                if not given and not z.eof:
                    at += PIECE
                    given = view[at: at + PIECE]
            at = min(at + PIECE, len(data)) - len(z.unused_data)

    def _fill(self) -> bool:
        piece = next(self.more, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at:] + piece, 0
        return True

    def before(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is passed over; None at the end of the bytes."""
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            behind = len(self.held) - self.at
            if not self._fill():
                return None
            start = max(self.at, self.at + behind - len(mark) + 1)
        found, self.at = self.held[self.at: end], end + len(mark)
        return found

    def take(self, n: int) -> bytes:
        """The next n bytes, or what there is."""
        parts, left = [], n
        while True:
            part = self.held[self.at: self.at + left]
            self.at += len(part)
            left -= len(part)
            parts.append(part)
            if not left or not self._fill():
                return b"".join(parts)

    def skip(self, c: bytes) -> None:
        """Pass over repetitions of one byte."""
        while self.at < len(self.held) or self._fill():
            if self.held[self.at: self.at + 1] != c:
                return
            self.at += 1

    def done(self) -> bool:
        return self.at >= len(self.held) and not self._fill()


def arc_records(data: bytes):
    """(fields of the record line, body) of the records of an ARC file, whichever its version; gzip is seen through.

    Raises ValueError where the version block or a declared length doesn't hold.
    """
    stream, names = Stream(data), None
    while True:
        stream.skip(b"\n")  # between records
        if stream.done():
            return
        head = stream.before(b"\n")
        if head is None:
            raise ValueError("an ARC record line without an end")
        line = head.decode("utf-8", "replace").split(" ")
        if not line[-1].strip().isdigit():
            raise ValueError("an ARC record line without a length")
        size = int(line[-1])
        body = stream.take(size)
        if len(body) < size:
            raise ValueError("an ARC record shorter than it declares")
        if names is None:
            rows = body.decode("utf-8", "replace").split("\n")
            if not line[0].startswith("filedesc:") or len(rows) < 2 or rows[0].split(" ")[0] not in ("1", "2"):
                raise ValueError("an ARC file without a version block")
            names = rows[1].strip().split(" ")
            continue
        extra = len(line) - len(names)  # an address with spaces in it
        line = [" ".join(line[: extra + 1]), *line[extra + 1:]] if extra > 0 else line
        yield dict(zip(names, line, strict=False)), body


def iso_date(digits: str) -> str:
    """WARC date of a 14-digit ARC date (shorter ones are filled with the earliest moment; others give the epoch)."""
    if not re.fullmatch(r"\d{4,14}", digits):
        return "1970-01-01T00:00:00Z"
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(fields: dict[str, str], body: bytes) -> tuple:
    """The WARC side of an ARC record, as named in _KINDS."""
    cut = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -1
    http, payload = (body[: cut + 4], body[cut + 4:]) if cut >= 0 else (b"", body)
    uri, date = fields.get("URL", "-"), fields.get("Archive-date", "")
    digest = base32_sha1(payload)
    name = uuid.uuid5(_NAMESPACE, f"{uri} {date} {digest} {base32_sha1(http)}")
    return (f"<urn:uuid:{name}>", "response" if cut >= 0 else "resource", iso_date(date), uri, fields.get("IP-address", "0.0.0.0"), fields.get("Content-type", "no-type"),
            http, payload, len(payload), digest)


def convert_arc(archives: DataFrame, content: str = "content", with_payload: bool = True) -> DataFrame:
    """WARC records of ARC files, a file's bytes a row: see _SCHEMA. Null content has none; without payload it is null."""
    at = archives.select(content)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held, n = [], 0
                for fields, body in arc_records(data.as_py() or b""):
                    held.append(converted(fields, body))
                    n += len(body)
                    if n >= SEGMENT_BYTES:
                        yield _record_batch(held, with_payload)
                        held, n = [], 0
                if held:
                    yield _record_batch(held, with_payload)

    return at.mapInArrow(run, _SCHEMA)


def _record_batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)]
    if not with_payload:
        columns[7] = pa.nulls(len(rows), pa.binary())
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in _KINDS])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of ARC files, plain or gzipped."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pages_as_arc(pages: DataFrame, date: str = "19991231235959") -> DataFrame:
    """(content): the pages (page_id, url, html) as ARC files of some SEGMENT_BYTES, of version 1 and 2 in turn.

    The page id is an HTTP header. A null url is written as ``urn:page:<id>``, null html as an empty payload.
    """

    def run(batches):
        version = 1
        for batch in batches:
            ids, urls, html = (batch.column(k) for k in range(3))
            html = html.cast(pa.binary())
            held: list[bytes] = []
            n = 0
            for i in range(batch.num_rows):
                page, url, payload = ids[i].as_py(), urls[i].as_py(), html[i].as_py() or b""
                own = f"{PAGE_HEADER}: {page}\r\n" if page is not None else ""
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                if not held:
                    held = [arc_head("pages.arc", version, date)]
                held.append(arc_record(version, url or f"urn:page:{page}", "0.0.0.0", date, "text/html", body, "pages.arc", n))
                n += len(held[-1])
                if n >= SEGMENT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, n, version = [], 0, 3 - version

    return pages.select("page_id", "url", "html").mapInArrow(run, "content binary")


def page_id_of(http: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(http.cast("string"), rf"(?i)\n{PAGE_HEADER}: (-?\d+)\r", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")


def header_value(http: Column, name: str) -> Column:
    """Value of an HTTP header, or null."""
    return F.nullif(F.regexp_extract(http.cast("string"), rf"(?i)\n{name}: ([^\r]*)\r", 1), F.lit(""))


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, refers_id, refers_page) of the records of index (record_id, page_id, payload_bytes, payload_digest) that revisit another.

    Of records with equal payloads of at least least_bytes, that with the smallest page id (null last, then the smallest
    record id) is what the others revisit.  Equal rows are one record.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    index = index.where(F.col("payload_bytes") >= least_bytes).select("record_id", "page_id", "payload_digest")
    first = index.groupBy("payload_digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("payload_digest", "first")
    return (index.join(first, "payload_digest").where(F.col("first.record_id") != F.col("record_id"))
            .select("record_id", F.col("first.record_id").alias("refers_id"), F.col("first.page_id").alias("refers_page")).groupBy("record_id").agg(F.min("refers_id").alias("refers_id"), F.min("refers_page").alias("refers_page")))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (of convert_arc, with refers_id and refers_page, null where a record revisits none) as WARC files."""
    again = F.col("refers_id").isNotNull()
    block = F.concat("http", F.when(again, F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b""))))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise(F.col("warc_type"))), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-IP-Address", F.col("ip")),
        line("Content-Type", F.when(F.col("warc_type") == "response", "application/http;msgtype=response").otherwise(F.col("mime"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("block")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.coalesce("refers_id", F.lit(""))),
                               F.coalesce(line("X-Refers-To-Page-Id", F.col("refers_page").cast("string")), F.lit("")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    rows = records.withColumn("block", block).select(F.concat(head.cast("binary"), "block", F.lit(b"\r\n\r\n")).alias("record"))

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            for record in batch.column(0):
                raw = record.as_py()
                held.append(gzip.compress(raw, 6, mtime=0))
                n += len(raw)
                if n >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    (packed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none")
     .option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path))


def warc_records(data: bytes):
    """(headers, block) of the records of a WARC file, gzipped in one member or one for each record, or plain."""
    stream = Stream(data)
    while not stream.done():
        head = stream.before(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(headers["Content-Length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError("a WARC record shorter than it declares")
        stream.take(4)
        yield headers, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(record_type, record_id, target_uri, warc_date, refers_id, refers_page, http, payload, payload_bytes, payload_digest) of WARC files.

    Bytes and digest of a response are measured on what is stored; a revisit says those of the payload it stands for
    (its HTTP header's length, its payload digest).
    """
    names = ["record_type", "record_id", "target_uri", "warc_date", "refers_id", "refers_page", "http", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
    length = re.compile(rb"(?i)\nContent-Length: (\d+)\r")

    def told(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("WARC-Type", "")
        cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
        http, payload = (block[: cut + 4], block[cut + 4:]) if cut >= 0 else (b"", block)
        if kind == "revisit":
            said = length.search(http)
            n, digest = int(said[1]) if said else None, headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        else:
            n, digest = len(payload), base32_sha1(payload)
        page = headers.get("X-Refers-To-Page-Id")
        return (kind, headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), headers.get("WARC-Refers-To"),
                int(page) if page else None, http, payload if with_payload else None, n, digest)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, n = [], 0
                for headers, block in warc_records(data.as_py() or b""):
                    rows.append(told(headers, block))
                    n += len(block)
                    if n >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, n = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_type string, record_id string, target_uri string, warc_date string, refers_id string, refers_page long, http binary, payload binary, payload_bytes long, payload_digest string")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: ``pages`` as ARC archives, converted to WARC files in the shared folder and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = pages_as_arc(pages)
    index = convert_arc(archives, with_payload=False).select("record_id", page_id_of(F.col("http")).alias("page_id"), "payload_bytes", "payload_digest").distinct()
    again = revisits(index)
    path = shared_path(spark, "warc")
    write_warc(convert_arc(archives).join(again, "record_id", "left"), path)
    return read_warc(spark, path).select(page_id_of(F.col("http")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, upper(sha1(encode(coalesce(html, '')))) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, translate(concat(
        to_base(CAST('0x' || substr(hex, 1, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(hex, 11, 10) AS BIGINT), 32, 8),
        to_base(CAST('0x' || substr(hex, 21, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(hex, 31, 10) AS BIGINT), 32, 8)),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM m
"""
