"""Legacy archives: ARC files of version 1 and 2 to WARC files, and back to rows.

An ARC file starts with a version block (``filedesc://``) whose second line tells the version; every record has one
header line, whose fields depend on the version, and a body of the declared length. The converter walks the declared
lengths and writes equivalent WARC records: identifiers derived from place and content, ISO timestamps, types (warcinfo,
response, resource, revisit) and SHA-256 digests. Archives are size-bounded text-writer files below the session's shared
folder, read again with the ``binaryFile`` source; one archive is one row of a task, and nothing passes the driver.

Files may be plain, one gzip member, or a member for every record; bodies are bytes of any kind and are never decoded.

Defined results: a null page is an empty payload and a null or empty url is ``NO_URL`` in ARC, none in WARC; white space in urls is
percent-encoded; dates shorter than 14 digits are completed with the start of the period; a body that ends before its
declared length, or a compressed member that ends early, is marked truncated. What stands where a header line must be,
and is none, is kept up to the next header line as a record marked bad (a ``metadata`` record in WARC), so one bad line
costs no other record; a file that is no ARC file at all is one such record. ``arc_records`` itself raises ``ValueError``
there unless told otherwise. Of records with equal payloads of at least ``REVISIT_BYTES`` those with the smallest page_id are responses (repeated rows share it),
the others revisits; records without a page_id are never referred to. Extra columns are not read; an empty table gives
no archive and no row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import checkpoint_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
#: Bytes that a header line may have.
HEADER_BYTES = 1 << 16
#: Stands in ARC header lines for a url that is not known.
NO_URL = "http:-"
# Field names of the two kinds of ARC header lines.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
# Fixed value: the profile of records that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record of an ARC file; ``body`` includes protocol headers."""

    offset: int
    url: str
    ip: str
    date: str
    mime: str
    status: str
    body: bytes
    truncated: bool
    bad: bool = False

    def split(self) -> tuple[bytes, bytes]:
        """Protocol headers (none for what is no HTTP response) and payload."""
        if self.body[:5] == b"HTTP/":
            head, sep, payload = self.body.partition(b"\r\n\r\n")
            return head + sep, payload
        return b"", self.body


def header_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("utf-8", "replace")
    return None


def page_number(told: str | None) -> int | None:
    return int(told) if told and re.fullmatch("-?[0-9]{1,18}", told) else None


def arc_archive(name: str, version: int, pages: list[tuple[int | None, str | None, bytes]], date: str) -> bytes:
    """An ARC file with an HTTP response for every page."""
    block = f"{version} 0 auditloom\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    parts, at = [], 0

    def add(url: str, mime: str, *body: bytes) -> None:
        nonlocal at
        size = sum(map(len, body))
        extra = "" if version == 1 else f" 200 - - {at} {name}"
        line = f"{url} 0.0.0.0 {date} {mime}{extra} {size}\n".encode()
        parts.extend((line, *body, b"\n"))
        at += len(line) + size + 1

    add(f"filedesc://{name}", "text/plain", block)
    for page_id, url, payload in pages:
        head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n").encode()
        add(quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else NO_URL, "text/html", head, payload)
    return b"".join(parts)[:-1]  # the writer ends the file with the last line end


def header_fields(data: bytes, at: int, fields: list[str]) -> tuple[dict[str, str], int] | None:
    """Fields of the header line at a byte and the first byte behind it; None if it is no header line."""
    eol = data.find(b"\n", at, at + HEADER_BYTES)
    if eol < 0:
        return None
    # Urls of old archives may hold spaces, the other fields do not.
    line = data[at:eol].rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    got = dict(zip(fields, line))
    date, size = got.get("Archive-date", ""), got.get("Archive-length", "")
    if len(line) != len(fields) or not re.fullmatch("[0-9]{4,14}", date) or not re.fullmatch("[0-9]+", size):
        return None
    return got, eol + 1


def next_header(data: bytes, at: int, fields: list[str]) -> int:
    """The next byte behind ``at`` where a header line begins, or the end."""
    for m in re.compile(rb"\n+(?=[A-Za-z][A-Za-z0-9+.-]*:)").finditer(data, at):
        if header_fields(data, m.end(), fields):
            return m.end()
    return len(data)


def arc_records(data: bytes, name: str = "", strict: bool = True) -> Iterator[Record]:
    """Records of an ARC file, the version block first. Not ``strict``: what is no record is one marked bad."""
    def bad(start: int, end: int, why: str) -> Record:
        if strict:
            raise ValueError(f"{name}: {why} at byte {start}")
        return Record(start, "", "", "", "", "-", data[start:end], False, True)

    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        if fields is None:
            eol = data.find(b"\n", at, at + HEADER_BYTES)
            version = data[eol + 1:eol + 3].split(b" ")[0]
            fields = {b"1": V1_FIELDS, b"2": V2_FIELDS}.get(version, "").split()
            if eol < 0 or not data.startswith(b"filedesc://", at) or not fields:
                yield bad(at, len(data), "no version block of a known version")
                return
        found = header_fields(data, at, fields)
        if found is None:
            end = next_header(data, at, fields)
            yield bad(at, end, "no header line")
            at = end
            continue
        got, body = found
        size = int(got["Archive-length"])
        yield Record(at, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], got.get("Result-code", "-"),
                     data[body:body + size], body + size > len(data))
        at = body + size


def iso_date(date: str) -> str:
    full = date + "00000101000000"[len(date):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(kind: str, key: str, date: str, block: bytes, mime: str, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{key}>"), ("WARC-Date", date), *more,
            ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def identifier(*parts: object) -> str:
    """A record identifier that depends on nothing but what the record is."""
    return str(uuid.UUID(bytes=hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], version=5))


def warc_archive(name: str, data: bytes, revisits: dict[int, int]) -> bytes:
    """WARC file of an ARC file; ``revisits``: offset of a record to the page_id that it repeats."""
    out = []
    for r in arc_records(data, name, strict=False):
        key, date = identifier(r.url, r.date, name, r.offset), iso_date(r.date)
        if r.bad:  # the archive tells no date for it
            out.append(warc_record("metadata", key, iso_date("1970"), r.body, "application/octet-stream", [("X-Bad-Header-Line", str(r.offset))]))
            continue
        more = [("WARC-Truncated", "length")] if r.truncated else []
        if r.url.startswith("filedesc://"):
            out.append(warc_record("warcinfo", key, date, r.body, "application/warc-fields", [("WARC-Filename", r.url[11:])]))
            continue
        head, payload = r.split()
        if r.url != NO_URL:
            more.append(("WARC-Target-URI", r.url))
        more += [("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())]
        if r.offset in revisits:
            more += [("WARC-Profile", PROFILE), ("WARC-Truncated", "length"), ("X-Refers-To-Page-Id", str(revisits[r.offset]))]
            out.append(warc_record("revisit", key, date, head, "application/http;msgtype=response", more))
        else:
            out.append(warc_record("response" if head else "resource", key, date, r.body,
                                   "application/http;msgtype=response" if head else r.mime, more))
    return b"".join(out)


def warc_records(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        at = end + 4 + int(head["content-length"])
        yield head, data[end + 4:at]


def plain(content: bytes) -> bytes:
    """An archive without its compression: every gzip member, as many as there are; what follows them stays as it is."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data
        if not member.eof:  # the file ends inside a member: what there is counts
            break
    return b"".join([*parts, content])


def saved(archives: DataFrame, path: str) -> None:
    """One file per row (``value`` binary), compressed; the text writer adds the last line end and does not look at the bytes."""
    archives.select(F.col("value").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every archive."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000") -> None:
    """Pages (page_id, url, html) as ARC files of bounded size; versions 1 and 2 take turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int | None, str | None, bytes]] = []
        size = made = 0

        def archive() -> pa.RecordBatch:
            name = f"{identifier(made, *(p[0] for p in own[:1]), size)}.arc"
            return pa.RecordBatch.from_arrays([pa.array([arc_archive(name, 1 + made % 2, own, date)], pa.large_binary())], ["value"])

        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                if own and size + len(payload) > ARCHIVE_BYTES:
                    yield archive()
                    own, size, made = [], 0, made + 1
                own.append((page_id, url, payload))
                size += len(payload)
        if own:
            yield archive()

    saved(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value binary"), path)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """archive, offset, url, ip, date, mime, status, page_id, payload_bytes, payload_digest, bad and payload of every
    record. A bad one has its bytes as payload and nulls elsewhere."""
    schema = ("archive string, offset long, url string, ip string, date string, mime string, status string, page_id long, "
              "payload_bytes long, payload_digest string, bad boolean" + (", payload binary" if with_payload else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for r in arc_records(plain(content.as_py()), name, strict=False):
                    if r.bad:
                        rows.append((name, r.offset, *[None] * 6, len(r.body), hashlib.sha256(r.body).hexdigest(), True, *([r.body] if with_payload else [])))
                        continue
                    if r.url.startswith("filedesc://"):
                        continue
                    head, payload = r.split()
                    page = header_value(head, b"x-page-id")
                    rows.append((name, r.offset, r.url, r.ip, iso_date(r.date), r.mime, r.status, page_number(page), len(payload),
                                 hashlib.sha256(payload).hexdigest(), False, *([payload] if with_payload else [])))
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.large_binary()]
                names = [f.strip().split(" ")[0] for f in schema.split(",")]
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return opened(spark, path).mapInArrow(run, schema)


def revisits(records: DataFrame) -> DataFrame:
    """archive, and a list of (offset, page_id that is repeated) for archives that have revisits.

    Only digests that occur twice are joined back; a list holds at most the records of one bounded archive.
    """
    large = records.where(~F.col("bad") & (F.col("payload_bytes") >= REVISIT_BYTES)).select("archive", "offset", "page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    again = large.join(first, "payload_digest").where("page_id is null or page_id > first_id")
    return again.groupBy("archive").agg(F.collect_list(F.struct("offset", "first_id")).alias("repeats"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Every ARC file below a path as a WARC file."""
    decided = revisits(read_arc(spark, arc_path, with_payload=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, again in zip(b.column("path").to_pylist(), b.column("content"), b.column("repeats").to_pylist()):
                made = warc_archive(name.rsplit("/", 1)[-1], plain(content.as_py()), {r["offset"]: r["first_id"] for r in again or []})
                if made:  # a task without pages leaves an empty file
                    yield pa.RecordBatch.from_arrays([pa.array([made[:-1]], pa.large_binary())], ["value"])

    archives = opened(spark, arc_path)
    joined = archives.join(decided, archives["path"] == decided["archive"], "left").select("path", "content", "repeats")
    saved(joined.mapInArrow(run, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, warc_date of every
    response and revisit. A response's payload is measured again; a revisit's is told by its headers."""
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
              "target_uri string, warc_date string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for head, block in warc_records(plain(content.as_py()), name):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    top, sep, payload = block.partition(b"\r\n\r\n")
                    page, told = header_value(top + sep, b"x-page-id"), head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != told:
                            raise ValueError(f"{name}: the payload of {head['warc-record-id']} has another digest")
                    else:
                        told_size = header_value(top + sep, b"content-length") or ""
                        size, digest = int(told_size) if told_size.isdigit() else 0, told
                    refers = head.get("x-refers-to-page-id")
                    rows.append((page_number(page), size, digest, head["warc-type"], int(refers) if refers else None,
                                 head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = [f.strip().split(" ")[0] for f in schema.split(",")]
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return opened(spark, path).mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC files, converted to WARC files and read back."""
    spark = pages.sparkSession
    base = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                                   "record_id", "target_uri", "warc_date")
