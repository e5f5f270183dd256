"""WARC from legacy ARC: version-specific header lines and declared lengths in, equivalent WARC records out.

An ARC file starts with a version block whose last line names the fields of the header line that precedes each
document; version 1 has five fields, version 2 ten. `read_arcs` takes folders of such files, plain or gzipped, apart;
`convert` synthesises for each document a WARC identifier, timestamp, type and digests, and writes WARC files, each
record a gzip member of its own. Files are bounded by bytes, so that one file is little to read at a time. They are
written by Spark's text sink, a file a row, to any store that Spark can write and with its commit protocol: the sink's
line end is the zero that ends a gzip member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, scratch, small, tidied

#: Field names of the header lines, by version. Fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Bytes from which an archive file is closed, and of records that are handed on together.
FILE_BYTES, BATCH_BYTES = 16 << 20, 2 << 20

#: A line of an HTTP head that carries a page's key through an archive.
KEY_LINE = b"X-Page-Key: "

#: A record's where it is not known.
DATE, IP = "20260101000000", "0.0.0.0"

#: The upper 48 bits of identifiers that hold a 64-bit key (as version 8 of UUIDs allows).
_TAG = int.from_bytes(hashlib.sha1(b"page key").digest()[:6], "big")


# --- ARC --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes

    def get(self, name: str) -> str:
        return self.fields.get(name, "-")


def arc_header(version: int, name: str, date: str) -> bytes:
    """A file's version block."""
    body = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n".encode()
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, content: bytes, name: str, offset: int, kind: str = "text/html") -> bytes:
    """One document after its header line; white space in urls is percent-encoded, as the line is split at blanks."""
    url = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode("utf-8", "surrogatepass")) if any(c <= " " or c == "\x7f" for c in url) or not url.isascii() else url
    rest = "" if version == 1 else f"200 - - {offset} {name} "
    return f"\n{url or '-'} {ip} {date} {kind} {rest}{len(content)}\n".encode("latin-1") + content


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The version block and the documents of an ARC file, gzipped or not; ValueError where a line or a length does not
    fit."""
    if data[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(data)) as stream:  # gzip.decompress copies what is left for each member
            data = stream.read()
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("latin-1").split(" ")
        if names is None:
            names = ARC_FIELDS[1 if len(line) == 5 else 2].split()  # until the block itself says so
        if end < 0 or len(line) != len(names) or not line[-1].isdigit():
            raise ValueError(f"no header line at byte {at}")
        size = int(line[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"{size} bytes are declared at byte {at}, {len(content)} are there")
        record = ArcRecord(dict(zip(names, line, strict=True)), content)
        if line[0].startswith("filedesc:"):
            names = content.decode("latin-1").rstrip("\n").split("\n")[1].split()
        yield record
        at = end + 1 + size


# --- WARC -------------------------------------------------------------------------------------------


def key_id(key: int) -> uuid.UUID:
    """An identifier that holds a 64-bit key."""
    k = key & (1 << 64) - 1
    return uuid.UUID(int=_TAG << 80 | 8 << 76 | k >> 52 << 64 | 2 << 62 | k & (1 << 52) - 1)


def id_key(text: str) -> int | None:
    """The key of an identifier, or None if it holds none."""
    n = uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 80 != _TAG:
        return None
    k = (n >> 64 & 0xFFF) << 52 | n & (1 << 52) - 1
    return k - (1 << 64) if k >> 63 else k


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _iso(date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC date."""
    d = (date + "00000101000000"[len(date) :]) if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{lines}\r\n".encode("utf-8") + block + b"\r\n\r\n"


def to_warc(record: ArcRecord, key: int | None = None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC document. key: a number for its identifier, else that is made of url, date and content.
    refers_to: the key of the record whose payload is the same; the record is then a revisit without its payload."""
    url, date = record.get("URL"), _iso(record.get("Archive-date"))
    http = record.content.startswith(b"HTTP/")
    head, payload = split_http(record.content)
    kind = "warcinfo" if url.startswith("filedesc:") else "revisit" if refers_to is not None else "response" if http else "resource"
    own = key_id(key) if key is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest(record.content)}")
    block = head + b"\r\n\r\n" if kind == "revisit" else record.content
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date)]
    if kind == "warcinfo":
        headers += [("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "text/plain")]
    else:
        if url != "-":  # bytes beyond ASCII, which were read as characters, are percent-encoded: a URI has none
            headers.append(("WARC-Target-URI", url if url.isascii() else "".join(c if c.isascii() else f"%{ord(c):02X}" for c in url)))
        headers += [("WARC-IP-Address", record.get("IP-address")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
        headers.append(("Content-Type", "application/http; msgtype=response" if http else record.get("Content-type")))
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{key_id(refers_to)}>")]
    headers.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    return _record(headers, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a binary stream; ValueError where it breaks off."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record breaks off")
        yield headers, block


# --- DataFrames -------------------------------------------------------------------------------------


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def _ending_in_zero(file: bytes) -> bytes:
    """A gzip member ends with its length, low byte first; an empty one more is added to those of 16 MB and more."""
    return file if file.endswith(b"\0") else file + _member(b"")


def _write(files: DataFrame, path: str) -> None:
    """files: file binary, each a row's, ending in a zero, which the sink adds."""
    bare = F.expr("substring(file, 1, octet_length(file) - 1)").cast("string")
    files.select(bare).write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def archived(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: Column | str = DATE, ip: Column | str = IP) -> None:
    """Writes pages as gzipped ARC files, of version 1 and 2 in turns, with an HTTP head before each payload. date, ip:
    columns, or the same for all. Null urls and payloads are empty; a key goes into the head."""
    date, ip = (F.lit(c) if isinstance(c, str) else c for c in (date, ip))
    rows = pages.select(F.col(key).cast("long").cast("string").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"), date.alias("date"), ip.alias("ip"))

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version, held, size, offset = 1, [], 0, 0
        for batch in batches:
            for key, u, p, d, i in zip(*(batch[c] for c in ("key", "url", "payload", "date", "ip")), strict=True):
                if not held:
                    head = arc_header(version, "pages.arc", DATE)
                    held, offset = [_member(head)], len(head)
                    size = len(held[0])
                body = (p or "").encode("utf-8", "surrogatepass")
                line = b"" if key is None else KEY_LINE + key.encode() + b"\r\n"
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (line, len(body)) + body
                record = arc_record(version, u or "", i or IP, d or DATE, content, "pages.arc", offset)
                held.append(_member(record))
                offset, size = offset + len(record), size + len(held[-1])
                if size >= FILE_BYTES:
                    yield pd.DataFrame({"file": [_ending_in_zero(b"".join(held))]})
                    held, version = [], 3 - version
        if held:
            yield pd.DataFrame({"file": [_ending_in_zero(b"".join(held))]})

    _write(rows.mapInPandas(run, "file binary"), path)


_ARC = "file string, nth int, fields map<string,string>, key long, payload_bytes long, payload_digest string, content binary"


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder's ARC files, plain or gzipped, of any version that names its fields: file, nth (0 is the
    version block), fields (the header line's, by name), key (null if the head has none), payload_bytes, payload_digest
    and content. A length that does not fit raises."""

    @tidied
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ARC.split(", ")]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for nth, r in enumerate(read_arc(data)):
                    head, body = split_http(r.content)
                    key = next((line[len(KEY_LINE) :] for line in head.split(b"\r\n") if line.startswith(KEY_LINE)), None)
                    rows.append((file, nth, r.fields, None if key is None else int(key), len(body), digest(body), r.content))
                    size += len(r.content)
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, _ARC)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, if any, and the payload."""
    head, _, payload = content.partition(b"\r\n\r\n") if content.startswith(b"HTTP/") else (b"", b"", content)
    return head, payload


def convert(spark: SparkSession, arcs: str, path: str, min_bytes: int = 0) -> None:
    """Converts a folder of ARC files into one of WARC files.

    Of documents with equal payloads of min_bytes or more, that with the largest key is the response, and others with a
    lesser key, or none, are revisits of it. A version block becomes a warcinfo record. ARC files are read twice: once
    for digests, of which only those shared by several documents are looked up, and once to write.
    """
    with scratch(spark) as s:
        keyed = read_arcs(spark, arcs).where("nth > 0").select("key", "payload_bytes", "payload_digest")
        keyed = s.stored(keyed.where(F.col("payload_bytes") >= min_bytes), "digests")
        shared = keyed.groupBy("payload_digest").agg(F.max("key").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_d"), "_last")
        shared = s.stored(shared, "shared")
        rows = read_arcs(spark, arcs).drop("payload_bytes")
        # a version block's own digest is nobody's payload
        same = (F.col("payload_digest") == F.col("_d")) & (F.col("nth") > 0)
        rows = rows.join(small(shared, shared.count()), same, "left")
        revisit = F.col("_last").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("_last")))
        # longs with nulls would lose digits in pandas
        rows = rows.select("fields", F.col("key").cast("string"), F.when(revisit, F.col("_last")).cast("string").alias("refers_to"), "content")

        @tidied
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for batch in batches:
                for fields, key, to, content in zip(*(batch[c] for c in ("fields", "key", "refers_to", "content")), strict=True):
                    record = to_warc(ArcRecord(dict(fields), content), None if key is None else int(key), None if to is None else int(to))
                    held.append(_member(record))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield pd.DataFrame({"file": [_ending_in_zero(b"".join(held))]})
                        held, size = [], 0
            if held:
                yield pd.DataFrame({"file": [_ending_in_zero(b"".join(held))]})

        _write(rows.mapInPandas(run, "file binary"), path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder's WARC files, gzipped or not: key (null if the identifier holds none), record_type, uri,
    date, ip, payload_bytes, payload_digest, refers_to and payload (null of a revisit). A payload that does not fit its
    digest raises."""
    kind = "key long, record_type string, uri string, date string, ip string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [c.split()[0] for c in kind.split(", ")]

    @tidied
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                with gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content) as stream:
                    for h, block in read_warc(stream):
                        info = h["warc-type"] == "warcinfo"
                        head, body = split_http(block)
                        said = digest(body) if info else h["warc-payload-digest"].removeprefix("sha1:")
                        size = len(body)
                        if h["warc-type"] == "revisit":
                            size, body = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None
                        elif digest(body) != said:
                            raise ValueError(f"{h['warc-record-id']} does not fit its digest")
                        key, to = id_key(h["warc-record-id"]), h.get("warc-refers-to")
                        rows.append((key, h["warc-type"], h.get("warc-target-uri"), h["warc-date"], h.get("warc-ip-address"), size, said, id_key(to) if to else None, body))
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, kind)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: Column | str = DATE, ip: Column | str = IP) -> DataFrame:
    """Writes the pages as ARC files in the shared folder, converts these to WARC files and reads those back: key,
    payload_bytes, payload_digest, record_type, refers_to, uri, date, ip.

    Null payloads are empty ones, and equal to these. Of rows with equal payloads that with the largest key is the
    response; rows that repeat it, key and all, are responses too. A row without a key is a revisit if another row with
    its payload has one. An empty table gives no rows; other columns are left out.
    """
    spark = pages.sparkSession
    with scratch(spark) as s:
        archived(pages, f"{s.base}/arc", key, url, payload, date, ip)
        convert(spark, f"{s.base}/arc", f"{s.base}/warc", min_bytes)
        out = read_archives(spark, f"{s.base}/warc").where("record_type <> 'warcinfo'").withColumnRenamed("key", "_key")
        out = out.select(F.col("_key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "ip")
        return Scratch(spark).stored(out, "records")
