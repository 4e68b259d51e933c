"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is written as three records, request, response or revisit, and
metadata, tied together by WARC-Concurrent-To. Payloads of at least
`revisit_bytes` that several pages share are stored once, by the page with the
largest id; the others become revisit records that refer to it.

Spark's text writer makes the files: a record is one value and the line
separator is the CRLF CRLF that ends a WARC record, so the archives go to any
store that Spark writes to. Each file is a gzip stream of about `file_bytes`
bytes of records at most, or of one record, so that whole files fit in a task's
memory. The reader takes whole files as binary rows, inflates
them piece by piece and cuts records by their Content-Length, so payloads may
hold any bytes.

Assembly joins the records of a transaction through their concurrent-to
identifiers, given on either side, and yields one nested row for each capture,
with its request and an array of its different metadata records.

Damaged archives: what can be read is given, and then one row that has the file,
the offset of the record in the inflated stream and an error instead of a type:
a length that is no number, a record or a gzip stream that ends early, data that is no gzip, a record
without a WARC header, or bytes behind the last record. Reading of that file ends
there; assembly takes no notice of such rows.

Nulls and odd input: null html is an empty payload, a null url an empty target,
a null id an absent one. Line breaks and spaces in a url are percent-encoded.
Rows that repeat an id and payload are each written as what the id's payload
is; of rows that tie for the largest id, the revisits refer to the one with the
last url. A capture without a request has null there, and without metadata an
empty array. An empty table gives no archive, and a folder without archives no
records. Pages are read by the three columns named, so others, whatever their
names, are left out and can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import hint, map_rows

HEADER = "WARC/1.1\r\n"
RECORDS = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, digest_ok boolean, http_status string, payload_bytes long, payload binary, fields map<string,string>, file string, at long, error string"
READ = 1 << 16


def _record(kind: str, record_id: str, uri: str, date: str, content_type: str, block: bytes, **more: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return (HEADER + "".join(f"{k}: {v}\r\n" for k, v in head if v) + "\r\n").encode() + block


def _urn(*parts: object) -> str:
    h = hashlib.md5("|".join(map(str, parts)).encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def capture_records(page_id: int | None, url: str, html: bytes, digest: str, refers_to: str | None, refers_page: int | None, date: str) -> list[bytes]:
    """The three records of one page."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    site, own = urlsplit(uri) if uri.isascii() and "[" not in uri else urlsplit(""), _urn("capture", page_id, url, digest)
    get = f"GET {site.path or '/'}{'?' + site.query if site.query else ''} HTTP/1.1\r\nHost: {site.netloc}\r\n\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    revisit = {"WARC_Refers_To": refers_to, "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if refers_to else {}
    note = "" if page_id is None else f"page-id: {page_id}\r\n"
    return [
        _record("request", _urn("request", own), uri, date, "application/http;msgtype=request", get.encode(), WARC_Concurrent_To=own),
        _record("revisit" if refers_to else "response", own, uri, date, "application/http;msgtype=response", http if refers_to else http + html, WARC_Payload_Digest=f"sha1:{digest}", **revisit),
        _record("metadata", _urn("metadata", own), uri, date, "application/warc-fields", note.encode(), WARC_Concurrent_To=own),
    ]


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 128 << 20, broadcast_rows: int = 100_000) -> None:
    """Writes the archives of pages under path."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = p.where(F.col("n") >= revisit_bytes).groupBy("digest", "n").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("c"))
    same = same.where("c > 1 and r.page_id is not null").select("digest", "n", F.col("r.page_id").alias("r_page"), F.col("r.url").alias("r_url"))
    planned = p.join(hint(same, broadcast_rows), ["digest", "n"], "left").select("page_id", "url", "html", "digest", "r_page", "r_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        file, filled, out, size = 0, 0, [], 0
        for batch in batches:
            for pid, u, body, digest, r_page, r_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = _urn("capture", r_page, r_url, digest) if r_page is not None and r_page != pid else None
                three = capture_records(pid, u, body.encode(), digest, refers, r_page, date)
                n = sum(map(len, three))
                if out and (size + n > 4 << 20 or filled + n > file_bytes):
                    yield {"value": pa.array(out, pa.binary()).cast(pa.string()), "file": np.full(len(out), file, np.int32)}
                    out, size = [], 0
                if filled and filled + n > file_bytes:
                    file, filled = file + 1, 0
                out += three
                size, filled = size + n, filled + n
        if out:
            yield {"value": pa.array(out, pa.binary()).cast(pa.string()), "file": np.full(len(out), file, np.int32)}

    records = map_rows(planned, "value string, file int", run)
    records.write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class Damaged(Exception):
    """What is wrong with an archive from some place on."""


class _Stream:
    """Bytes of a gzip file, or of a plain one, inflated as they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.have, self.given = data, 0, bytearray(), 0
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.within, self.damage = False, ""  # within a gzip member that hasn't ended

    def more(self) -> bool:
        """Whether there is more; what stands before damage is given first."""
        if self.damage:
            raise Damaged(self.damage)
        if self.at >= len(self.data):
            if self.within:
                raise Damaged("the gzip stream ends early")
            return False
        chunk = self.data[self.at : self.at + READ]
        self.at += len(chunk)
        while self.gz and chunk:
            try:
                self.have += self.gz.decompress(chunk)
            except zlib.error as error:
                self.damage = f"no gzip data: {error}"
                return True
            chunk, self.within = self.gz.unused_data, not self.gz.eof
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)  # records may be members of their own
        self.have += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (p := self.have.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.have)
            if not self.more():
                return None
        return self._give(p + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        return self._give(n)

    def _give(self, n: int) -> bytes:
        out = bytes(self.have[:n])
        del self.have[:n]
        self.given += len(out)
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes, int, str | None]]:
    """(lower-case header fields, block, offset of the inflated record, None) of each whole record; where the archive is damaged, a last item with no fields and what is wrong."""
    stream, at = _Stream(data), 0
    try:
        while True:
            at = stream.given
            head = stream.until(b"\r\n\r\n")
            if head is None:
                if bytes(stream.have).strip():
                    raise Damaged("bytes behind the last record")
                return
            lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
            if not lines[0]:
                continue  # blank lines between records
            if not lines[0].startswith("WARC/"):
                raise Damaged("a record has no WARC header")
            fields: dict[str, list[str]] = {}
            for line in lines[1:]:
                if line:
                    name, _, value = line.partition(":")
                    fields.setdefault(name.strip().lower(), []).append(value.strip())
            length = fields.get("content-length", ["0"])[0]
            if not (length.isascii() and length.isdigit()):
                raise Damaged("Content-Length is no number")
            block = stream.take(int(length))
            if len(block) < int(length):
                raise Damaged("a record ends early")
            yield fields, block, at, None
    except Damaged as damage:
        yield {}, b"", at, str(damage)


def read_warc(session, path: str, *, payload: bool = True) -> DataFrame:
    """One row for each record under path, with its file and offset; payload is null unless asked for. A damaged archive gives its whole records and a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(len(batch)):
                out: list[tuple] = []
                size, file = 0, batch.column("path")[i].as_py()
                for f, block, at, error in parse(batch.column("content")[i].as_py()):
                    one = lambda k, f=f: f.get(k, [None])[0]
                    kind = one("warc-type")
                    status, length, body, fields = None, len(block), block, []
                    if "application/http" in (one("content-type") or ""):
                        head, _, body = block.partition(b"\r\n\r\n")
                        status, length = head.split(b"\r\n")[0].decode("utf-8", "replace"), len(body)
                        if kind == "revisit" and (m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)):
                            length = int(m[1])
                    elif "warc-fields" in (one("content-type") or ""):
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
                    said = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
                    digest = hashlib.sha1(body, usedforsecurity=False).hexdigest() if kind == "response" else said
                    out.append((one("warc-record-id"), kind, f.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest, None if said is None else said == digest, status, length, body if payload and not error else None, fields, file, at, error))
                    size += len(block)
                    if size > 8 << 20 or len(out) >= 5000:
                        yield dict(zip(NAMES, zip(*out, strict=True), strict=True))
                        out, size = [], 0
                if out:
                    yield dict(zip(NAMES, zip(*out, strict=True), strict=True))

    files = session.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content")
    return map_rows(files, RECORDS, run)


NAMES = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>", "", RECORDS).split(",")]


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture (response or revisit), with its request and its metadata records nested."""
    main = records.where(F.col("type").isin("response", "revisit"))
    side = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", "payload", "fields", "payload_bytes")
    named = side.select(F.explode("concurrent_to").alias("capture_id"), F.struct("type", "record_id", "payload", "fields").alias("part"))
    asked = main.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    back = side.join(asked, "record_id").select("capture_id", F.struct("type", "record_id", "payload", "fields").alias("part"))
    of = lambda kind: F.when(F.col("part.type") == kind, F.col("part"))
    request = F.min_by(of("request"), F.when(F.col("part.type") == "request", F.col("part.record_id")))
    # equal captures share their id, so each of their equal records counts once
    every = named.unionByName(back).withColumn("same", F.xxhash64("part.type", "part.record_id", "part.payload", F.to_json("part.fields")))
    every = every.groupBy("capture_id", "same").agg(F.first("part").alias("part"))
    parts = every.groupBy("capture_id").agg(request.alias("request"), F.collect_list(of("metadata")).alias("metadata"))
    capture = main.withColumnRenamed("record_id", "capture_id").join(parts, "capture_id", "left")
    return capture.select("capture_id", "type", "uri", "date", "refers_to", F.struct("http_status", "payload_bytes", "payload", "digest", "digest_ok").alias("response"), "request", "metadata")
