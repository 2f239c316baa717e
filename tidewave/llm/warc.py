"""WARC archives of pages: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, qualified, sized, work_dir
from .files import create, opened

#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
#: An archive is closed when it has this many compressed bytes.
ROLL_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BLOCK = 1 << 18


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _plain(value: str) -> str:
    """A header value may hold no line ends."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; both name the full payload's length and digest."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _plain(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The content of each gzip member, inflated piece by piece as the stream is read."""
    z, parts, began = zlib.decompressobj(31), [], False
    while True:
        data = stream.read(block)
        if not data:
            if began:
                raise ValueError("the archive ends inside a record")
            return
        while data:
            began = True
            parts.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(parts)
                data = z.unused_data
                z, parts, began = zlib.decompressobj(31), [], False


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block, framed by Content-Length and checked against its digest."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n") if end >= 0 else [""]
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    if head.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block's digest differs")
    return head, block


def read_archive(stream) -> Iterator[dict]:
    """Rows of the page records of an archive, in order."""
    for data in members(stream):
        head, block = parse(data)
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("the payload's length or digest differs")
        number = lambda k: None if head.get(k, "<urn:page:none>") == "<urn:page:none>" else int(head[k][10:-1])
        yield {
            "page_id": number("warc-record-id"),
            "url": head["warc-target-uri"],
            "payload": payload if kind == "response" else None,
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": number("warc-refers-to"),
        }


class Writer:
    """Archives of one task, each begun with a warcinfo record."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.made, self.context = folder, name, [], None

    def _open(self) -> None:
        self.uri = f"{self.folder}/{self.name}-{len(self.made):04d}.warc.gz"
        self.context = create(self.uri)
        self.out = self.context.__enter__()
        self.records = self.bytes = 0
        block = b"software: tidewave\r\nformat: WARC File Format 1.1\r\n"
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{self.name}>\r\nWARC-Date: {DATE}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
        self._put(info.encode() + block + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.bytes += len(z)

    def add(self, *fields) -> None:
        if self.context is None:
            self._open()
        self._put(record(*fields))
        self.records += 1
        if self.bytes >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.context is not None:
            self.context.__exit__(None, None, None)
            self.made.append((self.uri, self.records, self.bytes))
            self.context = None


def write_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives; returns the manifest (uri, records, bytes).

    Of the pages with equal payloads of at least ``REVISIT_BYTES`` that with the smallest id is written
    in full, those with larger ids as revisits of it; a repeated row of the smallest id, a null id
    and smaller payloads are written in full. Null html is empty, a null url an empty header. An empty
    table gives no archives. Payloads are not shuffled: only digests with more than one id are
    joined to them, by broadcast if they are counted to be few.
    """
    folder = qualified(pages.sparkSession, folder) if folder else work_dir(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    firsts = materialize(
        rows.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy(F.unhex("digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last")
        .select("d", "first"),
        "warc-firsts",
    )
    joined = rows.join(sized(firsts, firsts.count()), F.unhex("digest") == F.col("d"), "left").select("page_id", "url", "html", "digest", "first")

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        w = Writer(folder, f"pages-{t.partitionId():06d}-{t.taskAttemptId()}")
        for b in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                again = first is not None and page_id is not None and page_id > first
                w.add("revisit" if again else "response", page_id, url, html.encode(), digest, first if again else None)
        w.close()
        if w.made:
            uri, n, size = zip(*w.made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uri), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["uri", "records", "bytes"])

    return materialize(joined.mapInArrow(run, "uri string, records bigint, bytes bigint"), "warc-manifest")


COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
DDL = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_pages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """One row per page record of the archives in ``manifest``: page_id, url, payload (null for a
    revisit; left out on request), payload_bytes, payload_digest, record_type, refers_to."""
    names = [c for c in COLUMNS if payload or c != "payload"]

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                with opened(uri) as stream:
                    rows, size = [], 0
                    for r in read_archive(stream):
                        rows.append(r)
                        size += len(r["payload"] or b"") if payload else 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], COLUMNS[c]) for c in names], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], COLUMNS[c]) for c in names], names=names)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri").repartition(parts).mapInArrow(run, ", ".join(x for x in DDL.split(", ") if x.split()[0] in names))


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_pages(write_pages(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
