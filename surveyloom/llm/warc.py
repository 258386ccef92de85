"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

Writing: payloads are compared by digest. Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
id is a ``response``, the others are ``revisit`` records that refer to it and leave the payload out; their HTTP header
keeps its length. Smaller payloads are always responses.

Reading: bytes come in small chunks, each member is inflated as it arrives, the WARC header ends at an empty line, its
Content-Length frames the block, and payload and block digests are computed on the way and compared.

Cases: a null payload is empty; null urls and ids are written as empty. Control characters and blanks in urls are percent-encoded.
Records with a null id take part; if all ids of a payload are null, all are responses. Rows that share the largest id are
all responses. An empty table gives no archives. Other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm import files
from surveyloom.schema import require_columns
from surveyloom.session import materialize

# Version line, profile and the moment that records carry.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20  # an archive is closed once it has this many bytes
GZIP = 31


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record_id(name: int | None) -> str:
    return f"<urn:record:{'' if name is None else name}>"


def _id_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:record:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def encode_record(name: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(name)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean_url(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(b"%s: %s\r\n" % (k.encode(), v.encode()) for k, v in head)
    press = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return press.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + press.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytearray | None = None  # only where the reader keeps payloads
    payload_bytes: int = 0
    payload_digest: str = ""  # of the payload read; of a revisit, as its header has it

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def name(self) -> int | None:
        return _id_of(self.headers.get("warc-record-id"))

    @property
    def refers_to(self) -> int | None:
        return _id_of(self.headers.get("warc-refers-to"))


class DamagedRecord(ValueError):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:] if line)
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in pairs}


class _Member:
    """The decompressed bytes of one gzip member, as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.open, self.ready, self.rest = source, zlib.decompressobj(GZIP), bytearray(), rest

    def more(self) -> bool:
        """Inflate up to a chunk more; False at the member's end."""
        if self.open.eof:
            return False
        given = self.rest or self.source.read(CHUNK)
        if not given:
            raise DamagedRecord("the file ends inside a gzip member")
        self.ready += self.open.decompress(given, CHUNK)
        self.rest = self.open.unused_data if self.open.eof else self.open.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self.more():
                raise DamagedRecord(f"the member ends before {mark!r}")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise DamagedRecord("the block is shorter than its Content-Length")
            part = bytes(self.ready[:size])
            del self.ready[:size]
            size -= len(part)
            if part:
                yield part

    def finish(self) -> bytes:
        """Check the record's end; what follows the member in the file."""
        while self.more():
            pass
        if self.ready != b"\r\n\r\n":
            raise DamagedRecord("the record does not end after its block")
        return self.rest


def read_records(source, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an open archive, one after the other, each verified."""
    rest = source.read(CHUNK)
    while rest:
        member = _Member(source, rest)
        raw = member.until(b"\r\n\r\n")
        if not raw.startswith(b"WARC/"):
            raise DamagedRecord("a member does not begin with a WARC record")
        record = Record(_headers(raw))
        left = int(record.headers["content-length"])
        whole, body = hashlib.sha1(), hashlib.sha1()
        http: bytes | None = None if record.headers.get("content-type", "").startswith("application/http") else b""
        head = bytearray()
        record.payload = bytearray() if keep_payload else None
        for part in member.take(left):
            whole.update(part)
            if http is None:  # still inside the HTTP header
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, part = bytes(head[:at]), bytes(head[at + 4 :])
                record.http = _headers(http)
            body.update(part)
            record.payload_bytes += len(part)
            if keep_payload:
                record.payload += part
        said = record.headers.get("warc-block-digest")
        if said and said != f"sha1:{base32(whole.digest())}":
            raise DamagedRecord(f"block digest of {record.headers.get('warc-record-id')} is not {said}")
        said = record.headers.get("warc-payload-digest", "")
        if record.kind == "revisit":
            record.payload_digest = said.removeprefix("sha1:")
            record.payload_bytes = int(record.http.get("content-length", 0))
        else:
            record.payload_digest = base32(body.digest())
            if said and said != f"sha1:{record.payload_digest}":
                raise DamagedRecord(f"payload digest of {record.headers.get('warc-record-id')} is not {said}")
        rest = member.finish() or source.read(CHUNK)
        yield record


_ARCHIVES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sink = uri = None
        records = size = 0

        def close() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):  # a row at a time, so that only one payload is held
                name, url, payload, digest, refers_to = (c[k].as_py() for c in columns)
                if sink is None:
                    uri = files.unique_name(folder, f"part-{part:05d}", ".warc.gz")
                    sink, records, size = files.create(uri), 0, 0
                member = encode_record(name, url, payload, bytes.fromhex(digest), refers_to)
                sink.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return run


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, refers_to). Only payloads that occur more than once are joined to."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("shared"))
        .agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = rows.join(groups, rows["digest"] == groups["shared"], "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row and return the manifest (file, records, bytes)."""
    require_columns(pages, id_col, url_col, payload_col)
    folder = files.fresh_folder(pages.sparkSession, "warc")
    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes)
    return materialize(marked.mapInArrow(_write(folder, archive_bytes), _ARCHIVES), "warc-manifest")


_READ = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(keep_payload: bool, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column("file").to_pylist():
                held, size = [], 0
                with files.stream(uri) as source:
                    for r in read_records(source, keep_payload):
                        payload = bytes(r.payload) if keep_payload else None
                        held.append((r.name, r.headers.get("warc-target-uri"), r.kind, r.payload_bytes, r.payload_digest, r.refers_to, payload))
                        size += len(payload or b"")
                        if len(held) >= rows or size >= 1 << 24:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    return run


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records, a task per archive."""
    listed = manifest.select("file")
    return listed.repartition(max(1, listed.count())).mapInArrow(_read(keep_payload), _READ)
