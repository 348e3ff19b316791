"""WARC archives: written one gzip member per record, read back as a stream.

Writing: every task writes its rows to one archive in a shared folder and returns the archive's name; a task
that is tried again writes another file, and only names that were returned are read. A payload of 1000 bytes or
more that several pages share is stored once, with the page of the largest id; the others become revisit
records, which keep the HTTP header (with the full length) and refer to the response. Which pages share
a payload is found by an aggregate over digests, joined back; a payload that a third of all pages share is a
skewed join key, which adaptive execution splits.

Reading: an archive is read in small pieces from front to back. Bytes go through one zlib decompressor per
gzip member; the header block ends at an empty line, Content-Length tells how many bytes of block follow, the
payload is hashed as it passes, and its digest and length are verified. Memory does not depend on the size of an
archive or of a record. A truncated or damaged archive raises.

Folders: paths are those of Spark, opened with Arrow's file systems (local or mounted folders, HDFS, object
stores).

Cases: NULL html is an empty payload; a short payload is always a response; rows that share the largest page_id
of a payload are all responses; a NULL page_id is always a response and never referred to; repeated rows each
make a record; other columns are ignored; an empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import stored
from taxaloom.session import shared_folder

MIN_REVISIT_BYTES = 1000
READ_BYTES = 1 << 16
LEVEL = 4
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


# ---- writing


def member(headers: list[tuple[str, str]], block: list[bytes]) -> bytes:
    """One record as one gzip member."""
    size = sum(map(len, block))
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {size}".encode()]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = [packer.compress(b"\r\n".join(lines) + b"\r\n\r\n")]
    parts += [packer.compress(x) for x in block]
    return b"".join([*parts, packer.compress(b"\r\n\r\n"), packer.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response record of a page, or a revisit record if it refers to another page."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = " ".join((url or "").split())
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is None:
        return member(headers, [http, payload])
    more = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return member([*headers, *more], [http])


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    text = record.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the page that holds the payload, NULL for one that holds its own."""
    kept = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    long = F.octet_length("html") >= MIN_REVISIT_BYTES
    digested = kept.withColumn("digest", F.when(long, F.sha2(F.col("html").cast("binary"), 256)))
    shared = (
        digested.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("digest").alias("shared"), "holder")
    )
    # Pages without a digest meet nothing; a key of their own spreads them over all tasks.
    own = F.concat(F.lit("none "), F.coalesce(F.col("page_id").cast("string"), F.xxhash64("html").cast("string")))
    joined = digested.join(shared, F.coalesce(F.col("digest"), own) == F.col("shared"), "left")
    refers = F.when(F.col("holder") != F.col("page_id"), F.col("holder"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages with their revisits, an archive per task. Returns archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, "", 0
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    files.create_dir(path, recursive=True)
                    name = f"{path.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(name, compression=None)
                page_id, url, html, refers_to = row
                out.write(page_record(page_id, url, html.encode(), refers_to))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return pages.mapInArrow(run, "archive string, records long")


# ---- reading


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_sha1: str


class Members:
    """The content of concatenated gzip members, a member at a time, in pieces."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.ended = read, b"", False

    def _fill(self) -> bool:
        if not self.held:
            self.held = self.read(READ_BYTES)
        return bool(self.held)

    def more(self) -> bool:
        """Whether another member starts here."""
        return self._fill()

    def pieces(self) -> Iterator[bytes]:
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not self._fill():
                raise WarcError("the archive ends inside a record")
            given, self.held = self.held, b""
            while True:
                try:
                    piece = unpacker.decompress(given, READ_BYTES)
                except zlib.error as e:
                    raise WarcError(f"damaged record: {e}") from e
                if piece:
                    yield piece
                given = unpacker.unconsumed_tail
                if unpacker.eof or not given and len(piece) < READ_BYTES:
                    break
            self.held = unpacker.unused_data


def _head(held: bytes, pieces: Iterator[bytes]) -> tuple[list[str], bytes]:
    """Lines up to the empty line, and the bytes read beyond it."""
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a header block does not end")
        held += piece
    return held[:end].decode().split("\r\n"), held[end + 4 :]


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(read: Callable[[int], bytes], take: Callable[[bytes], None] = lambda piece: None) -> Iterator[Record]:
    """The records of an archive in order. Pieces of payload go to take as they pass."""
    members = Members(read)
    while members.more():
        pieces = members.pieces()
        lines, rest = _head(b"", pieces)
        if lines[0].encode() != VERSION:
            raise WarcError(f"not a record: {lines[0][:40]!r}")
        headers = _fields(lines[1:])
        left = int(headers["content-length"])
        http_lines, body = _head(rest, pieces)
        left -= len("\r\n".join(http_lines).encode()) + 4
        sha, size = hashlib.sha1(), 0
        while True:
            inside, after = body[:left], body[left:]
            sha.update(inside)
            take(inside)
            size, left = size + len(inside), left - len(inside)
            if not left:
                break
            body = next(pieces, None)
            if body is None:
                raise WarcError("a record is shorter than its Content-Length")
        if after + b"".join(pieces) != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        http = _fields(http_lines[1:])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response":
            if sha.hexdigest() != digest:
                raise WarcError(f"the payload of {headers['warc-record-id']} does not match its digest")
            if size != int(http["content-length"]):
                raise WarcError(f"the payload of {headers['warc-record-id']} has {size} bytes")
        yield Record(headers, http, size, digest)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the named archives, an archive per row of archives and as many tasks as archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows = []
                with files.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream.read):
                        kind, refers = record.headers["warc-type"], record.headers.get("warc-refers-to")
                        rows.append(
                            (
                                page_of(record.headers["warc-record-id"]),
                                int(record.http["content-length"]),
                                record.headers["warc-payload-digest"].removeprefix("sha1:"),
                                kind,
                                None if refers is None else page_of(refers),
                            )
                        )
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # Names are tiny, so adaptive execution would merge them into one task if the number were not given.
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    # The list of archives is a table, so they are written once, however often it is read.
    return read_archives(stored(write_archives(with_revisits(pages), folder), "archives"), folder)
