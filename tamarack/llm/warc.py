"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files in the shared folder, one file per task attempt (so a repeated attempt
never touches a file that the index names). Captures are sorted by reversed-host key; their lines go into compressed
blocks, and a sparse directory holds the first and last key and the byte range of each block. A lookup binary-searches
the directory, reads the blocks by range, binary-searches their lines and reads the records by range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import fresh_path, materialise

NO_ID = -(2**63)
FILE_BYTES = 1 << 30
OUT_BYTES = 8 << 20
PAGE_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
CAPTURE = "key string, page_id long, url string, record_type string, file string, offset long, length long"
BLOCK = "first_key string, last_key string, captures long, file string, offset long, length long"
FOUND = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: the folder of WARC files and blocks, and the written directory of blocks."""

    path: str
    directory: str


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def url_key(url: str | None) -> str:
    """A URL as reversed host, then path and query: ``com,example,www)/a?b``. Null gives the empty key.

    Scheme, user, fragment and the usual port are left out; host in lower case. What cannot be parsed is its own key.
    """
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return quote(url, safe="/:?&=%~!*'(),;@+$#[]-._")
    at = ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/:?&=%~!*'(),;@+$#[]-._")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(PAGE_SPACE, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit that refers to another page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        # a header is one line; the URL itself is kept in the index
        lines.append("WARC-Target-URI: " + quote(url, safe="/:?&=%~!*'(),;@+$#[]-._"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP response, and the payload of an uncompressed record."""
    def headers(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    own = headers(head)
    body = rest[:int(own["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return own, headers(http), payload


class _Appender:
    """Members appended to files below a folder, a new file when one is full; names carry the task attempt."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        self.stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.folder, self.suffix, self.number, self.stream = folder, suffix, 0, None

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.stream is not None and self.offset + len(member) > FILE_BYTES:
            self.close()
        if self.stream is None:
            self.name = f"{self.stem}-{self.number}{self.suffix}"
            files, root = _filesystem(self.folder)
            files.create_dir(root, recursive=True)
            self.stream, self.offset = files.open_output_stream(f"{root}/{self.name}", compression=None), 0
            self.number += 1
        self.stream.write(member)
        at, self.offset = self.offset, self.offset + len(member)
        return self.name, at, len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, payload hash and the response's page_id (``_refers_to``) of the pages whose payload another page holds.

    Payloads of at least ``least_bytes`` are equal by SHA-256; the largest page_id of them is the response. Only hashes are
    shuffled, and counted before; a payload of many copies is split by the adaptive skew join.
    """
    hashed = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("_page"), F.octet_length("_html").alias("_bytes"),
                          F.sha2(F.col("_html").cast("binary"), 256).alias("_hash")).filter(F.col("_bytes") >= least_bytes)
    shared = hashed.groupBy("_hash").agg(F.max("_page").alias("_last"), F.min("_page").alias("_least")).filter("_last > _least")
    return hashed.join(shared, "_hash").filter("_page < _last").select("_page", "_hash", F.col("_last").alias("_refers_to")).distinct()


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z",
                  level: int = 6, lines_per_block: int = 1000) -> Archive:
    """Write a record per row of ``pages`` (page_id, url, html) and the index of all captures.

    Payload is the html in UTF-8, null html is empty. Of equal payloads of at least ``least_bytes`` the largest page_id is a
    response and others revisit it; smaller ones are all responses. Rows without page_id rank before all others and
    are looked up like them; rows that repeat the response's page_id are responses, too. Null urls have the empty key.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    narrow = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"))
    known = revisits(narrow, least_bytes)
    whole = narrow.withColumns({"_p": F.coalesce("page_id", F.lit(NO_ID)), "_h": F.sha2(F.col("_html").cast("binary"), 256)}).join(
        known, (F.col("_p") == F.col("_page")) & (F.col("_h") == F.col("_hash")), "left").select("page_id", "url", "_html", "_refers_to")
    captures_schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                                 ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        out = _Appender(f"{path}/records", ".warc.gz")
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                    payload = html.encode()
                    raw = record_bytes(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to, date)
                    place = out.add(gzip.compress(raw, level, mtime=0))
                    rows.append((url_key(url), page_id, url, "response" if refers_to is None else "revisit", *place))
                if rows:
                    yield _batch(rows, captures_schema)
        finally:
            out.close()

    captures = materialise(whole.mapInArrow(write, CAPTURE), "captures")
    return Archive(path, _write_index(captures, path, lines_per_block))


def _write_index(captures: DataFrame, path: str, lines_per_block: int) -> str:
    """Sorted lines in compressed blocks, and the directory of blocks; returns the directory's path."""
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("captures", pa.int64()),
                        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Appender(f"{path}/index", ".cdx.gz")
        keys: list[str] = []
        lines: list[str] = []

        def block() -> pa.RecordBatch:
            place = out.add(gzip.compress("\n".join(lines).encode(), 6, mtime=0))
            row = (keys[0], keys[-1], len(lines), *place)
            keys.clear()
            lines.clear()
            return _batch([row], schema)

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    keys.append(row["key"])
                    lines.append(row.pop("key") + " " + json.dumps(row))
                    if len(lines) == lines_per_block:
                        yield block()
            if lines:
                yield block()
        finally:
            out.close()

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = fresh_path(captures.sparkSession, "warc-directory")
    ordered.mapInArrow(blocks, BLOCK).repartitionByRange("first_key", "file", "offset").sortWithinPartitions(
        "first_key", "file", "offset").write.parquet(directory)
    return directory


class _Directory:
    """The sparse directory in one worker: a row per block, sorted by first key."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        files, root = _filesystem(path)
        table = ds.dataset(root, filesystem=files, format="parquet", schema=pa.schema([
            ("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])).to_table()
        table = table.sort_by([("first_key", "ascending"), ("last_key", "ascending"), ("file", "ascending"), ("offset", "ascending")])
        self.first, self.last = table["first_key"].to_pylist(), table["last_key"].to_pylist()
        self.places = list(zip(*(table[c].to_pylist() for c in ("file", "offset", "length")), strict=True))

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """The blocks that may hold a key; a key of many captures spans several."""
        yield from self.places[bisect.bisect_left(self.last, key):bisect.bisect_right(self.first, key)]


_directories: dict[str, _Directory] = {}


class _Ranges:
    """Range reads from files below a folder, one file open at a time."""

    def __init__(self, folder: str):
        self.files, self.root = _filesystem(folder)
        self.name, self.stream = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.stream = name, self.files.open_input_file(f"{self.root}/{name}")
        return self.stream.read_at(length, offset)


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures (page_id, url, record_type, file, offset, length) of distinct ``key`` values of :func:`url_key`.

    Each task binary-searches the directory (a row per thousand captures); keys are then sorted by block, so that each
    block is read and unpacked once per task, and its lines are binary-searched.
    """
    block_schema = pa.schema([("key", pa.string()), ("_file", pa.string()), ("_offset", pa.int64()), ("_length", pa.int64())])
    capture_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("file", pa.string()),
                                ("offset", pa.int64()), ("length", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if archive.directory not in _directories:
            _directories.clear()
            _directories[archive.directory] = _Directory(archive.directory)
        directory = _directories[archive.directory]
        for batch in batches:
            rows = [(key, *place) for key in batch.column(0).to_pylist() for place in directory.blocks(key)]
            if rows:
                yield _batch(rows, block_schema)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, at = _Ranges(f"{archive.path}/index"), None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                place = row["_file"], row["_offset"], row["_length"]
                if place != at:
                    lines = gzip.decompress(ranges.read(*place)).decode().split("\n")
                    at, held = place, [line.split(" ", 1)[0] for line in lines]
                for i in range(bisect.bisect_left(held, row["key"]), bisect.bisect_right(held, row["key"])):
                    c = json.loads(lines[i].split(" ", 1)[1])
                    rows.append(tuple(c[f.name] for f in capture_schema))
            if rows:
                yield _batch(rows, capture_schema)

    found = keys.select("key").distinct().mapInArrow(search, "key string, _file string, _offset long, _length long")
    ordered = found.repartitionByRange("_file", "_offset", "key").sortWithinPartitions("_file", "_offset", "key")
    return ordered.mapInArrow(captures, "page_id long, url string, record_type string, file string, offset long, length long")


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of captures, read by range in file order and checked against their digests.

    Returns page_id, url, record_type, refers_to, payload_digest (hex SHA-1), payload_bytes (both of the full payload) and
    payload (null for a revisit: it is that of the response it refers to).
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        ranges = _Ranges(f"{archive.path}/records")
        for batch in batches:
            rows, size = [], 0
            for c in batch.to_pylist():
                own, http, payload = parse_record(zlib.decompress(ranges.read(c["file"], c["offset"], c["length"]), 31))
                digest = base64.b32decode(own["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = own["WARC-Type"]
                page_id, refers_to = own.get("X-Page-Id"), own.get("X-Refers-To-Page-Id")
                if (None if page_id is None else int(page_id)) != c["page_id"] or kind != c["record_type"]:
                    raise ValueError(f"the index names another record at {c['file']}:{c['offset']}")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {page_id} does not match its digest")
                rows.append((c["page_id"], c["url"], kind, None if refers_to is None else int(refers_to), digest,
                             int(http["Content-Length"]), payload if kind == "response" else None))
                size += len(payload)
                if size >= OUT_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, FOUND)


def keys_of(pages: DataFrame) -> DataFrame:
    """The index keys of the urls of ``pages``."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select("url").mapInArrow(keys, "key string")
