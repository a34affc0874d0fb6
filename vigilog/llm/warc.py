"""WARC archives as a Spark data source, read and written.

``register(spark)`` once, then ``df.write.format("warc").mode("append").save(path)`` and
``spark.read.format("warc").load(path)``. Files are planned into partitions by size. A reader parses
the headers of a record, tests the pushed predicates on them, and goes on to the next record unless
they hold; a block is decoded only for records that are wanted, and only if a column of the payload
is asked for (``.schema(...)`` without them skips all blocks). Conditions on any column but those of
the payload and the map of headers are pushed down.

A task writes files of its own, which count once the job has committed: a manifest names them, so
what a lost or repeated task left behind is not read. Folders without a manifest, as of other
writers, are read whole. Compressed files have one gzip member per record. Paths are those that
``pyarrow.fs`` opens (local, hdfs, s3, gs), since Python tasks read and write them.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import materialise

#: Size at which a writer begins another file, and up to which files share a partition.
FILE_BYTES = 32 << 20
#: Bytes of payload and records of one batch of rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2048
#: Most bytes of the headers of a record, so that a broken file ends in an error and not in memory.
HEADER_BYTES = 1 << 20

SCHEMA = """
    record_id string, type string, date string, target_uri string, refers_to string, payload_digest string,
    content_type string, content_length bigint, headers map<string,string>,
    payload_bytes bigint, payload binary, file string, offset bigint
"""
#: Columns by the header that holds them.
FROM_HEADER = {
    "record_id": "warc-record-id",
    "type": "warc-type",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
PUSHED = {*FROM_HEADER, "payload_digest", "content_length", "file", "offset"}
OF_BLOCK = {"payload", "payload_bytes"}
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
MANIFEST = "_committed-"


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to the session and let it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"s3[an]://", path):
        path = "s3" + path[3:]
    if re.match(r"file:/(?!//)", path):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """Files that count under a path, with their sizes."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no archive at {path}")
    files = {f.path: f.size for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file}
    manifests = [f for f in files if posixpath.basename(f).startswith(MANIFEST)]
    if not manifests:
        return sorted((f, n) for f, n in files.items() if f.endswith((".warc", ".warc.gz")))
    named = []
    for manifest in manifests:
        with store.open_input_stream(manifest) as stream:
            named += json.loads(stream.read())["files"]
    base = path.rstrip("/")
    return sorted((f"{base}/{name}", files[f"{base}/{name}"]) for name in named)


def _clean(value: str) -> str:
    """A header value on one line: control characters as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex(value: str | None) -> str | None:
    """The digest of a header as lower-case hex, whether it came in hex or base 32; other digests keep their label."""
    if value is None or not value.lower().startswith("sha1:"):
        return value
    own = value[5:].strip()
    if re.fullmatch(r"[0-9a-fA-F]{40}", own):
        return own.lower()
    try:
        return base64.b32decode(own.upper()).hex()
    except ValueError:
        return value


def _holds(test: Filter, row: dict) -> bool | None:
    """The value of a predicate as SQL has it: None where a null decides."""
    if isinstance(test, Not):
        inner = _holds(test.child, row)
        return None if inner is None else not inner
    own = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return own is None
    if isinstance(test, IsNotNull):
        return own is not None
    if isinstance(test, EqualNullSafe):
        return own == test.value
    if own is None:
        return None
    if isinstance(test, In):
        return own in test.value or (None if None in test.value else False)
    if test.value is None:
        return None
    return TESTS[type(test)](own, test.value)


def _bytewise(f):
    """Strings compare by their bytes, as in Spark."""
    return lambda a, b: f(a.encode(), b.encode()) if isinstance(a, str) else f(a, b)


TESTS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: _bytewise(lambda a, b: a > b),
    GreaterThanOrEqual: _bytewise(lambda a, b: a >= b),
    LessThan: _bytewise(lambda a, b: a < b),
    LessThanOrEqual: _bytewise(lambda a, b: a <= b),
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: str.__contains__,
}


def _takes(test: Filter) -> bool:
    if isinstance(test, Not):
        return _takes(test.child)
    known = isinstance(test, (IsNull, IsNotNull, EqualNullSafe, In)) or type(test) in TESTS
    return known and len(test.attribute) == 1 and test.attribute[0] in PUSHED


class _Counted(io.RawIOBase):
    """A stream of the store as raw input."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("an archive ends inside a record")
        n -= got


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("an archive ends inside a record")
    return data


def _head(stream) -> dict[str, str] | None:
    """Headers of the next record, or None at the end. Names are in lower case, continued lines are joined."""
    line = stream.readline(HEADER_BYTES)
    while line in (b"\r\n", b"\n"):
        line = stream.readline(HEADER_BYTES)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    headers, name, size = {}, None, 0
    while True:
        line = stream.readline(HEADER_BYTES)
        size += len(line)
        if size >= HEADER_BYTES or not line:
            raise ValueError("the headers of a record don't end")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return headers
        if text[0] in " \t" and name:
            headers[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()


def _block(row: dict, block: bytes) -> tuple[int, bytes]:
    """Bytes of the whole payload and the payload that the record holds."""
    http = (row["content_type"] or "").lower().startswith("application/http")
    if not http:
        return len(block), block
    head, _, payload = block.partition(b"\r\n\r\n")
    if row["type"] == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return (int(stated[1]) if stated else len(payload)), payload
    return len(payload), payload


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes
        self.tests: list[Filter] = []
        unknown = set(schema.names) - {f.split()[0] for f in re.split(r",(?![^<]*>)", SCHEMA)}
        if unknown:
            raise ValueError(f"an archive has no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            if _takes(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        """Files in order of their size, so many to a partition that it has about ``partition_bytes``."""
        store, path = _store(self.path)
        planned, group, size = [], [], 0
        for name, n in sorted(_names(store, path), key=lambda f: (-f[1], f[0])):
            if group and size + n > self.partition_bytes:
                planned.append(Files(tuple(group)))
                group, size = [], 0
            group.append((name, n))
            size += n
        if group or not planned:
            planned.append(Files(tuple(group)))
        return planned

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        schema = to_arrow_schema(self.schema)
        wants = bool(OF_BLOCK & set(names))
        store, _ = _store(self.path)
        columns, size, rows = {n: [] for n in names}, 0, 0
        for file, _ in partition.files:
            for row in self._records(store, file, wants):
                for n in names:
                    columns[n].append(row.get(n))
                rows += 1
                size += len(row.get("payload") or b"") + 256
                if size >= BATCH_BYTES or rows >= BATCH_ROWS:
                    yield self._batch(columns, rows, schema)
                    columns, size, rows = {n: [] for n in names}, 0, 0
        if rows:
            yield self._batch(columns, rows, schema)

    @staticmethod
    def _batch(columns: dict, rows: int, schema: pa.Schema) -> pa.RecordBatch:
        arrays = [pa.array([list(m.items()) for m in columns[f.name]] if f.name == "headers" else columns[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def _records(self, store: fs.FileSystem, file: str, wants: bool) -> Iterator[dict]:
        """Rows of a file that the predicates let pass. ``offset`` counts uncompressed bytes."""
        zipped = file.endswith(".gz")
        with store.open_input_file(file) as opened:
            raw = io.BufferedReader(_Counted(opened), 1 << 18)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if zipped else opened
            lines = stream if zipped else _Lines(opened)
            while True:
                at = lines.tell()
                headers = _head(lines)
                if headers is None:
                    return
                row = {column: headers.get(name) for column, name in FROM_HEADER.items()}
                row |= {"payload_digest": _hex(headers.get("warc-payload-digest")), "headers": headers, "file": file, "offset": at}
                length = row["content_length"] = int(headers["content-length"])
                if not all(_holds(test, row) for test in self.tests):
                    _skip(stream, length) if zipped else lines.skip(length)
                    continue
                if not wants:
                    _skip(stream, length) if zipped else lines.skip(length)
                else:
                    row["payload_bytes"], row["payload"] = _block(row, _exactly(lines, length))
                yield row


class _Lines:
    """Lines and blocks of a file that can seek: what is skipped is not read, beyond a look ahead."""

    AHEAD = 1 << 14

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def tell(self) -> int:
        return self.at

    def readline(self, most: int) -> bytes:
        while (end := self.buffer.find(b"\n")) < 0 and len(self.buffer) < most:
            more = self.file.read(self.AHEAD)
            if not more:
                end = len(self.buffer) - 1
                break
            self.buffer += more
        line, self.buffer = self.buffer[: end + 1], self.buffer[end + 1 :]
        self.at += len(line)
        return line

    def read(self, n: int) -> bytes:
        data, self.buffer = self.buffer[:n], self.buffer[n:]
        if len(data) < n:
            data += self.file.read(n - len(data))
        self.at += len(data)
        return data

    def skip(self, n: int) -> None:
        held = min(n, len(self.buffer))
        self.buffer = self.buffer[held:]
        if n > held:
            end = self.file.tell() + n - held
            if end > self.file.size():
                raise ValueError("an archive ends inside a record")
            self.file.seek(end)
        self.at += n


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows ``record_id, type, payload`` and, if there, ``date, target_uri, refers_to, payload_digest`` (hex), ``payload_bytes``.

    A revisit has the HTTP headers of its payload, its size among them, and not the payload."""

    def __init__(self, path: str, overwrite: bool, zipped: bool, file_bytes: int):
        self.path, self.overwrite, self.zipped, self.file_bytes = path, overwrite, zipped, file_bytes
        self.job = uuid.uuid4().hex
        self.now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def record(self, row: dict) -> bytes:
        kind, payload = row["type"], row["payload"] or b""
        size = row.get("payload_bytes")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
        block = http if kind == "revisit" else http + payload
        digest = row.get("payload_digest")
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", row["record_id"]),
            ("WARC-Date", row.get("date") or self.now),
            ("WARC-Target-URI", row.get("target_uri")),
            ("WARC-Payload-Digest", digest and f"sha1:{_base32(digest)}"),
            ("WARC-Refers-To", row.get("refers_to")),
            ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
            ("Content-Type", HTTP_TYPE),
            ("Content-Length", str(len(block))),
        ]
        lines = [VERSION, *(f"{name}: {_clean(value)}" for name, value in headers if value is not None), "", ""]
        whole = b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))
        return gzip.compress(whole, 6, mtime=0) if self.zipped else whole

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        own, files, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for batch in iterator:
                columns = [(name, batch.column(name)) for name in batch.schema.names]
                for i in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{self.job}-{own}-{len(files)}.warc" + ".gz" * self.zipped)
                        out, size = store.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                    data = self.record({name: column[i].as_py() for name, column in columns})
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file] if self.overwrite else []
        files = [name for m in messages if m for name in m.files]
        # In one move, so that a reader sees all files of the job or none.
        with store.open_output_stream(f"{path}/.{MANIFEST}{self.job}") as out:
            out.write(json.dumps({"files": files}).encode())
        store.move(f"{path}/.{MANIFEST}{self.job}", f"{path}/{MANIFEST}{self.job}.json")
        for name in old:
            if self.job not in name:
                store.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for name in (name for m in messages if m for name in m.files):
            store.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """Options: ``path``; ``compression`` (``gzip`` or ``none``), ``fileBytes``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partitionBytes", FILE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        missing = {"record_id", "type", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"records need columns {sorted(missing)}")
        zipped = self.options.get("compression", "gzip") == "gzip"
        return WarcWriter(self.options["path"], overwrite, zipped, int(self.options.get("fileBytes", FILE_BYTES)))


#: Payloads under so many bytes are always written whole.
REVISIT_BYTES = 1000
_ID = "urn:page:"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(record: Column) -> Column:
    own = F.regexp_extract(record, f"^<{_ID}(-?[0-9]+)>$", 1)
    return F.when(own != "", own.cast("bigint"))


def records(pages: DataFrame) -> DataFrame:
    """One record per row of ``page_id, url, html``: rows that the writer takes.

    Of pages with equal payloads (UTF-8; null is empty) of ``REVISIT_BYTES`` or more, that with the
    largest ``page_id`` is a response and the others revisit it; all rows with that id are responses.
    Without an id a page comes before all others. Null urls have no header. An empty table gives no rows.

    Payloads meet as digests and ids only, counted before they are shuffled. Groups of one go; the others are
    written, so that their join is a broadcast below the session's limit and else a shuffle that adaptive
    execution splits where a group is hot.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    key = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.sha2("payload", 256))
    own = own.withColumn("key", key)
    groups = own.filter("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"))
    groups = materialise(groups.filter("copies > 1").select(F.unhex("key").alias("copied"), "latest"), "warc-copies")
    paired = own.withColumn("key", F.unhex("key")).join(groups, F.col("key") == F.col("copied"), "left")
    # Equal null ids: a group without any id has a null latest, and all its pages are responses.
    revisits = F.col("copied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return paired.select(
        record_id(F.col("page_id")).alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("type"),
        "target_uri",
        F.when(revisits, record_id(F.col("latest"))).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def verified(archive: DataFrame) -> DataFrame:
    """Records with the digest of what was read: that of the payload for responses, the stated one for revisits."""
    return archive.withColumn("payload_digest", F.when(F.col("type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload")))
