"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per file, or per group of small files.  Within a file the
headers of a record are parsed first; predicates on header columns that Spark pushes down
(``spark.sql.python.filterPushdown.enabled``) are judged on them, and the payload of a
record that fails, or any payload where the option ``payload`` is ``false``, is skipped
without being decoded: by Content-Length in a plain file, and in a compressed one by the
member's length, which this writer notes in the gzip header's extra field (``sl``, after
the format's annex on record-at-time compression).  Members of other writers have no such
field; they are inflated to find their end, but not kept.

A file is read forward through one buffer.  A file is one task's work, as a member's start
can't be told from a payload's bytes, so the writer begins a new file after FILE_BYTES.

Files are opened through ``pyarrow.fs``, by URI.  Tasks write under ``_temporary``, in a folder
of the write's own; the commit moves the files of the tasks that Spark has accepted, so a task
that ran twice, or on an executor that was lost, leaves nothing behind.  A write in mode
``overwrite`` then deletes the archives that were there before.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16
PARTITION_BYTES = 128 << 20
FILE_BYTES = 256 << 20
"""A task's next record begins a new file once the last one has so many bytes."""
_ARCHIVE = re.compile(r"\.warc(\.gz)?$")
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), path


def _archives(fs, root: str) -> list:
    """The archives at or below a path, in order."""
    from pyarrow.fs import FileSelector, FileType

    info = fs.get_file_info(root)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True)) if info.type == FileType.Directory else []
    return sorted((x for x in found if x.type == FileType.File and _ARCHIVE.search(x.path) and "/_temporary/" not in x.path), key=lambda x: x.path)


# Writing


def _line(name: str, value: object) -> str:
    """A header line; characters that would end it are percent-encoded."""
    return f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(value))}\r\n"


def encoded_record(row: dict) -> bytes:
    """One record.  ``payload_digest`` is bare hexadecimal SHA-1; ``payload`` is left out of a revisit."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    head = "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", f"<{row['record_id']}>") + _line("WARC-Date", row["date"])
    if row["target_uri"] is not None:
        head += _line("WARC-Target-URI", row["target_uri"])
    if row["payload_digest"]:
        head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row["record_type"] == "revisit":
        head += _line("WARC-Profile", _REVISIT) + _line("WARC-Refers-To", f"<{row['refers_to']}>")
    head += "Content-Type: application/http; msgtype=response\r\n" + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of the data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if size >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + tail


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool, overwrite: bool = False, file_bytes: int = FILE_BYTES):
        self.path, self.compressed, self.overwrite, self.file_bytes = path.rstrip("/"), compressed, overwrite, file_bytes
        self.folder = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        names, out = [], None
        for batch in iterator:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                if out is None:
                    context = TaskContext.get()
                    names.append(f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                    fs.create_dir(f"{root}/{self.folder}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{self.folder}/{names[-1]}", compression=None)
                record = encoded_record(row)
                out.write(gzip_member(record) if self.compressed else record)
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.path for x in _archives(fs, root)] if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.names):
            fs.move(f"{root}/{self.folder}/{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)
        self._clean(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*_filesystem(self.path))

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.folder}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.folder}")


# Reading


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Buffer:
    """A file read forward in pieces: bytes that a record leaves in the buffer serve the next one, and a
    skip beyond it is a seek, so no byte is read twice."""

    def __init__(self, file):
        self.file, self.at, self.data, self.place = file, 0, b"", 0

    def goto(self, at: int) -> None:
        """Make ``at`` the current byte."""
        if self.at <= at <= self.at + len(self.data):
            self.place = at - self.at
        else:
            self.file.seek(at)
            self.at, self.data, self.place = at, b"", 0

    def chunk(self) -> bytes:
        """What the buffer holds from the current byte on, read anew where it is used up; empty at the end of the file."""
        if self.place >= len(self.data):
            self.at += len(self.data)
            self.data, self.place = self.file.read(_READ), 0
        out = self.data[self.place :] if self.place else self.data
        self.place = len(self.data)
        return out

    def head(self, size: int) -> bytes:
        """The next bytes, ``size`` of them unless the file ends, without moving on."""
        if len(self.data) - self.place < size:
            rest = self.data[self.place :]
            self.at += self.place
            self.data, self.place = rest + self.file.read(_READ), 0
        return self.data[self.place : self.place + size]


class _Record:
    """Bytes of one record, plain or inflated, from a buffer at a position."""

    def __init__(self, buffer: _Buffer, at: int):
        buffer.goto(at)
        self.buffer, self.size = buffer, None
        while (head := buffer.head(_READ)) and not head.strip(b"\r\n\x00"):
            at += len(head)
            buffer.goto(at)
        self.empty = not head
        self.gzip = head[:2] == b"\x1f\x8b"
        skip = 0 if self.gzip else len(head) - len(head.lstrip(b"\r\n"))
        self.at = at + skip
        buffer.goto(self.at)
        self.parts, self.held, self.raw = [], 0, b""
        if self.gzip:
            start, self.size = _gzip_start(head)
            self.inflate, self.base, self.fed = zlib.decompressobj(-15), at + start, 0
            buffer.goto(self.base)

    def more(self) -> bool:
        """Read on; whether there was anything."""
        if not self.gzip:
            data = self.buffer.chunk()
        elif self.inflate.eof:
            return False
        else:
            raw = self.raw or self.buffer.chunk()
            data = self.inflate.decompress(raw, _READ)
            # at the member's end what is left is unused data; the tail may repeat it
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            self.fed += len(raw) - len(self.inflate.unused_data if self.inflate.eof else self.raw)
            if raw and not data:
                return True
        self.parts.append(data)
        self.held += len(data)
        return bool(data)

    @property
    def data(self) -> bytes:
        if len(self.parts) > 1:
            self.parts = [b"".join(self.parts)]
        return self.parts[0] if self.parts else b""

    def until(self, mark: bytes, start: int) -> int:
        """Position after the mark, -1 if there is none."""
        found = self.data.find(mark, start)
        tail = self.data[max(start, self.held - len(mark) + 1) :]
        while found < 0:
            before, n = self.held - len(tail), len(self.parts)
            if not self.more():
                return -1
            seen = tail + b"".join(self.parts[n:])
            at, tail = seen.find(mark), seen[-len(mark) + 1 :]
            found = before + at if at >= 0 else -1
        return found + len(mark)

    def span(self, start: int, end: int) -> bytes:
        while self.held < end and self.more():
            pass
        return self.data[start:end]

    def next(self, end: int) -> int:
        """Where the next record begins, given the end of this one's block."""
        if not self.gzip:
            return self.at + end + 4
        if self.size is not None:
            return self.at + self.size
        while not self.inflate.eof and self.more():
            self.parts = []
        return self.base + self.fed + 8


def _gzip_start(first: bytes) -> tuple[int, int | None]:
    """Length of the gzip header, and the member's length if the header tells it."""
    flags, at, size = first[3], 10, None
    if flags & 4:
        (length,) = struct.unpack_from("<H", first, at)
        field, end = at + 2, at + 2 + length
        while field + 4 <= end:
            name, n = struct.unpack_from("<2sH", first, field)
            if name == b"sl" and n == 8:
                (size,) = struct.unpack_from("<I", first, field + 4)
            field += 4 + n
        at = end
    for flag in (8, 16):
        if flags & flag:
            at = first.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), size


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def _digest(value: str | None) -> str | None:
    """Lower-case hexadecimal of a labelled SHA-1 in base 32 or 16; other digests as they stand."""
    label, _, code = (value or "").rpartition(":")
    if label.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", code):
        return base64.b32decode(code.upper()).hex()
    return code.lower() if label.lower() == "sha1" else value


def _holds(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    return value in f.value if isinstance(f, In) else value.startswith(f.value)


def records(file, size: int, filters: list[Filter], payload: bool) -> Iterator[dict]:
    """The records of one file that pass the filters."""
    at, buffer = 0, _Buffer(file)
    while at < size:
        source = _Record(buffer, at)
        if source.empty:
            return
        head = source.until(b"\r\n\r\n", 0)
        if head < 0 or not source.data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(source.data[:head])
        length = int(fields["content-length"])
        row = {name: fields.get(key) for name, key in _HEADERS.items()}
        for name in ("record_id", "refers_to", "target_uri"):
            row[name] = row[name] and row[name].removeprefix("<").removesuffix(">")
        row["payload_digest"] = _digest(fields.get("warc-payload-digest"))
        if all(_holds(f, row) for f in filters):
            start, row["payload_bytes"] = head, length
            if fields.get("content-type", "").startswith("application/http"):
                start = source.until(b"\r\n\r\n", head)
                start = head + length if start < 0 else min(start, head + length)
                told = _fields(source.data[head:start]).get("content-length")
                row["payload_bytes"] = int(told) if told and told.isdigit() else head + length - start
            row["payload"] = source.span(start, head + length) if payload and row["record_type"] != "revisit" else None
            yield row
        at = source.next(head + length)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def partitions(self) -> list[InputPartition]:
        groups, held = [], 0
        for x in _archives(*_filesystem(self.path)):
            if not groups or held + x.size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(x.path)
            held += x.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in records(file, file.size(), self.filters, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class PushingWarcReader(WarcReader):
    def pushFilters(self, filters: list[Filter]):
        """Takes equality, membership, prefix and null tests on header columns; leaves the rest to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1
            if known and (f.attribute[0] in _HEADERS or f.attribute[0] == "payload_digest"):
                self.filters.append(f)
            else:
                yield f


class WarcDataSource(DataSource):
    """Options: path; payload (``true``; ``false`` leaves all payloads undecoded); pushdown (``true``; ``false``
    for sessions where ``spark.sql.python.filterPushdown.enabled`` is not set, which refuse readers that take
    predicates); compression (``gzip`` or ``none``); file_bytes (a file's size, about).

    Null header values are left out and read back as null; a null payload is an empty one.  Rows alike are
    records each; no rows make no file, and a path without archives reads as an empty table.  A payload of
    any length is one row, held in memory as such.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = WarcReader if self.options.get("pushdown", "true").lower() == "false" else PushingWarcReader
        return kind(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def registered(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push predicates down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
