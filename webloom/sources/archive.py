"""``webloom_archive``: captured responses in archives of web records (WARC), one gzip member for each, many members in a file.

    spark.dataSource.register(ArchiveSource)
    responses.write.format("webloom_archive").mode("append").save(path)      # url, status, status_text, headers, body
    spark.read.format("webloom_archive").load(path)

Reading plans ranges of bytes, so a file of any size is many tasks' work. A task looks for the first member that begins in its range (the bytes that begin one may also
occur within another: it counts only if it unpacks to a record), and reads on from member to member as long as they begin in the range. A member that can't be read is
a row with an error, and the next one is looked for. Records of other kinds than responses are passed over. Bodies are cut off at ``max_bytes``.

Folders are reached through pyarrow's file systems, as in ``webloom.sources.exchange``. Files appear when all tasks have ended.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from webloom.functions.kernels import plain
from webloom.functions.schemas import BOOLEAN, ONE_EACH, STRING, record
from webloom.sources.http import MOST_BYTES

RESPONSES = record(url=STRING, status=T.IntegerType(), status_text=STRING, headers=ONE_EACH, body=T.BinaryType(), truncated=BOOLEAN, error=STRING)
#: Bytes of a range, of a read, and of what stands before a record's body at most.
RANGE, READ, MOST_HEAD = 64 << 20, 1 << 20, 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")
_STATUS = re.compile(r"HTTP/[0-9.]+ +([0-9]{3}) ?(.*)")


# Records


def record_bytes(url: str, status: int | None, status_text: str | None, headers: dict[str, str], body: bytes) -> bytes:
    """A response as a record, packed. Names and values hold no line ends: such are blanks here."""
    line = lambda s: re.sub(r"[\r\n]+", " ", s)
    message = f"HTTP/1.1 {status or 0:03d} {line(status_text or '')}\r\n" + "".join(f"{line(k)}: {line(v)}\r\n" for k, v in headers.items())
    data = message.encode() + b"\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {line(url)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(data)}\r\n\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + data + b"\r\n\r\n") + packed.flush()


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; of equal names the last; lines that begin with a blank go on."""
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon and name:
            found[name] = value.strip()
        else:
            name = None
    return found


class Unreadable(ValueError):
    """A member that isn't a record."""


class Member:
    """The text of a member as it is unpacked: its head, and what follows up to a size."""

    def __init__(self, most: int) -> None:
        self.unpack, self.most = zlib.decompressobj(31), most
        self.data, self.length = bytearray(), 0

    def feed(self, piece: bytes) -> bytes:
        """Takes packed bytes, returns those behind the member's end. Raises Unreadable."""
        try:
            while piece and not self.unpack.eof:
                out = self.unpack.decompress(piece, READ)
                piece = self.unpack.unconsumed_tail
                self.length += len(out)
                if len(self.data) < self.most + MOST_HEAD:
                    self.data += out
                if self.length >= 5 and not self.data.startswith(b"WARC/"):
                    raise Unreadable("no record")
        except zlib.error as e:
            raise Unreadable(str(e)) from e
        return self.unpack.unused_data

    @property
    def over(self) -> bool:
        return self.unpack.eof

    def response(self) -> dict[str, Any] | None:
        """The row of a response; None for records of other kinds."""
        end = _BLANK_LINE.search(self.data, 0, MOST_HEAD)
        if end is None:
            raise Unreadable("a record without a head")
        about = _fields(self.data[: end.start()].decode("utf-8", "replace").splitlines()[1:])
        if about.get("warc-type", "").lower() != "response":
            return None
        size = int(about["content-length"]) if about.get("content-length", "").isdigit() else None
        message = self.data[end.end() : None if size is None else end.end() + size]
        split = _BLANK_LINE.search(message, 0, MOST_HEAD)
        lines = message[: split.start() if split else len(message)].decode("utf-8", "replace").splitlines()
        status = _STATUS.match(lines[0]) if lines else None
        if status is None:
            raise Unreadable("a response without a status")
        body = bytes(message[split.end() :]) if split else b""
        truncated = len(body) > self.most or size is not None and self.length < end.end() + size
        url = about.get("warc-target-uri", "").strip("<>")
        return {"url": url, "status": int(status[1]), "status_text": status[2], "headers": _fields(lines[1:]), "body": body[: self.most], "truncated": truncated, "error": None}


def responses_in(file: Any, start: int, stop: int, most: int = MOST_BYTES) -> Iterator[dict[str, Any]]:
    """Rows of the members that begin at start or later and before stop, of a file that can be read anywhere."""
    at = _next_member(file, start, stop)
    while at is not None and at < stop:
        member, position = Member(most), at
        try:
            while not member.over:
                file.seek(position)
                piece = file.read(READ)
                if not piece:
                    raise Unreadable("ends within a member")
                rest = member.feed(piece)
                position += len(piece) - len(rest)
            if (row := member.response()) is not None:
                yield row
            # Members follow one another; what lies between two of them is passed over.
            file.seek(position)
            at = position if file.read(len(_MAGIC)) == _MAGIC else _next_member(file, position, stop)
        except Unreadable as e:
            yield {"error": f"at {at}: {e}"}
            at = _next_member(file, at + 1, stop)


def _next_member(file: Any, at: int, stop: int) -> int | None:
    """Where the first member at or after a place begins; None if none does before stop."""
    while at < stop:
        file.seek(at)
        piece = file.read(READ)
        found = piece.find(_MAGIC)
        while found >= 0:
            if at + found >= stop:
                return None
            if _begins(file, at + found):
                return at + found
            found = piece.find(_MAGIC, found + 1)
        if len(piece) < READ:
            return None
        at += len(piece) - len(_MAGIC) + 1
    return None


def _begins(file: Any, at: int) -> bool:
    """Whether a record is packed at a place."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(4096), 5) == b"WARC/"
    except zlib.error:
        return False


# Data source


class ArchiveSource(DataSource):
    """Options: ``range_bytes`` and ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "webloom_archive"

    def schema(self) -> T.StructType:
        return RESPONSES

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, not replaced: use append")
        return ArchiveWriter(dict(self.options))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE))
        self.most = min(int(options.get("max_bytes", MOST_BYTES)), MOST_BYTES)

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        archives = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [Range(path, a, min(a + self.size, size)) for path, size in archives for a in range(0, size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        held: list[dict[str, Any]] = []
        n = 0
        with files.open_input_file(partition.path) as file:
            for row in responses_in(file, partition.start, partition.stop, self.most):
                held.append(row)
                n += len(row.get("body") or b"")
                if len(held) >= 256 or n >= 1 << 24:
                    yield _batch(held)
                    held, n = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([plain(r.get(f.name), f.dataType) for r in rows], to_arrow_type(f.dataType)) for f in RESPONSES], RESPONSES.names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """A file for each task; a task's attempts write files of their own, of which one is kept."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._folder()
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        name, n = f".{self.job}-{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}.warc.gz", 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for a in range(0, batch.num_rows, 64):
                    part = batch.slice(a, 64)
                    for url, status, text, headers, body in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("url", "status", "status_text", "headers", "body")), strict=True):
                        out.write(record_bytes(url or "", status, text, dict(headers or []), body or b""))
                        n += 1
        return Written(name if n else None)

    def _mine(self, files: fs.FileSystem, root: str) -> list[str]:
        return [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(f".{self.job}-")]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._folder()
        for m in messages:
            if m is not None and m.name:
                files.move(f"{root}/{m.name}", f"{root}/part-{m.name[1:]}")
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._folder()
        for name in self._mine(files, root):
            files.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
