"""Crawl archives (WARC 1.0 and 1.1, plain or gzip) as a Spark data source, to read and to write.

One partition for each file, read as a stream: a task holds one record at a time. Files are reached through the file
system that the path names. ``register`` makes the format ``warc`` known to a session.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "warc"
SCHEMA = """file string, pos long, type string, record_id string, target_uri string, date string, headers map<string,string>,
 status int, http_headers map<string,string>, body binary, error string"""
CHUNK = 1 << 20
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
#: Bytes kept at the end of a damaged piece: the next record may begin in them.
OVERLAP = 16


class Bytes:
    """A file's bytes in order, gzip members unpacked; ``damage`` tells of members that could not be unpacked."""

    def __init__(self, stream):
        self.stream, self.held, self.damage, self.done = stream, bytearray(), None, False
        self.raw = stream.read(CHUNK)
        self.packed = self.raw[:3] == GZIP
        self.member = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Unpack the next piece; False at the end of the file."""
        if not self.packed:
            self.held += self.raw
            self.raw, self.done = self.stream.read(CHUNK), not self.raw
            return not self.done
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            if not self.done and self.member is not None and not self.member.eof:
                self.held += self.member.flush()
                if not self.member.eof:
                    self.damage = self.damage or "gzip member is cut off"
            self.done = True
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        try:
            self.held += self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if not self.raw and self.member.eof:
                self.member, self.raw = None, self.stream.read(CHUNK)
        except zlib.error as error:
            self.damage, self.member = f"gzip: {error}", None
            self._skip_member()
        return True

    def _skip_member(self) -> None:
        """Go on at the next place that looks like the start of a member."""
        rest = self.raw[1:]
        while (at := rest.find(GZIP)) < 0:
            piece = self.stream.read(CHUNK)
            if not piece:
                self.raw = b""
                return
            rest = rest[-2:] + piece
        self.raw = rest[at:]


def header_lines(block: bytes) -> dict[str, str]:
    """Names in lower case; a repeated name keeps its values, joined by commas."""
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def http_parts(content: bytes) -> tuple[int | None, dict[str, str] | None, bytes]:
    """Status, headers and body of an HTTP response; content of another kind is all body."""
    head, blank, body = content.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    status = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", first)
    return (int(status[1]), header_lines(lines), body) if status and blank else (None, None, content)


def records(stream, file: str) -> Iterator[tuple]:
    """Rows of one archive. What can't be read as a record is a row with ``error`` and the bytes that were skipped."""
    data, pos = Bytes(stream), 0

    def damaged(skipped: bytes, error: str) -> tuple:
        return (file, pos, None, None, None, None, None, None, None, skipped, error)

    while True:
        while not data.held.strip(b"\r\n") and data.more():
            pass
        if data.damage:
            yield damaged(b"", data.damage)
            pos, data.damage = pos + 1, None
        del data.held[: len(data.held) - len(data.held.lstrip(b"\r\n"))]
        if not data.held:
            if data.done:
                return
            continue
        while b"\r\n\r\n" not in data.held and len(data.held) < CHUNK and not VERSION.search(data.held, 1) and data.more():
            pass
        head = data.held.find(b"\r\n\r\n")
        headers = header_lines(bytes(data.held[: max(head, 0)]).partition(b"\r\n")[2])
        length = headers.get("content-length", "")
        if not VERSION.match(data.held) or head < 0 or not length.isdecimal():
            # what lies before the next record, in pieces
            while not VERSION.search(data.held, 1) and len(data.held) < CHUNK and data.more():
                pass
            found = VERSION.search(data.held, 1)
            stop = found.start() if found else len(data.held) if data.done else max(len(data.held) - OVERLAP, 1)
            found = None
            yield damaged(bytes(data.held[:stop]), "no record header")
            pos += 1
            del data.held[:stop]
            continue
        end = head + 4 + int(length)
        while len(data.held) < end and not data.damage and data.more():
            pass
        content = bytes(data.held[head + 4 : end])
        short = len(content) < int(length)
        status, http, body = http_parts(content) if headers.get("warc-type") == "response" else (None, None, content)
        error = "record is cut off" if short else None
        yield (file, pos, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), headers, status, http, body, error)
        pos += 1
        del data.held[: min(end, len(data.held))]


def file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class ArchiveFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs

        system, path = file_system(self.folder)
        if system.get_file_info(path).type == fs.FileType.File:
            return [ArchiveFile(path)]
        listed = system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(i.path for i in listed if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        return [ArchiveFile(n) for n in names if re.search(r"\.warc(\.gz)?$", n)]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if partition is None:
            return  # a folder without archives
        system, _ = file_system(self.folder)
        with system.open_input_stream(partition.path, compression=None) as stream:
            yield from records(stream, partition.path.rsplit("/", 1)[-1])


class Written(WriterCommitMessage):
    def __init__(self, hidden: str, name: str):
        self.hidden, self.name = hidden, name


class ArchiveWriter(DataSourceWriter):
    """One gzip archive for each task. A file gets its name when all tasks are done, so a repeated task leaves no double."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(f"{path}/_{name}", compression=None) as out:
            for row in rows:
                out.write(self._member(row))
        return Written(f"{path}/_{name}", f"{path}/{name}")

    def _member(self, row) -> bytes:
        # a line break inside a value would begin another header
        def line(name: str, value) -> str:
            return f"{name}: " + re.sub(r"[\r\n]+", " ", str(value)) + "\r\n"

        body = bytes(row["body"] or b"")
        http = "".join(line(k, v) for k, v in (row["http_headers"] or {}).items())
        content = f"HTTP/1.1 {row['status'] or 200} \r\n{http}\r\n".encode() + body
        head = "WARC/1.1\r\nWARC-Type: response\r\n" + line("WARC-Record-ID", row["record_id"]) + line("WARC-Target-URI", row["target_uri"])
        head += line("WARC-Date", row["date"]) + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(content)}\r\n\r\n"
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(head.encode("utf-8") + content + b"\r\n\r\n") + packer.flush()

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.folder)
        for message in messages:
            if message:
                system.move(message.hidden, message.name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.folder)
        for message in messages:
            if message:
                system.delete_file(message.hidden)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, damaged ones with ``error`` set."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def write_archives(responses: DataFrame, path: str) -> None:
    """Write (record_id, target_uri, date, status, http_headers, body) as response records."""
    register(responses.sparkSession)
    columns = ("record_id", "target_uri", "date", "status", "http_headers", "body")
    responses.select(*columns).write.format(FORMAT).mode("append").save(path)


def archived_pages(archives: DataFrame) -> DataFrame:
    """Pages of whole responses: (url, html, fetched_at, record_id); texts are taken as UTF-8."""
    whole = archives.where("error IS NULL AND type = 'response' AND status BETWEEN 200 AND 299")
    html = F.decode("body", "UTF-8").alias("html")
    return whole.select(F.col("target_uri").alias("url"), html, F.to_timestamp("date").alias("fetched_at"), "record_id")
