"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes its own archives, one gzip member per record, and the commit lists the archives that count, so
what a lost or repeated task leaves behind is never read. Each member says its compressed length in its header (the
``sl`` extra field of the WARC standard's gzip annex).

Reading: the driver plans archives into partitions by size. A task inflates the beginning of a record up to the end of its
headers, applies the pushed predicates on record type and headers, and only then goes on: a record that is not wanted, or
whose payload is not in the schema, is skipped over by its compressed length without being inflated. Archives of others,
with plain members or without compression, are read as well.

Defined results: NULL ids, addresses and payloads are written as absent or empty; line breaks in an address are written
percent-encoded; repeated rows give repeated records; an empty table gives an empty archive list; further columns are
ignored. Of equal payloads the record with the largest id is the response, the others revisit it; a NULL id is never
referred to, and payloads that have no other id are all responses.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

# Bytes of archives that a partition reads, of an archive until the next begins, and of a record's beginning inflated at once.
PARTITION_BYTES, ARCHIVE_BYTES, HEAD_BYTES = 128 << 20, 256 << 20, 1 << 11
LISTED = "_archives.json"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, "
    "refers_to string, http_length long, headers map<string,string>, payload binary"
)
_HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "content_length": "content-length", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """A gzip member whose header tells its own compressed length and that of the record."""
    pack = zlib.compressobj(4, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = pack.compress(record) + pack.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def base32(sha1: str) -> str:
    """A hexadecimal SHA-1 in upper-case base32."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit that keeps the HTTP headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{urn(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        ("WARC-Refers-To", f"<{urn(refers_to)}>" if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers, http if revisit else http + (payload or b""))


def urn(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``page_id``, ``url``, ``payload``, ``length``, ``sha1`` and ``refers_to``."""

    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "length", "sha1", "refers_to")]
                for row in zip(*columns):
                    if out is None:
                        names.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    size += out.write(member(page_record(*row, self.date)))
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        if store.get_file_info(f"{base}/{LISTED}").type == fs.FileType.File:
            with store.open_input_stream(f"{base}/{LISTED}") as file:
                names = sorted({*names, *json.loads(file.read())})
        with store.open_output_stream(f"{base}/{LISTED}") as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Archives that are not listed are never read."""


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


def _compare(kind, left, right) -> bool:
    if isinstance(kind, EqualNullSafe):
        return left == right
    if left is None or right is None:
        return False
    return {
        EqualTo: lambda: left == right, GreaterThan: lambda: left > right, GreaterThanOrEqual: lambda: left >= right, LessThan: lambda: left < right,
        LessThanOrEqual: lambda: left <= right, StringStartsWith: lambda: left.startswith(right), StringEndsWith: lambda: left.endswith(right),
        StringContains: lambda: right in left,
    }[type(kind)]()


def holds(wanted, value) -> bool:
    """Whether a pushed filter holds for a header's value."""
    if isinstance(wanted, IsNull):
        return value is None
    if isinstance(wanted, IsNotNull):
        return value is not None
    if isinstance(wanted, In):
        return value is not None and value in wanted.value
    return _compare(wanted, value, wanted.value)


class Record:
    """A record as far as it has been read: its headers, and a way to the block."""

    def __init__(self, head: bytes, block):
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        self.block = block

    def field(self, name: str):
        value = self.headers.get(_HEADER_OF[name])
        if value is None:
            return None
        if name == "content_length":
            return int(value)
        return value[1:-1] if name in ("record_id", "refers_to") and value[:1] == "<" else value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.names, self.schema, self.partition_bytes = path, schema.names, schema, partition_bytes
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        """Predicates on record type and headers are kept here; Spark applies the others."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            supported = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)
            column = getattr(inner, "attribute", ())
            if f is inner and isinstance(f, supported) and len(column) == 1 and column[0] in _HEADER_OF:
                self.wanted.append((column[0], f))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        store, base = filesystem(self.path)
        listed = store.get_file_info(f"{base}/{LISTED}").type == fs.FileType.File
        if listed:
            with store.open_input_stream(f"{base}/{LISTED}") as file:
                names = json.loads(file.read())
            found = store.get_file_info([f"{base}/{n}" for n in names]) if names else []
        else:
            info = store.get_file_info(base)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        plan, held, size = [], [], 0
        for path, n in found:
            if held and size + n > self.partition_bytes:
                plan.append(Archives(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*plan, *([Archives(tuple(held))] if held else [])]

    def read(self, partition: Archives | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        store, _ = filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths if partition else ():
            with store.open_input_file(path) as file:
                for rec in (compressed if file.read(2) == b"\x1f\x8b" else plain)(file):
                    if all(holds(f, rec.field(name)) for name, f in self.wanted):
                        rows.append(self.row(rec))
                        size += 200 + len(rows[-1].get("payload") or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def row(self, rec: Record) -> dict:
        out = {}
        for name in self.names:
            if name == "headers":
                out[name] = list(rec.headers.items())
            elif name == "http_length":
                out[name] = http_length(rec.block(limit=HEAD_BYTES)) if "application/http" in (rec.field("content_type") or "") else None
            elif name == "payload":
                block = rec.block()
                out[name] = block.partition(b"\r\n\r\n")[2] if "application/http" in (rec.field("content_type") or "") else block
            else:
                out[name] = rec.field(name)
        return out


def http_length(block: bytes) -> int | None:
    """Content-Length of the HTTP headers a block begins with."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def split_head(data: bytes) -> tuple[bytes, int] | None:
    """The header lines of a record and where its block begins."""
    end = data.find(b"\r\n\r\n")
    return None if end < 0 else (data[:end], end + 4)


def compressed(file) -> Iterator[Record]:
    """Records of an archive of gzip members. A member is inflated as far as it is asked for."""
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        begin = file.read(HEAD_BYTES)
        known = begin[3] & 4 and begin[12:14] == b"sl"
        length = struct.unpack("<I", begin[16:20])[0] if known else None
        inflate, given, data, read = zlib.decompressobj(zlib.MAX_WBITS | 16), begin, bytearray(), at + len(begin)

        def more(limit: int) -> bool:
            """Inflate up to ``limit`` further bytes; False at the end of the member."""
            nonlocal given, read
            while not inflate.eof:
                if not given:
                    file.seek(read)
                    given = file.read(1 << 16)
                    read += len(given)
                    if not given:
                        raise ValueError("a WARC archive ends within a record")
                got = inflate.decompress(given, limit)
                given = inflate.unconsumed_tail
                if got:
                    data.extend(got)
                    return True
            return False

        while (cut := split_head(data)) is None and more(HEAD_BYTES):
            pass
        if cut is None:
            raise ValueError("a WARC record has no end of headers")
        head, start = cut

        def block(limit: int | None = None, start=start) -> bytes:
            size = min(rec.field("content_length") or 0, limit if limit is not None else 1 << 62)
            while len(data) < start + size and more(1 << 20):
                pass
            return bytes(data[start : start + size])

        rec = Record(head, block)
        yield rec
        if length is not None:
            at += length
        else:
            while more(1 << 20):
                del data[:]
            at = read - len(inflate.unused_data)


def plain(file) -> Iterator[Record]:
    """Records of an archive without compression; blocks are sought over unless asked for."""
    at, end = 0, file.size()
    while at < end:
        data, cut = b"", None
        while cut is None and at + len(data) < end:
            file.seek(at + len(data))
            data += file.read(HEAD_BYTES)
            if len(data) <= 4 and not data.strip():
                return
            cut = split_head(data)
        if cut is None:
            raise ValueError("a WARC record has no end of headers")
        head, start = cut

        def block(limit: int | None = None, begin=at + start) -> bytes:
            file.seek(begin)
            return file.read(min(rec.field("content_length") or 0, limit if limit is not None else 1 << 62))

        rec = Record(head, block)
        yield rec
        at += start + (rec.field("content_length") or 0) + 4


class WarcDataSource(DataSource):
    """Options: ``path``; ``partition_bytes`` for reading; ``date`` of the records for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row; of equal payloads of at least ``min_bytes`` bytes that with the largest id is the response."""
    register(pages.sparkSession)
    raw = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    counted = rows.groupBy("sha1", "length").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    repeated = counted.where((F.col("n") > 1) & (F.col("length") >= min_bytes)).select("sha1", "latest")
    told = rows.join(repeated, "sha1", "left")
    refers = F.when(F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id")), F.col("latest"))
    told = told.withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    told.select("page_id", "url", "payload", "length", "sha1", "refers_to").write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, columns: str = "record_id string, record_type string, payload_digest string, refers_to string, http_length long") -> DataFrame:
    """The records of an archive folder; a payload is inflated only if ``columns`` names it."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)
