"""WARC archives as a Python data source.

Writing: each task rolls over to a new file at a size bound, one gzip member per record, and
the commit lists the files, so files of lost or repeated attempts are never read.  Every
member says its own length in a gzip extra field (``sl``, as the WARC annex has it), so a
reader can leave a record after its first bytes.  Reading: files are planned into partitions
by size; a record's WARC header is parsed first, predicates on header columns are applied to
it, and the rest of a record that is not wanted is neither inflated nor, where it is long,
read.  Plain ``.warc`` files and foreign ``.warc.gz`` files can be read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.llm.bitmap import bitmap_of
from sievework.session import new_path, stage

SCHEMA = ("file string, record_type string, record_id string, refers_to string, date string, target_uri string, "
          "content_type string, content_length long, payload_digest string, payload_length long, "
          "headers map<string,string>, payload binary")
#: Header behind each column.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to",
           "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type",
           "content_length": "content-length", "payload_digest": "warc-payload-digest"}
#: Columns that a predicate can be pushed to: all but ``content_type``, which rows take from the
#: HTTP header inside the record, so only Spark can test it.
PUSHED = HEADERS.keys() - {"content_type"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed at this size; files of about this size are read by one task.
FILE_BYTES = 64 << 20
#: Bytes fetched at once; a skip beyond them is a seek.
WINDOW = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _record(row: dict) -> bytes:
    """One WARC record of an HTTP response or a revisit of one."""
    payload = row.get("payload") or b""
    full = row.get("payload_length")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\n"
            f"Content-Length: {len(payload) if full is None else full}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>",
            f"WARC-Date: {row.get('date') or '2024-01-01T00:00:00Z'}"]
    if row.get("target_uri"):
        head.append("WARC-Target-URI: " + quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~"))
    if row.get("payload_digest"):
        head.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain length in an ``sl`` extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head, tail = 10 + 2 + 12, 8
    total = head + len(body) + tail
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class _Committed(ds.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(ds.DataSourceArrowWriter):
    """Needs ``record_type``, ``record_id``, ``payload``; takes the other columns of the schema."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Committed:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    data = _member(_record(row))
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        files.append((name, size))
                        out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Committed(files)

    def commit(self, messages: list) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{folder}/_commit-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, folder = _store(self.path)
        for name, _ in [f for m in messages if m is not None for f in m.files]:
            store.delete_file(f"{folder}/{name}")


class _Files(ds.InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class _Buffered:
    """Bytes of a file at any offset, fetched a window at a time."""

    def __init__(self, handle):
        self.handle, self.size, self.at, self.data = handle, handle.size(), 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if offset < self.at or offset + n > self.at + len(self.data):
            self.at, self.data = offset, self.handle.read_at(max(n, WINDOW), offset)
        return self.data[offset - self.at:offset - self.at + n]


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Plain:
    """A record of an uncompressed file."""

    def __init__(self, file: _Buffered, offset: int):
        self.file, self.offset, self.pulled, self.n = file, offset, b"", 0
        head = self.until(b"\r\n\r\n", 0)
        self.headers, self.head = _headers(self.pulled[:head]), head + 4
        self.length = int(self.headers["content-length"])
        self.end = offset + self.head + self.length + 4

    def until(self, mark: bytes, start: int) -> int:
        while (at := self.pulled.find(mark, start)) < 0:
            more = self.file.get(self.offset + len(self.pulled), min(4096, self.file.size - self.offset - len(self.pulled)))
            if not more:
                raise ValueError("a record ends early")
            self.pulled += more
        return at

    def block(self) -> bytes:
        return self.file.get(self.offset + self.head, self.length)


class _Member:
    """A record of a compressed file: inflated only as far as it is asked for."""

    def __init__(self, file: _Buffered, offset: int):
        self.file, self.offset, self.pulled = file, offset, b""
        start = file.get(offset, min(24, file.size - offset))
        self.end = offset + struct.unpack_from("<I", start, 16)[0] if start[3] & 4 and start[12:14] == b"sl" else None
        self.inflate, self.fed = zlib.decompressobj(31), offset
        head = self.until(b"\r\n\r\n", 0)
        self.headers, self.head = _headers(self.pulled[:head]), head + 4
        self.length = int(self.headers["content-length"])

    def pull(self, n: int) -> bool:
        data = self.inflate.unconsumed_tail
        if not data and not self.inflate.eof:
            stop = min(self.file.size, self.fed + max(512, min(n, 1 << 16)))
            data = self.file.get(self.fed, stop - self.fed)
            self.fed = stop
        got = self.inflate.decompress(data, n) if data else b""
        self.pulled += got
        return bool(got) or bool(data)

    def until(self, mark: bytes, start: int) -> int:
        while (at := self.pulled.find(mark, start)) < 0:
            if not self.pull(1024):
                raise ValueError("a record ends early")
        return at

    def block(self) -> bytes:
        parts, have = [self.pulled[self.head:]], len(self.pulled) - self.head
        self.pulled = self.pulled[:self.head]
        while have < self.length and self.pull(1 << 20):
            more = self.pulled[self.head:]
            self.pulled = self.pulled[:self.head]
            parts.append(more)
            have += len(more)
        return b"".join(parts)[:self.length]

    def finish(self) -> int:
        """Where the next member starts, for files whose members do not say so."""
        if self.end is None:
            while not self.inflate.eof and self.pull(1 << 20):
                self.pulled = b""
            self.end = self.fed - len(self.inflate.unused_data)
        return self.end


#: How a predicate on a header column is applied; a missing header fails all but IsNull.
TESTS = {
    ds.EqualTo: lambda v, f: v == f.value, ds.In: lambda v, f: v in f.value,
    ds.GreaterThan: lambda v, f: v > f.value, ds.GreaterThanOrEqual: lambda v, f: v >= f.value,
    ds.LessThan: lambda v, f: v < f.value, ds.LessThanOrEqual: lambda v, f: v <= f.value,
    ds.StringStartsWith: lambda v, f: v.startswith(f.value), ds.StringEndsWith: lambda v, f: v.endswith(f.value),
    ds.StringContains: lambda v, f: f.value in v, ds.IsNotNull: lambda v, f: True}


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, columns: list[str], verify: bool, partition_bytes: int):
        self.path, self.columns, self.verify = path.rstrip("/"), columns, verify
        self.partition_bytes = partition_bytes
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if type(f) in TESTS and len(name) == 1 and name[0] in PUSHED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_Files([root])]
        found = store.get_file_info(pafs.FileSelector(root))
        commits = [f.path for f in found if f.base_name.startswith("_commit-")]
        if commits:
            sized = []
            for path in sorted(commits):
                with store.open_input_stream(path) as file:
                    sized += [(f"{root}/{n}", s) for n, s in json.loads(file.read())]
        else:
            sized = [(f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        plan: list[_Files] = []
        held, size = [], 0
        for path, n in sorted(sized):
            if held and size + n > self.partition_bytes:
                plan.append(_Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*plan, _Files(held)]

    def wanted(self, headers: dict[str, str]) -> bool:
        for f in self.filters:
            value = _value(f.attribute[0], headers)
            if value is None or not TESTS[type(f)](value, f):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.files:
            with store.open_input_file(path) as handle:
                file, offset = _Buffered(handle), 0
                packed = file.get(0, min(2, file.size)) == b"\x1f\x8b"
                while offset < file.size:
                    record = (_Member if packed else _Plain)(file, offset)
                    if self.wanted(record.headers):
                        yield self.row(path, record)
                    offset = record.finish() if packed else record.end

    def row(self, path: str, record) -> tuple:
        h = record.headers
        values = {c: _value(c, h) for c in HEADERS} | {"file": path, "headers": h}
        http = h.get("content-type", "").startswith("application/http")
        if self.verify or {"payload", "payload_length", "content_type"} & set(self.columns):
            block = record.block() if "payload" in self.columns or self.verify else None
            if http:
                at = record.until(b"\r\n\r\n", record.head) - record.head if block is None else block.index(b"\r\n\r\n")
                lines = (record.pulled[record.head:record.head + at] if block is None else block[:at]).decode("latin-1")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split("\r\n")[1:])}
                values["content_type"] = fields.get("content-type")
                revisit = h["warc-type"] == "revisit"
                full = int(fields.get("content-length", -1))
                values["payload_length"] = full if revisit and full >= 0 else record.length - at - 4
                if block is not None and not revisit:
                    values["payload"] = block[at + 4:]
            elif block is not None:
                values["payload"], values["payload_length"] = block, len(block)
            else:
                values["payload_length"] = record.length
            if self.verify and "payload" in values and (said := h.get("warc-payload-digest")):
                own = "sha1:" + base64.b32encode(hashlib.sha1(values["payload"]).digest()).decode()
                if own != said:
                    raise ValueError(f"payload of {h.get('warc-record-id')} in {path} does not match its digest")
        return tuple(values.get(c) for c in self.columns)


def _value(column: str, headers: dict[str, str]):
    value = headers.get(HEADERS[column])
    if value is not None and column == "content_length":
        return int(value)
    return value.strip("<>") if value and column in ("record_id", "refers_to") else value


class WarcDataSource(ds.DataSource):
    """Format ``warc``.  Options: ``path``; ``verify`` (check payload digests when reading);
    ``file_bytes`` and ``partition_bytes``.  Give a schema with fewer columns to read less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        verify = str(self.options.get("verify", "false")).lower() == "true"
        return WarcReader(self.options["path"], schema.names, verify,
                          int(self.options.get("partition_bytes", FILE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to; write to a new path instead")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32 (32 characters, no padding)."""
    digest, out = F.sha1(payload), []
    for k in range(8):  # five hex digits are four base32 digits
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567").substr(at, F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """Rows for the writer: of pages with equal payloads of at least ``min_bytes`` bytes, that
    with the largest id is a response and the others revisit it; other pages are responses.

    A null page is empty.  Null ids rank lowest.  Rows that share the largest id of their
    payload are all responses.  Other columns are ignored, whatever their names, payloads may
    have any length, and an empty table gives no rows.
    """
    payload = F.encode(F.coalesce(F.col(html_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("target_uri"),
                        payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.length("payload").cast("long"), "sha": F.sha1("payload")})
    facts = rows.filter(F.col("payload_length") >= min_bytes).groupBy("sha", "payload_length").agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    equal = stage(facts.filter("n > 1").select("sha", "keep"), "equal-payloads")
    marked = bitmap_of(equal, F.xxhash64("sha"), equal.count()).marked(rows, F.xxhash64("sha"), "hit")
    plain = marked.filter(~F.col("hit")).withColumn("keep", F.col("id"))
    met = marked.filter("hit").join(equal, "sha", "left")
    met = met.withColumn("keep", F.when(F.col("payload_length") >= min_bytes, F.coalesce("keep", "id")).otherwise(F.col("id")))
    both = plain.unionByName(met)
    revisit = ~F.col("id").eqNullSafe(F.col("keep"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"),
        F.when(revisit, name("keep")).alias("refers_to"), "target_uri", "payload_length",
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, **columns: str) -> str:
    """Write ``pages`` as WARC archives; returns the folder (one in the shared folder if not given)."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_path(spark, "warc")
    records(pages, min_bytes, **columns).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """Records of archives; ``columns`` is the schema to read, and no more is decoded than it needs."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify)).load(path)
