"""WARC files as a Python data source, to read and to write.

``spark.read.format("warc").load(folder)`` plans one partition per large file
and bins small files together. Filters on the columns that come from record
headers are pushed into the reader, which parses a record's headers first and
decodes its payload only where the record passes and the payload is wanted
(option ``payload``: comma-separated record types, ``all`` or ``none``). The
compressed length of each gzip member stands in its extra field (the ``sl``
field of the format's annex), so the rest of an unwanted record is skipped
without being inflated; members without it, and plain files, are read too.

``df.write.format("warc").save(folder)`` writes files of gzip members. A task
writes files of its own under ``_temporary`` in the folder; the driver moves
those of the committed attempts to their place, so lost and repeated tasks
leave nothing behind."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)

from ..session import scratch_path
from .common import stage_table

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "refers_to string, http_length bigint, content_length bigint, payload binary")
ARROW_SCHEMA = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
                          for name, kind in (field.split(" ") for field in SCHEMA.split(", "))])
HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "http_length",
                  "content_length"}
PARTITION_BYTES = 64 << 20  # files are binned up to this size
FILE_BYTES = 256 << 20      # the writer starts a new file beyond this size
BATCH_BYTES = 4 << 20       # payload bytes in one batch of rows
_READ = 8192        # bytes inflated at once
_BUFFER = 1 << 16   # bytes read from a file at once
DATE = "2000-01-01T00:00:00Z"  # records carry no clock time, so a repeated task writes the same bytes


def open_fs(path: str):
    """File system and path of a URI, or of a local path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(row: dict) -> bytes:
    """One record, as an HTTP response (or the headers of one, for a revisit)."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>",
            f"WARC-Date: {row['date'] or DATE}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["payload_digest"] is not None:
        head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{row['refers_to']}>")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """``data`` as a gzip member whose extra field tells its length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def parse_headers(head: bytes) -> dict[str, str]:
    """Fields of a header block by lower-cased name; the first line is left out."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


class _Inflated:
    """Reads one gzip member piece by piece; keeps what follows it."""

    def __init__(self, source, first: bytes):
        self.source, self.z, self.rest = source, zlib.decompressobj(31), first
        self.out = b""

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes, fewer only at the end of the member."""
        parts, have = [self.out[:n]], min(n, len(self.out))
        self.out = self.out[n:]
        while have < n and not self.z.eof:
            data = self.z.unconsumed_tail or self.rest or self.source.read(_READ)
            if not self.z.unconsumed_tail:
                self.rest = b""
            if not data:
                break
            got = self.z.decompress(data, max(_READ, n - have))
            parts.append(got[:n - have])
            self.out = got[n - have:]
            have += len(parts[-1])
        return b"".join(parts)

    def finish(self) -> bytes:
        """Read on to the member's end; what followed it in the source."""
        while not self.z.eof and self.read(1 << 20):
            pass
        return self.z.unused_data


MOST_HEADERS = 16 << 20  # bytes of a header block; a longer one is an error


def _until_blank_line(stream, most: int = MOST_HEADERS, skip: bytes = b"") -> tuple[int, bytes | None, bytes]:
    """Bytes of ``skip`` before a header block, the block, and the bytes read
    beyond it; no block and all bytes, if the stream ends before a blank line."""
    data, skipped, seen = bytearray(), 0, 0
    while (at := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(data)
        if seen > most:
            raise ValueError(f"a header block of more than {most} bytes")
        more = stream.read(4096)
        if not more:
            return skipped, None, bytes(data)
        if not data:
            rest = more.lstrip(skip) if skip else more
            skipped += len(more) - len(rest)
            more = rest
        data += more
    return skipped, bytes(data[:at]), bytes(data[at + 4:])


class _Joined:
    """Bytes already read, then the stream."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def read(self, n: int) -> bytes:
        if self.first:
            out, self.first = self.first[:n], self.first[n:]
            return out + (self.stream.read(n - len(out)) if len(out) < n else b"")
        return self.stream.read(n)


class _Limited:
    """At most ``left`` bytes of a stream."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        out = self.stream.read(min(n, self.left))
        self.left -= len(out)
        return out


def records(file, wanted, passes):
    """Rows of a file's records that ``passes(row)``; payloads where ``wanted(row)``."""
    at, size = 0, file.seek(0, 2)
    while at < size:
        file.seek(at)
        start = file.read(24)
        packed = start[:2] == b"\x1f\x8b"
        known = None
        if packed and len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
            known = struct.unpack("<I", start[16:20])[0] or None
        member = _Inflated(file, start) if packed else _Joined(start, file)
        skipped, head, over = _until_blank_line(member, skip=b"\r\n")
        if head is None and not over:  # an empty member, or blank lines at the end of a file
            at = size if not packed else at + known if known else file.tell() - len(member.finish())
            continue
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        offset = at + skipped + len(head) + 4
        h = parse_headers(head)
        length = int(h.get("content-length", 0))
        strip = lambda v: v[1:-1] if v and v[:1] == "<" and v[-1:] == ">" else v
        row = {"record_id": strip(h.get("warc-record-id")), "record_type": h.get("warc-type"),
               "target_uri": strip(h.get("warc-target-uri")), "date": h.get("warc-date"),
               "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
               "refers_to": strip(h.get("warc-refers-to")), "http_length": None, "content_length": length, "payload": None}
        body = _Joined(over, member)
        http = h.get("content-type", "").startswith("application/http")
        left = length
        if http:
            body = _Limited(body, length)
            _, front, over = _until_blank_line(body)
            if front is not None:  # else the block has no HTTP headers: all of it is payload
                value = parse_headers(front).get("content-length", "")
                row["http_length"] = int(value) if value.isdigit() else None
                left = length - len(front) - 4
            body = _Joined(over, body)
        if passes(row):
            if wanted(row):
                row["payload"] = body.read(max(0, left))
            yield row
        if not packed:
            at = offset + length
        elif known:
            at += known
        else:
            unused = member.finish()
            at = file.tell() - len(unused)


# --- the data source --------------------------------------------------------------

@dataclass
class FileGroup(InputPartition):
    paths: list[str]

    def __init__(self, paths):
        self.paths = paths


def _test(f: Filter):
    """A filter on header columns as a function of a row, or None."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # SQL: not of unknown is unknown, so a null fails both
        return inner and (lambda r: (x := inner(r)) is not None and not x)
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in HEADER_COLUMNS:
        return None
    v = getattr(f, "value", None)
    known = lambda g: lambda r: None if r[column] is None or v is None else g(r[column])
    tests = {EqualTo: known(lambda x: x == v), EqualNullSafe: lambda r: r[column] == v,
             GreaterThan: known(lambda x: x > v), GreaterThanOrEqual: known(lambda x: x >= v),
             LessThan: known(lambda x: x < v), LessThanOrEqual: known(lambda x: x <= v),
             In: known(lambda x: x in v), IsNull: lambda r: r[column] is None, IsNotNull: lambda r: r[column] is not None,
             StringStartsWith: known(lambda x: x.startswith(v)), StringEndsWith: known(lambda x: x.endswith(v)),
             StringContains: known(lambda x: v in x)}
    return tests.get(type(f))


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tests = options["path"], []
        self.payload = options.get("payload", "all")
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(f)

    def partitions(self):
        store, path = open_fs(self.path)
        found = store.get_file_info(pafs.FileSelector(path, recursive=True)) \
            if store.get_file_info(path).type == pafs.FileType.Directory else [store.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File
                       and not any(p[:1] in "_." for p in f.path[len(path):].split("/") if p)
                       and f.path.endswith((".warc", ".warc.gz")))
        groups, size = [], 0
        for name, n in files:
            if not groups or size + n > self.target:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [FileGroup(g) for g in groups] or [FileGroup([])]

    def read(self, partition):
        store, _ = open_fs(self.path)
        tests = [_test(f) for f in self.tests]
        passes = lambda r: all(t(r) for t in tests)
        types = {t.strip() for t in self.payload.split(",")}
        wanted = lambda r: "all" in types or r["record_type"] in types
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw, io.BufferedReader(raw, _BUFFER) as f:
                for row in records(f, wanted, passes):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        store, path = open_fs(self.path)
        task = TaskContext.get()
        folder = f"{path}/_temporary/{self.job}/{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{len(files):03d}-{self.job[:8]}.warc.gz"
                    files.append((f"{folder}/{name}", f"{path}/{name}"))
                    out, size = store.open_output_stream(files[-1][0], compression=None), 0
                data = gzip_member(record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            for temporary, final in m.files if m else []:
                store.move(temporary, final)
        self._clean(store, path)

    def abort(self, messages):
        self._clean(*open_fs(self.path))

    def _clean(self, store, path):
        folder = f"{path}/_temporary/{self.job}"
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- an archive of pages ------------------------------------------------------------

def base32(hexed: Column) -> Column:
    """Base 32 (A-Z and 2-7) of 40 hexadecimal digits, ten at a time."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages: of equal payloads the page of smallest id is a
    response, the others revisit it.

    The first page of each payload comes from a pre-aggregated table of
    digests, which is written before it is joined: a payload that very many
    pages share is then a skewed join key that adaptive execution splits."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
                     payload.cast("binary").alias("payload"), F.sha1(payload.cast("binary")).alias("hex"))
    first = stage_table(p.groupBy("hex").agg(F.min("page_id").alias("first_id")), "payloads")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    # a page that is repeated under the first id, or has none, is a response as well
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    return p.join(first, "hex").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(DATE).alias("date"),
        base32(F.col("hex")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"), F.octet_length("payload").cast("long").alias("http_length"),
        F.lit(None).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write the pages as WARC files; the folder. Without ``path`` a new one
    in the shared checkpoint folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}")
    page_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: str = "response") -> DataFrame:
    """Per page: ``page_id, target_uri, payload_bytes, payload_digest,
    record_type, refers_to`` and, for responses, ``payload`` and ``intact``
    (whether length and digest hold for the payload as it was read).

    Null html is an empty payload, and empty payloads revisit each other as
    others do. A null id makes a response that nothing refers to, unless all
    pages of its payload lack an id. Repeated pages come back, each a
    response if it has the smallest id. An empty table gives no records."""
    register(spark)
    r = spark.read.format("warc").option("payload", payload).load(path)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return r.select(number("record_id").alias("page_id"), "target_uri", F.col("http_length").alias("payload_bytes"),
                    "payload_digest", "record_type", number("refers_to").alias("refers_to"), "payload",
                    ((base32(F.sha1("payload")) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("http_length"))).alias("intact"))
