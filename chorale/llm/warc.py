"""WARC archives: one gzip member for each record, written by tasks and read back by byte ranges.

A reading task is given a byte range. It scans it for gzip magic, takes a candidate for a member only if
its first bytes decode to WARC headers, its whole stream decodes with a right checksum and its block has the
length that the headers say; it owns the records that start inside its range, wherever they end. What
follows a record does not matter, so a damaged one costs none of its neighbours. A range may begin inside a
record that itself holds whole records; those are told by the record around them, which reaches over the
range's start, and left out. Members are decoded in steps of bounded size. Files are reached through
pyarrow's filesystems, so ranges of local, HDFS and object-store files are read without the rest of the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.shared import bounded, new_path, table

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "path string, offset long, end long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """An uncompressed response record, or a revisit record of headers only if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    clean = re.sub(r"[\r\n]+", " ", uri)
    head = ["WARC/1.1", f"WARC-Type: {REVISIT if refers_to else RESPONSE}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(records: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 28) -> DataFrame:
    """Write records (record_id, target_uri, payload, refers_to) as ``*.warc.gz`` and list the files.

    Returns (path, length, records) of the files that belong to the archive: those of successful tasks, so
    that retried or duplicated attempts do no harm. A null payload is empty, a null uri is empty, a
    record with ``refers_to`` becomes a revisit. An empty table gives an archive without files.
    """
    path = path or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        filesystem, root = pafs.FileSystem.from_uri(path)
        filesystem.create_dir(root, recursive=True)
        files, out, size, count = [], None, 0, 0
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(*[batch.column(i) for i in range(4)], strict=True):
                body = payload.as_py() or b""
                member = gzip_member(record_bytes(record_id.as_py(), uri.as_py() or "", body, base32_sha1(body), refers_to.as_py(), date))
                if out is not None and size + len(member) > file_bytes:
                    out.close()
                    files[-1][1:] = [size, count]
                    out = None
                if out is None:
                    name = f"{stem}-{len(files)}.warc.gz"
                    out, size, count = filesystem.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    files.append([f"{path}/{name}", 0, 0])
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            files[-1][1:] = [size, count]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["path", "length", "records"])

    slim = records.select(F.col("record_id").cast("string"), F.col("target_uri").cast("string"), F.col("payload").cast("binary"), F.col("refers_to").cast("string"))
    return table(slim.mapInArrow(run, "path string, length long, records long"), "warc-files")


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives under ``path``, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")


class _Window:
    """Random access to a file in steps; keeps the bytes from ``at`` on."""

    def __init__(self, file: pa.NativeFile, length: int) -> None:
        self.file, self.length = file, length
        self.at, self.data = 0, b""

    def read(self, start: int, n: int) -> bytes:
        n = min(n, self.length - start)
        if n <= 0:
            return b""
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.file.seek(start)
            self.data, self.at = self.file.read(min(max(n, 16 * STEP), self.length - start)), start
        return self.data[start - self.at : start - self.at + n]


def _begins_record(window: _Window, at: int) -> bool:
    """Whether the bytes at ``at`` decode to the start of a WARC record, however long the gzip header is."""
    if window.read(at, 3) != MAGIC:
        return False
    unpacker, out, fed = zlib.decompressobj(31), b"", 512
    try:
        while len(out) < 5 and not unpacker.eof:
            data = window.read(at, fed)
            if not data:
                return False
            out += unpacker.decompress(unpacker.unconsumed_tail + data, 64)
            at, fed = at + len(data), STEP
    except zlib.error:
        return False
    return out.startswith(b"WARC/")


def _inflate(window: _Window, at: int) -> Iterator[tuple[bytes, int]]:
    """The decoded bytes of the member at ``at`` in steps, each with the place where the member ends, -1 until that is known; ValueError if it is cut off."""
    unpacker = zlib.decompressobj(31)
    while not unpacker.eof:
        fed = window.read(at, STEP)
        if not fed:
            raise ValueError("the file ends inside a member")
        at += len(fed)
        while True:
            out = unpacker.decompress(fed, 16 * STEP)
            yield out, at - len(unpacker.unused_data) if unpacker.eof else -1
            fed = unpacker.unconsumed_tail
            if unpacker.eof or not fed and len(out) < 16 * STEP:
                break


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Head:
    """Collects bytes up to an empty line; ``rest`` is what came after it."""

    def __init__(self) -> None:
        self.data, self.rest, self.done = bytearray(), b"", False

    def feed(self, data: bytes) -> None:
        seen = max(0, len(self.data) - 3)
        self.data += data
        at = self.data.find(b"\r\n\r\n", seen)
        if at >= 0:
            self.rest, self.done = bytes(self.data[at + 4 :]), True
            del self.data[at:]


@dataclass
class Record:
    """A valid record: its headers, where it ends, and the size, digest and (if asked for) bytes of its payload."""

    headers: dict[str, str]
    end: int
    http: bytes
    size: int
    digest: str
    payload: bytes | None


def read_member(window: _Window, at: int, with_payload: bool = True) -> Record | None:
    """The record at ``at``; None if there is no whole valid member. Without the payload a record of any size takes bounded memory."""
    if not _begins_record(window, at):
        return None
    head, http, sha, kept, size, left, tail, end = _Head(), _Head(), hashlib.sha1(), [], 0, None, b"", -1
    headers: dict[str, str] = {}
    try:
        for data, end in _inflate(window, at):
            if not head.done:
                head.feed(data)
                if not head.done:
                    continue
                headers, data = parse_headers(bytes(head.data)), head.rest
                if not headers.get("content-length", "").isdigit():
                    return None
                left = int(headers["content-length"])
                http.done = not headers.get("content-type", "application/http").startswith("application/http")
            block, after = data[:left], data[left:]
            left, tail = left - len(block), tail + after
            if len(tail) > 4:
                return None
            if not http.done:
                http.feed(block)
                block = http.rest if http.done else b""
            sha.update(block)
            size += len(block)
            if with_payload:
                kept.append(block)
    except (zlib.error, ValueError):
        return None
    if left != 0 or tail != b"\r\n\r\n":
        return None
    return Record(headers, end, bytes(http.data), size, base64.b32encode(sha.digest()).decode(), b"".join(kept) if with_payload else None)


def scan_range(window: _Window, start: int, stop: int, with_payload: bool = True) -> Iterator[tuple[int, Record]]:
    """The records that begin in [start, stop)."""
    at = start
    while at < stop:
        got = read_member(window, at, with_payload)
        if got:
            yield at, got
            at = got.end
            continue
        at += 1
        while at < stop:
            found = window.read(at, STEP).find(MAGIC)
            if found >= 0:
                at += found
                break
            at += STEP - len(MAGIC) + 1


def _row(path: str, at: int, record: Record) -> tuple:
    """Columns of RECORD; length and digest are taken from the payload itself, of a revisit from its headers."""
    headers = record.headers
    kind, size, digest = headers.get("warc-type", ""), record.size, record.digest
    if kind == REVISIT:
        length = re.search(rb"(?im)^content-length:\s*(\d+)", record.http)
        size, digest = int(length[1]) if length else 0, headers.get("warc-payload-digest", "").removeprefix("sha1:")
    return (path, at, record.end, headers.get("warc-record-id", "").strip("<>"), kind, headers.get("warc-target-uri", ""), headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, digest, size, record.payload)


SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records at known places (path, length, offset)."""

    def rows() -> Iterator[tuple]:
        name, file = None, None
        for batch in batches:
            for path, length, at in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if path != name:
                    filesystem, inside = pafs.FileSystem.from_uri(path)
                    name, file = path, filesystem.open_input_file(inside)
                    window = _Window(file, length)
                yield _row(path, at, read_member(window, at))

    yield from _batches(rows())


def read_warc(files: DataFrame, split_bytes: int = 1 << 25, with_payload: bool = True) -> DataFrame:
    """All records of ``files`` (path, length), see RECORD; bytes that belong to no valid record are passed over.

    Records inside the payload of a valid record are not records of the file. Records of any length are
    read; only with payloads does a task hold a whole one. No files, or empty ones, give an empty result.
    """
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = table(ranges.where("length > 0"), "ranges")
    tasks = max(1, min(ranges.count(), 100_000))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, length, start in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    filesystem, name = pafs.FileSystem.from_uri(path)
                    with filesystem.open_input_file(name) as file:
                        for at, record in scan_range(_Window(file, length), start, min(start + split_bytes, length), with_payload=False):
                            yield _row(path, at, record)

        yield from _batches(rows())

    found = table(ranges.repartition(tasks, "path", "start").mapInArrow(scan, RECORD), "warc-records")
    part = F.floor(F.col("offset") / split_bytes)
    over = found.where(F.floor((F.col("end") - 1) / split_bytes) > part)  # a record at most for each range
    covers = over.select("path", F.col("offset").alias("o"), F.col("end").alias("e"), F.explode(F.sequence(part + 1, F.floor((F.col("end") - 1) / split_bytes))).alias("part"))
    covers = bounded(table(covers, "covers"))
    numbered = found.withColumn("part", part)
    inner = (numbered["path"] == covers["path"]) & (numbered["part"] == covers["part"]) & (numbered["offset"] > F.col("o")) & (numbered["offset"] < F.col("e"))
    own = numbered.join(covers, inner, "left_anti").drop("part")
    if not with_payload:
        return own
    places = own.join(files.select("path", "length"), "path").select("path", "length", "offset", part.alias("part"))
    return places.repartition(tasks, "path", "part").sortWithinPartitions("path", "offset").select("path", "length", "offset").mapInArrow(_fetch, RECORD)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` (id, uri, payload) with first_id: the smallest id with an equal payload, null for that row itself.

    Payloads are equal if SHA-256 and length are. Rows that repeat the first row's id have null too. Only the keys of repeated payloads are joined back, so unique pages cost one probe.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.withColumns({"_key": F.sha2(body, 256), "_long": F.octet_length(body) >= min_bytes})
    groups = keyed.where("_long").groupBy("_key").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))).alias("first"), F.count("*").alias("n"))
    repeated = table(groups.where("n > 1").select("_key", F.col("first.id").alias("first_id")), "payloads")
    return keyed.join(bounded(repeated), "_key", "left").withColumn("first_id", F.when(F.col("_long") & ~F.col("first_id").eqNullSafe(F.col(id_col)), F.col("first_id"))).drop("_key", "_long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, split_bytes: int = 1 << 25) -> DataFrame:
    """Write a record for each page and read the archives back: id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload and null urls are empty. Pages with null id are recorded as such; they
    come after all others when the response of equal payloads is chosen. Rows that repeat the id of a
    response are responses themselves. An empty table gives an empty result.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), F.col(html_col).alias("body"))
    kind = dict(slim.dtypes)["id"]
    # no id has the second form: a colon in one is escaped
    urn = lambda c: F.when(c.isNull(), F.lit("urn:page::null")).otherwise(F.concat(F.lit("urn:page:"), F.url_encode(c.cast("string"))))
    records = with_revisits(slim, "id", "body", min_bytes).select(urn(F.col("id")).alias("record_id"), F.col("uri").alias("target_uri"), F.col("body").cast("binary").alias("payload"), F.when(F.col("first_id").isNotNull(), urn(F.col("first_id"))).alias("refers_to"))
    files = write_warc(records)
    back = table(read_warc(files, split_bytes, with_payload=False), "warc-pages")
    written, found = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], back.count()
    if written != found:
        raise ValueError(f"{written} records were written and {found} read back")
    ident = lambda c: F.when(F.col(c) != "urn:page::null", F.url_decode(F.substring(c, 10, 1 << 30)).cast(kind))
    return back.select(ident("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))
