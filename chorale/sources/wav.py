"""``spark.read.format("wav")``: a folder of clips as a table, its stream of new clips, and a writer of a mirrored tree.

    wav.register(spark)
    clips = spark.read.format("wav").option("least", 0.1).option("most", 10).option("samples", "false").load("/corpus")
    waves.select("file_key", "samples", "sr").write.format("wav").mode("append").save("/processed")

Files are dealt to partitions by their bytes. The options ``prefix`` (of keys) and ``labels`` (with commas) choose
the files that are opened at all, ``least`` and ``most`` (seconds) and ``rate`` those whose samples are decoded;
without ``samples`` only headers are read. These are options and no pushed filters, since Spark 4.1 keeps a Python
reader with a table: a filter that one query pushes would hold for the next query of the same DataFrame. Folders are
reached through pyarrow's filesystems.
"""

from __future__ import annotations

import posixpath
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from chorale.sources.audio import decode_wav, encode_wav

FILE = "file_key string, label string, length bigint"
HEADER = "sample_rate int, channels int, duration double, frames bigint"
#: Bytes of clips for each partition.
PART_BYTES = 1 << 26
#: Bytes that are read for a header.
HEADER_BYTES = 1 << 12
ROWS = 64

@dataclass
class Clips(InputPartition):
    """(file_key, length) of clips that one task reads."""

    files: list[tuple[str, int]]


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def label_of(key: str) -> str:
    """Parent folder of a nested key, else the stem before its first underscore."""
    parts = key.split("/")
    return parts[-2] if len(parts) > 1 else parts[-1].rsplit(".", 1)[0].split("_")[0]


def listed(path: str) -> list[tuple[str, int, int]]:
    """(file_key, bytes, time of change) of all clips under a folder, by key; hidden folders are left out."""
    fs, base = _folder(path)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    keys = [(posixpath.relpath(f.path, base), f) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".wav")]
    return sorted((k, f.size, f.mtime_ns or 0) for k, f in keys if not any(p.startswith((".", "_")) for p in k.split("/")))


def by_bytes(files: list[tuple[str, int]], most: int) -> list[Clips]:
    """Partitions of about ``most`` bytes, largest clips first, each to the emptiest."""
    total = sum(n for _, n in files)
    parts: list[list[tuple[str, int]]] = [[] for _ in range(max(1, min(len(files), -(-total // most))))]
    room = [(0, k) for k in range(len(parts))]
    import heapq

    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        used, k = heapq.heappop(room)
        parts[k].append(f)
        heapq.heappush(room, (used + f[1], k))
    return [Clips(p) for p in parts]


class _Settings:
    def __init__(self, options: dict) -> None:
        number = lambda name, kind: kind(options[name]) if options.get(name) else None
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.labels = set(options["labels"].split(",")) if options.get("labels") else None
        self.least, self.most, self.rate, self.target = number("least", float), number("most", float), number("rate", int), number("target", int)
        self.samples = options.get("samples", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", PART_BYTES))
        self.strict = options.get("errors", "keep") == "fail"

    def opened(self, key: str) -> bool:
        return key.startswith(self.prefix) and (self.labels is None or label_of(key) in self.labels)

    def heard(self, row: dict) -> bool:
        """Whether the header is what is asked for."""
        return (self.least is None or row["duration"] >= self.least) and (self.most is None or row["duration"] <= self.most) and (self.rate is None or row["sample_rate"] == self.rate)


def read_clips(at: _Settings, part: Clips) -> Iterator[pa.RecordBatch]:
    """Rows of a partition. A bad clip has its fault in ``error``, or with errors = fail ends the read."""
    samples = at.samples
    fs, base = _folder(at.path)
    names = ["file_key", "label", "length", "sample_rate", "channels", "duration", "frames", *(["samples"] if samples else []), "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), *([pa.list_(pa.float32())] if samples else []), pa.string()]
    rows: list[list] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    for key, length in part.files:
        row = {"file_key": key, "label": label_of(key), "length": length, "sample_rate": None, "channels": None, "duration": None, "frames": None}
        wave_, error = None, None
        try:
            with fs.open_input_file(posixpath.join(base, key)) as f, pa.BufferReader(f.read(HEADER_BYTES)) as head:
                try:
                    row |= _header(head)
                except (wave.Error, EOFError):  # the header may be longer
                    f.seek(0)
                    row |= _header(f)
                if samples and at.heard(row):
                    f.seek(0)
                    wave_ = decode_wav(f.read(), at.target)[0].astype("float32")
        except (wave.Error, EOFError, ValueError, OSError, KeyError) as e:
            if at.strict:
                raise
            error = f"{type(e).__name__}: {e}"[:500]
        if error or at.heard(row):
            rows.append([*row.values(), *([wave_] if samples else []), error])
        if len(rows) >= ROWS:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def _header(f) -> dict:
    with wave.open(f) as w:
        return {"sample_rate": w.getframerate(), "channels": w.getnchannels(), "duration": w.getnframes() / w.getframerate(), "frames": w.getnframes()}


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.at = _Settings(options)

    def partitions(self) -> list[InputPartition]:
        return by_bytes([(k, n) for k, n, _ in listed(self.at.path) if self.at.opened(k)], self.at.bytes)

    def read(self, partition: Clips) -> Iterator[pa.RecordBatch]:
        return read_clips(self.at, partition)


class WavStream(DataSourceStreamReader):
    """New clips in the order in which they came; an offset is the time of change and key of the last one."""

    def __init__(self, options: dict) -> None:
        self.at = _Settings(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "key": ""}

    def latestOffset(self) -> dict:
        time, key = max(((t, k) for k, _, t in listed(self.at.path)), default=(-1, ""))
        return {"time": time, "key": key}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["time"], o["key"]) for o in (start, end))
        return by_bytes([(k, n) for k, n, t in listed(self.at.path) if low < (t, k) <= high and self.at.opened(k)], self.at.bytes)

    def read(self, partition: Clips) -> Iterator[pa.RecordBatch]:
        return read_clips(self.at, partition)


@dataclass
class Written(WriterCommitMessage):
    """(place of the attempt, place in the tree) of the clips of a task."""

    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    """Rows (file_key, samples, sr) as PCM files in a tree like the keys. A task writes under a name of its own; only
    the commit of the whole job moves files to their places, and what failed is deleted.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.folder = options["path"], f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, base = _folder(self.path)
        attempt, done = posixpath.join(base, self.folder, uuid.uuid4().hex), []
        fs.create_dir(attempt, recursive=True)
        try:
            for row in iterator:
                at = posixpath.join(attempt, f"{len(done)}.wav")
                with fs.open_output_stream(at) as f:
                    f.write(encode_wav(_samples(row["samples"]), row["sr"]))
                target = posixpath.normpath(posixpath.join(base, row["file_key"]))
                if not target.startswith(base.rstrip("/") + "/"):
                    raise ValueError(f"a key outside the folder: {row['file_key']}")
                done.append((at, target))
        except BaseException:
            fs.delete_dir(attempt)
            raise
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, base = _folder(self.path)
        for at, target in (x for m in messages if m is not None for x in m.files):
            fs.create_dir(posixpath.dirname(target), recursive=True)
            fs.move(at, target)
        self._clear(fs, base)

    def abort(self, messages: list) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        place = posixpath.join(base, self.folder)
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            fs.delete_dir(place)


def _samples(values):
    import numpy as np

    return np.asarray(values, float)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        samples = self.options.get("samples", "true").lower() == "true"
        return ", ".join([FILE, HEADER, *(["samples array<float>"] if samples else []), "error string"])

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))

    def streamReader(self, schema) -> WavStream:
        return WavStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(WavSource)
