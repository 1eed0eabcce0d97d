"""Clips: scanning folders, probing and decoding WAV bytes, features from waveforms.

Everything Python runs in ``mapInArrow`` over the clips of a partition and reports a failure in ``error``
beside null values, so a bad clip never fails a job.
"""

from __future__ import annotations

import io
import warnings
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import dsp
from chorale.functions.labels import call_type, label_from_path, prefix, stem

HEADER = "struct<sample_rate:int,channels:int,duration:double,frames:bigint,format:string,subtype:string>"
_SUBTYPES = {1: "PCM_U8", 2: "PCM_16", 3: "PCM_24", 4: "PCM_32"}


def scan(spark: SparkSession, root: str, pattern: str = "*.wav", content: bool = True) -> DataFrame:
    """(file_key, label, path, length, content) of the files under ``root``; without ``content`` none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    key = F.substring(F.col("path"), F.instr("path", base) + F.lit(len(base)), F.length("path"))
    return files.select(key.alias("file_key"), "path", "length", *(["content"] if content else [])).withColumn("label", label_from_path(F.col("file_key")))


#: Where a corpus has its labels: in the folder of a clip, or before the first underscore of its name, which then ends in the kind of call.
LAYOUTS = ("folder", "name")


def labelled(files: DataFrame, layout: str) -> DataFrame:
    """``files`` with label and call_type (null unless names tell it) by the layout of their corpus."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    name = stem(F.col("file_key"))
    if layout == "folder":
        return files.withColumns({"label": label_from_path(F.col("file_key")), "call_type": F.lit(None).cast("string")})
    return files.withColumns({"label": prefix(name), "call_type": call_type(name)})


def header_kinds(clips: DataFrame, *keys: str) -> DataFrame:
    """(keys, sample_rates, channels, n_files) of clips with header: what rates and channels a corpus has, in order."""
    distinct = lambda c: F.array_sort(F.collect_set(f"header.{c}")).alias(f"{c}s")
    return clips.where("header IS NOT NULL").groupBy(*keys).agg(distinct("sample_rate"), distinct("channels").alias("channels"), F.count("*").alias("n_files"))


def scan_corpora(spark: SparkSession, roots: dict[str, str], layouts: dict[str, str] | None = None, **options) -> DataFrame | None:
    """:func:`scan` of several corpora with a column dataset, each :func:`labelled` by its layout (folder by default); a folder that is not there is told by a warning and skipped, None if all are missing."""
    out = None
    for dataset, root in roots.items():
        try:
            files = labelled(scan(spark, root, **options), (layouts or {}).get(dataset, "folder")).withColumn("dataset", F.lit(dataset))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"{dataset}: no folder {root}", stacklevel=2)
            continue
        out = files if out is None else out.unionByName(files)
    return out


def parse_header(data: bytes) -> dict:
    with wave.open(io.BytesIO(data)) as w:
        return {"sample_rate": w.getframerate(), "channels": w.getnchannels(), "duration": w.getnframes() / w.getframerate(), "frames": w.getnframes(), "format": "WAV", "subtype": _SUBTYPES[w.getsampwidth()]}


def decode_wav(data: bytes, target: int | None = 16000) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1], resampled to ``target``; ValueError for anything else than PCM."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            sr, channels, size, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not a PCM WAV file: {e}") from e
    if size == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((wide[:, 0] | wide[:, 1] << 8 | wide[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[size]).astype(np.float64) - (128 if size == 1 else 0)
    x = np.asarray(x, float).reshape(-1, channels).mean(1) / float(1 << (8 * size - 1))
    return (dsp.resample(x, sr, target), target) if target and target != sr else (x, sr)


def encode_wav(x: np.ndarray, sr: int) -> bytes:
    """PCM_16 bytes of mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def frames_array(values: list[np.ndarray | None]) -> pa.Array:
    """``array<array<float>>`` of (frames, width) matrices, without going through Python lists."""
    known = [v for v in values if v is not None]
    flat = np.concatenate([np.zeros(0, np.float32), *[v.ravel().astype(np.float32) for v in known]])
    rows = np.concatenate([np.zeros(1, np.int32), *[np.full(len(v), v.shape[1], np.int32) for v in known]]).cumsum(dtype=np.int32)
    inner = pa.ListArray.from_arrays(pa.array(rows), pa.array(flat))
    clips = np.array([0, *[0 if v is None else len(v) for v in values]]).cumsum(dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(clips), inner, mask=pa.array([v is None for v in values]))


def _value(v: pa.Scalar) -> object:
    """Lists of numbers as numpy arrays, other values as Python's."""
    return v.values.to_numpy(zero_copy_only=False) if v.is_valid and isinstance(v, pa.ListScalar) else v.as_py()


def _each(df: DataFrame, column: str, f: Callable, out: str, kind: str, arrow: pa.DataType | Callable[[list], pa.Array], step: int = 32) -> DataFrame:
    """Adds ``out`` = f(value, row) and error; the other columns pass through. ``arrow`` is the type of ``out`` or makes its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values, errors = [], []
                for i, v in enumerate(part.column(column)):
                    try:
                        values.append(f(_value(v), part.slice(i, 1)))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - a clip's fault is its result
                        values.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
                keep = [n for n in part.schema.names if n not in (out, "error")]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], arrow(values) if callable(arrow) else pa.array(values, arrow), pa.array(errors, pa.string())], names=[*keep, out, "error"])

    keep = [f"`{n}` {t}" for n, t in df.dtypes if n not in (out, "error")]
    return df.mapInArrow(run, ", ".join([*keep, f"{out} {kind}", "error string"]))


def headers(clips: DataFrame) -> DataFrame:
    """Adds header; samples are not decoded."""
    kind = pa.struct([("sample_rate", pa.int32()), ("channels", pa.int32()), ("duration", pa.float64()), ("frames", pa.int64()), ("format", pa.string()), ("subtype", pa.string())])
    return _each(clips, "content", lambda data, _: parse_header(data), "header", HEADER, kind)


def waveforms(clips: DataFrame, target: int = 16000, least: float | None = 0.1, most: float | None = 10.0, trim: bool = False, peak: bool = True) -> DataFrame:
    """Check the duration by the header, decode, trim and normalise; adds samples and sr, without content.

    ``error`` tells bad files and durations out of range apart.
    """

    def one(data: bytes, _) -> list[float]:
        try:
            seconds = parse_header(data)["duration"]
        except (wave.Error, EOFError, KeyError) as e:
            raise ValueError(f"not a PCM WAV file: {e}") from e
        if least is not None and seconds < least or most is not None and seconds > most:
            raise ValueError(f"duration {seconds:.4f} s is out of range")
        x, sr = decode_wav(data, target)
        x = dsp.trim_silence(x) if trim else x
        top = np.abs(x).max(initial=0)
        return (x / top if peak and top > 0 else x).astype(np.float32)

    return _each(clips, "content", one, "samples", "array<float>", pa.list_(pa.float32())).drop("content").withColumn("sr", F.lit(target))


#: Extractors from (samples, sr) to frames; prosody is one frame of statistics.
_extractors: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "mfcc": dsp.mfcc_frames,
    "spectral": dsp.spectral_frames,
    "prosodic": lambda x, sr: dsp.prosody(x, sr)[None, :],
}


def register_extractor(name: str, f: Callable[[np.ndarray, int], np.ndarray]) -> None:
    _extractors[name] = f


def extract(waves: DataFrame, kind: str) -> DataFrame:
    """Adds frames ``array<array<float>>`` of a registered extractor; ValueError for an unknown one."""
    if kind not in _extractors:
        raise ValueError(f"unknown features: {kind}")
    f = _extractors[kind]
    one = lambda x, row: f(np.asarray(x, float), row.column("sr")[0].as_py())
    return _each(waves, "samples", one, "frames", "array<array<float>>", frames_array).drop("samples")


def extract_many(waves: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(…, kind, frames, error): the frames of several extractors from one pass over the waveforms, a row for each clip and kind."""
    for kind in kinds:
        if kind not in _extractors:
            raise ValueError(f"unknown features: {kind}")
    chosen = {k: _extractors[k] for k in kinds}
    keep = [c for c in waves.columns if c not in ("samples", "kind", "frames", "error")]
    kinds_of = dict(waves.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            for name, f in chosen.items():
                values, errors = [], []
                for v, sr in zip(part.column("samples"), part.column("sr"), strict=True):
                    try:
                        values.append(f(np.asarray(_value(v), float), sr.as_py()))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - a clip's fault is its result
                        values.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([name] * len(values)), frames_array(values), pa.array(errors, pa.string())], names=[*keep, "kind", "frames", "error"])

    return waves.mapInArrow(run, ", ".join([*[f"`{c}` {kinds_of[c]}" for c in keep], "kind string, frames array<array<float>>, error string"]))


class Encoder(Protocol):
    """A frozen encoder: every layer's (frames, width) of one clip, the input of the first layer as layer 0."""

    def encode(self, samples: np.ndarray, sr: int) -> dict[int, np.ndarray]: ...


class RandomProjectionEncoder:
    """A seeded stand-in for tests, not a speech model: each layer mixes the layer before at random."""

    def __init__(self, layers: int = 4, width: int = 32, frame: int = 400, hop: int = 320, seed: int = 42) -> None:
        self.frame, self.hop = frame, hop
        rng = np.random.default_rng(seed)
        self.first = rng.normal(size=(frame, width)) / np.sqrt(frame)
        self.mixes = [rng.normal(size=(width, width)) / np.sqrt(width) for _ in range(layers)]

    def encode(self, samples: np.ndarray, sr: int) -> dict[int, np.ndarray]:
        state = np.tanh(dsp.frames(samples, self.frame, self.hop, centred=False) @ self.first)
        out = {0: state}
        for k, mix in enumerate(self.mixes, 1):
            state = np.tanh(state @ mix)
            out[k] = state
        return out


def encode(waves: DataFrame, encoder: Encoder, layers: list[int] | None = None) -> DataFrame:
    """(…, layer, frames, error): a row per clip and layer; layers out of range are left out.

    The encoder is built once and reused by every worker; clips that fail keep one row with ``error``.
    """

    def one(x: np.ndarray, row: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
        found = encoder.encode(np.asarray(x, float), row.column("sr")[0].as_py())
        return [(k, v) for k, v in sorted(found.items()) if layers is None or k in layers]

    def kind(values: list) -> pa.Array:
        flat = [x for v in values for x in v or ()]
        each = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int32()), frames_array([v for _, v in flat])], names=["layer", "frames"])
        return pa.ListArray.from_arrays(pa.array(np.array([0, *[len(v or ()) for v in values]]).cumsum(dtype=np.int32)), each, mask=pa.array([v is None for v in values]))

    out = _each(waves, "samples", one, "_layers", "array<struct<layer:int,frames:array<array<float>>>>", kind, step=4).drop("samples")
    return out.select("*", F.explode_outer("_layers").alias("_l")).select(*[c for c in out.columns if c not in ("_layers", "error")], "_l.layer", "_l.frames", "error")
