"""Operators for SQL text: table functions to be used with LATERAL, a clip at a time.

    register(spark)
    spark.sql("SELECT c.id, f.* FROM clips c, LATERAL wave_frames(c.samples, 512, 256) f")

A null or too short clip has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chorale.functions import dsp


class WaveFrames:
    """(frame, rms, zcr) of whole frames of ``length`` samples every ``hop``."""

    def eval(self, samples: list[float], length: int, hop: int) -> Iterator[tuple]:
        if samples is None or len(samples) < length:
            return
        f = dsp.frames(np.asarray(samples, float), length, hop, centred=False)
        crossings = np.diff(f < 0, axis=1).sum(1) / length
        for k, (r, z) in enumerate(zip(np.sqrt((f**2).mean(1)), crossings, strict=True)):
            yield k, float(r), float(z)


class WaveMfcc:
    """(frame, vec) of MFCC and their deltas."""

    def eval(self, samples: list[float], sr: int) -> Iterator[tuple]:
        if samples is None or not len(samples):
            return
        for k, v in enumerate(dsp.mfcc_frames(np.asarray(samples, float), sr)):
            yield k, v.tolist()


def _weighted(f: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(f, axis=1)
    w = np.exp(norms - norms.max())
    return w @ f / w.sum()


_POOLINGS = {
    "mean": lambda f: f.mean(0), "max": lambda f: f.max(0), "first": lambda f: f[0], "last": lambda f: f[-1],
    "weighted": _weighted, "mean_std": lambda f: np.concatenate((f.mean(0), f.std(0))),
}


class PoolFrames:
    """(dim, x) of frames pooled by a method."""

    def eval(self, frames: list[list[float]], method: str) -> Iterator[tuple]:
        if method not in _POOLINGS:
            raise ValueError(f"unknown pooling method: {method}")
        if frames is not None and len(frames):
            for k, x in enumerate(_POOLINGS[method](np.array([list(f) for f in frames], float))):
                yield k, float(x)


FUNCTIONS = {"wave_frames": (WaveFrames, "frame int, rms double, zcr double"), "wave_mfcc": (WaveMfcc, "frame int, vec array<double>"), "pool_frames": (PoolFrames, "dim int, x double")}


def register(spark: SparkSession) -> None:
    """Clips reach Python a hundred at a time; an Arrow batch of ten thousand long ones would be held as Python lists."""
    for name, (make, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(make, returnType=schema, useArrow=False))
