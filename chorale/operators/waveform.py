"""Normalising and checking waveforms held in ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions.vec import total


def normalise(samples: Column, method: str = "peak") -> Column:
    """Peak or RMS level 1; silence stays as it is, an unknown method is a ValueError."""
    v = samples.cast("array<double>")
    if method == "peak":
        level = F.array_max(F.transform(v, F.abs))
    elif method == "rms":
        level = F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v))
    else:
        raise ValueError(f"unknown normalisation: {method}")
    return F.transform(F.array(level), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def mono(channels: Column) -> Column:
    """The mean of equally long channels."""
    c = channels.cast("array<array<double>>")
    return F.transform(c[0], lambda _, i: total(F.transform(c, lambda x: F.get(x, i))) / F.size(c))


def duration_ok(seconds: Column, least: float | None = 0.1, most: float | None = 10.0) -> Column:
    """Inclusive bounds, either may be missing."""
    out = F.lit(True)
    if least is not None:
        out = out & (seconds >= least)
    return out & (seconds <= most) if most is not None else out
