"""Labels, call types, folder names and feature names from paths and flags."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Pitch classes and statistics in the order of the feature vectors.
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
SPECTRAL = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "zero_crossing_rate", "rms_energy")
PROSODIC = (
    "f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_median", "f0_q25", "f0_q75", "voicing_ratio", "voiced_prob_mean",
    "rms_mean", "rms_std", "rms_min", "rms_max", "rms_range", "rms_median", "rms_q25", "rms_q75",
    "duration_sec", "zcr_mean", "zcr_std", "zcr_max", "centroid_mean", "centroid_std", "rolloff_mean", "rolloff_std",
)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def label_from_path(path: Column) -> Column:
    """Parent folder of a nested path, else the stem before its first underscore."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(F.split_part(stem(path), F.lit("_"), F.lit(1)))


def prefix(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def call_type(name: Column) -> Column:
    """What follows the last hyphen; null without one."""
    return F.when(F.contains(name, F.lit("-")), F.element_at(F.split(name, "-"), -1))


def folder_key(path: Column) -> Column:
    return F.replace(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit(" "), F.lit("_"))


def encode(label: str) -> Column:
    """Labels as 0, 1, ... in alphabetical order; apply to the distinct labels and join back for large tables."""
    return (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long")


def metric_title(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def mfcc_names(n: int = 13, delta: bool = True, delta_delta: bool = False) -> list[str]:
    kinds = ["mfcc", *["delta_mfcc"] * delta, *["delta2_mfcc"] * delta_delta]
    return [f"{k}_{i}" for k in kinds for i in range(n)]


def spectral_names(bands: int = 6) -> list[str]:
    return [*SPECTRAL, *[f"spectral_contrast_{i}" for i in range(bands + 1)], *[f"chroma_{p}" for p in PITCH_CLASSES]]


def spectral_dim(contrast: bool = True, chroma: bool = True, bands: int = 6) -> int:
    return len(SPECTRAL) + (bands + 1) * contrast + len(PITCH_CLASSES) * chroma


def stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
