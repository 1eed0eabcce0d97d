"""The same extraction over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.labels import label_from_path
from chorale.sources import audio

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_waveforms(spark: SparkSession, root: str, pattern: str = "*.wav", **options) -> DataFrame:
    """A streaming DataFrame of waveforms; every clip is handled once, failures carry ``error``."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    key = F.substring(F.col("path"), F.instr("path", base) + F.lit(len(base)), F.length("path"))
    named = files.select(key.alias("file_key"), "path", "length", "content").withColumn("label", label_from_path(F.col("file_key")))
    return audio.waveforms(named, **options)
