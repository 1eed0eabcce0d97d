"""Corpus summaries and per-clip statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, std, min, max, range, median, q25, q75): population deviation and exact, interpolated percentiles."""
    v = F.col(value)
    pct = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), pct(0.5).alias("median"), pct(0.25).alias("q25"), pct(0.75).alias("q75"))


def framed(df: DataFrame, keys: list[str], t: str, x: str, length: int, hop: int) -> DataFrame:
    """(keys, frame, rms, zcr) of whole frames of ``length`` samples every ``hop``; t counts from 0.

    A sample is dealt to the few frames that hold it, so one shuffle on the frames does it.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(t))
    rows = df.withColumn("_n", n).withColumn("_b", before)
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / F.lit(float(hop)))).cast("int")
    last = F.floor(F.least(F.col(t), F.col("_n") - length) / F.lit(float(hop))).cast("int")
    spread = rows.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("frame", F.explode(F.sequence("_first", "_last")))
    crossing = ((F.col(x) < 0) != (F.col("_b") < 0)) & (F.col(t) > F.col("frame") * hop)
    return spread.groupBy(*keys, "frame").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), (F.count_if(crossing) / F.lit(float(length))).alias("zcr"))


_DURATIONS = (("avg_duration", F.avg), ("min_duration", F.min), ("max_duration", F.max))


def corpus_stats(clips: DataFrame, label: str, seconds: str) -> DataFrame:
    """(label, n_files, avg, min, max, total): durations of all clips of a label, 0 if none is known."""
    x = F.col(seconds).cast("double")
    sums = clips.groupBy(label).agg(F.count("*").alias("n_files"), *[F.coalesce(f(x), F.lit(0.0)).alias(n) for n, f in _DURATIONS], F.coalesce(F.sum(x), F.lit(0.0)).alias("total_duration"))
    return sums.select(label, "n_files", "avg_duration", "min_duration", "max_duration", "total_duration")


def corpus_estimate(clips: DataFrame, label: str, seconds: str, order: str, head: int = 10) -> DataFrame:
    """The same estimated from the first ``head`` clips of each label, for corpora whose clips must be opened for their durations."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    counts = clips.groupBy(label).agg(F.count("*").alias("n_files"))
    first = clips.withColumn("_p", place).where(F.col("_p") <= head)
    means = first.groupBy(label).agg(*[f(F.col(seconds).cast("double")).alias(n) for n, f in _DURATIONS])
    filled = [F.coalesce(n, F.lit(0.0)).alias(n) for n, _ in _DURATIONS]
    return counts.join(means, label, "left").select(label, "n_files", *filled).withColumn("total_duration", F.col("avg_duration") * F.col("n_files"))


def corpus_blocks(clips: DataFrame, block: str, individual: str, call: str, seconds: str) -> DataFrame:
    """(block, num_files, num_individuals, individuals, num_call_types, call_types, avg_duration): each part of a corpus, such as adults and young; null names count for nothing."""
    names = lambda c: F.array_sort(F.collect_set(c))
    rows = clips.groupBy(block).agg(F.count("*").alias("num_files"), names(individual).alias("individuals"), names(call).alias("call_types"), F.coalesce(F.avg(F.col(seconds).cast("double")), F.lit(0.0)).alias("avg_duration"))
    return rows.select(block, "num_files", F.size("individuals").cast("long").alias("num_individuals"), "individuals", F.size("call_types").cast("long").alias("num_call_types"), "call_types", "avg_duration")


def totals(df: DataFrame, group: str, ok: str) -> DataFrame:
    """(group, n_ok, n_all), and one row for all with a null group."""
    return df.rollup(group).agg(F.count_if(F.col(ok)).alias("n_ok"), F.count("*").alias("n_all"))


def dft_shape(signals: DataFrame, key: str, n: int, part: float = 0.85) -> DataFrame:
    """(key, centroid, bandwidth, rolloff) in bins, from (key, t, x) with a basis table of n * (n / 2 + 1) rows."""
    spark = signals.sparkSession
    basis = spark.range(n).select(F.col("id").cast("int").alias("t")).crossJoin(spark.range(n // 2 + 1).select(F.col("id").cast("int").alias("f")))
    angle = F.lit(-2 * 3.141592653589793) * F.col("f") * F.col("t") / n
    basis = basis.select("t", "f", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    bins = signals.join(F.broadcast(basis), "t").groupBy(key, "f").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    mags = bins.select(key, "f", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("m"))
    clip = Window.partitionBy(key)
    up = clip.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    rows = mags.withColumns({"all": F.sum("m").over(clip), "c": F.sum(F.col("f") * F.col("m")).over(clip) / F.sum("m").over(clip), "grown": F.sum("m").over(up)})
    return rows.groupBy(key).agg(F.max("c").alias("centroid"), F.sqrt(F.sum(F.col("m") / F.col("all") * (F.col("f") - F.col("c")) * (F.col("f") - F.col("c")))).alias("bandwidth"), F.min(F.when(F.round("grown", 9) >= F.round(part * F.col("all"), 9), F.col("f"))).cast("long").alias("rolloff"))


def delta_frames(df: DataFrame, keys: list[str], t: str, x: str, width: int = 9, order: int = 1) -> DataFrame:
    """Adds delta: the slope of a line through ``width`` frames around each, or with ``order`` 2 the second derivative of a parabola; null near the ends."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(t)
    places = range(-half, half + 1)
    spread = sum(k * k for k in places)
    if order == 1:
        weights = {k: k / spread for k in places}
    else:  # the least-squares parabola's leading weight, twice
        fourth = sum(k**4 for k in places)
        weights = {k: 2 * (width * k * k - spread) / (width * fourth - spread * spread) for k in places}
    neighbour = lambda k: F.col(x) if k == 0 else F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w)
    return df.withColumn("delta", sum((F.lit(v) * neighbour(k) for k, v in weights.items() if v), F.lit(0.0)))
