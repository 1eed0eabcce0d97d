"""Pooling of frames to one vector per clip.

``pool_frames`` takes a row per frame: one shuffle on the keys, with partial sums on the map side.
``pool_nested`` takes a row per clip with its frames inside: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.vec import doubles, norm, total

Nested = Callable[[Column], Column]
_nested: dict[str, Nested] = {}


def register_pooling(name: str) -> Callable[[Nested], Nested]:
    """Make a function of ``array<array<double>>`` known to :func:`pool_nested` by name."""

    def keep(f: Nested) -> Nested:
        _nested[name] = f
        return f

    return keep


def _columns(frames: Column) -> Column:
    """The values of each dimension over the frames."""
    return F.transform(F.sequence(F.lit(0), F.size(frames[0]) - 1), lambda i: F.transform(frames, lambda f: F.get(f, i)))


@register_pooling("mean")
def _mean(frames: Column) -> Column:
    return F.transform(_columns(frames), lambda c: total(c) / F.size(c))


@register_pooling("max")
def _max(frames: Column) -> Column:
    return F.transform(_columns(frames), F.array_max)


@register_pooling("first")
def _first(frames: Column) -> Column:
    return frames[0]


@register_pooling("last")
def _last(frames: Column) -> Column:
    return F.element_at(frames, -1)


@register_pooling("weighted")
def _weighted(frames: Column) -> Column:
    """Softmax of the frame norms as weights, the largest norm taken off first."""

    def by(norms: Column) -> Column:
        top = F.array_max(norms)
        weights = F.transform(norms, lambda n: F.exp(n - top))
        return F.transform(F.array(weights), lambda w: F.transform(_columns(frames), lambda c: total(F.zip_with(c, w, lambda x, y: x * y)) / total(w)))[0]

    return F.transform(F.array(F.transform(frames, norm)), by)[0]


@register_pooling("mean_std")
def _mean_std(frames: Column) -> Column:
    def deviation(c: Column) -> Column:
        return F.transform(F.array(total(c) / F.size(c)), lambda m: F.sqrt(total(F.transform(c, lambda x: (x - m) * (x - m))) / F.size(c)))[0]

    return F.concat(_mean(frames), F.transform(_columns(frames), deviation))


METHODS = ("mean", "max", "first", "last", "weighted", "mean_std")


def pool_nested(frames: Column, method: str = "mean") -> Column:
    """Pool ``array<array<numeric>>``; null without frames, ValueError for an unknown method."""
    if method not in _nested:
        raise ValueError(f"unknown pooling method: {method}")
    f = frames.cast("array<array<double>>")
    return F.when(F.size(f) > 0, _nested[method](f))


def pool_frames(frames: DataFrame, keys: list[str], order: str, vec: str = "vec", methods: tuple[str, ...] = METHODS, weights: str | None = None) -> DataFrame:
    """(keys, method, dim, x) from a row per frame; all methods in one aggregation.

    ``weights`` names a column of explicit frame weights, used as they are; by default they are the
    softmax of the frame norms within a clip. First and last go by ``order``, never by arrival.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown pooling methods: {sorted(unknown)}")
    rows = frames.select(*keys, F.col(order).alias("_order"), doubles(vec).alias("_v"), *([F.col(weights).cast("double").alias("_w")] if weights else []))
    if "weighted" in methods and not weights:
        clip = Window.partitionBy(*keys)
        rows = rows.withColumn("_n", norm(F.col("_v"))).withColumn("_e", F.exp(F.col("_n") - F.max("_n").over(clip))).withColumn("_w", F.col("_e") / F.sum("_e").over(clip))
    elif not weights:
        rows = rows.withColumn("_w", F.lit(0.0))
    long = rows.select(*keys, "_order", "_w", F.posexplode("_v").alias("dim", "_x"))
    value = {
        "mean": F.avg("_x"), "max": F.max("_x"), "first": F.min_by("_x", "_order"), "last": F.max_by("_x", "_order"),
        "weighted": F.sum(F.col("_w") * F.col("_x")), "mean_std": F.stddev_pop("_x"),
    }
    wide = long.groupBy(*keys, "dim").agg(*[value[m].alias(m) for m in methods], *([F.avg("_x").alias("_mean")] if "mean_std" in methods else []))
    plain = [m for m in methods if m != "mean_std"]
    entries = [F.struct(F.lit(m).alias("method"), F.col("dim").alias("dim"), F.col(m).alias("x")) for m in plain]
    if "mean_std" in methods:
        width = F.count("*").over(Window.partitionBy(*keys)).cast("int")
        wide = wide.withColumn("_width", width)
        entries += [F.struct(F.lit("mean_std").alias("method"), F.col("dim").alias("dim"), F.col("_mean").alias("x")), F.struct(F.lit("mean_std").alias("method"), (F.col("dim") + F.col("_width")).alias("dim"), F.col("mean_std").alias("x"))]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.method", "e.dim", "e.x")
