"""Column builders over ``array<float|double>``; all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def scale(v: Column, w: Column | float) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.transform(v, lambda x: x * w)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def long_form(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    """One row per element: the columns ``keep``, dim (from 0) and x."""
    return df.select(*keep, F.posexplode(doubles(vec)).alias("dim", "x"))


def rebuild(df: DataFrame, *keys: str, value: str = "x", out: str = "vec") -> DataFrame:
    """Vectors from rows (keys, dim, value), in order of dim."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", value))), lambda p: p[value]).alias(out))


def reshape(df: DataFrame, vec: str, parts: int, width: int, name: str, *keep: str) -> DataFrame:
    """``parts`` rows for each vector: its slices of ``width``, numbered by ``name`` from 0."""
    i = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    return df.select(*keep, doubles(vec).alias("_v"), i.alias(name)).select(*keep, name, F.slice("_v", F.col(name) * width + 1, width).alias("vec"))
