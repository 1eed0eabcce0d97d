"""How well labels separate vectors: silhouette, Calinski-Harabasz and Davies-Bouldin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.vec import long_form, rebuild, unit
from chorale.operators.neighbors import cluster_distances

#: Rows in a block of points, and labels in a block of clusters, at most about.
BLOCK = 4096
LABELS = 4096


def _mean_silhouette(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, silhouette) from (keys, id, label, other, total, n); a point alone in its cluster counts 0."""
    means = sums.withColumn("m", F.try_divide(F.col("total"), F.col("n").cast("double")))
    each = means.groupBy(*keys, "id", "label").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("m"))).alias("b"))
    return each.groupBy(*keys).agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouette_euclidean(points: DataFrame) -> DataFrame:
    """Exact, over all pairs in blocks; ``points`` has id, label, vec."""
    return _mean_silhouette(cluster_distances(points, "euclidean"))


def _against_labels(rows: DataFrame, clusters: DataFrame, keys: tuple[str, ...], one: Callable[[pd.DataFrame, pd.DataFrame, dict], pd.DataFrame], schema: str, most: int | None = None, total: int | None = None) -> DataFrame:
    """``one`` on every block of rows (keys, id, label, ...) with every block of clusters (keys, label, ...), of LABELS at most.

    There is one block of clusters unless labels are many, so rows go through the shuffle once. ``most`` labels
    of one key and ``total`` rows are counted here if they are not known.
    """
    most = most if most is not None else clusters.groupBy(*keys).count().agg(F.max("count")).first()[0]
    total = total if total is not None else rows.count()
    n_labels, n_rows = max(1, -(-(most or 1) // LABELS)), max(1, -(-total // BLOCK))
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))))
    told = clusters.withColumn("cb", F.pmod(F.xxhash64("label"), F.lit(n_labels)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    told = told.select(*[F.col(c).alias(f"_{c}") for c in told.columns])  # names of its own, for both sides can be one table
    block = [*keys, "rb", "cb"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        return one(left, right.rename(columns=lambda c: c[1:]), dict(zip(keys, key, strict=False)))[names]

    return dealt.groupBy(*block).cogroup(told.groupBy(*[f"_{c}" for c in block])).applyInPandas(run, schema)


def silhouette_cosine(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact without pairs of points: cosine distances to a cluster sum up to its size less a product with its sum of unit vectors.

    Blocks of points are multiplied with the matrix of label sums; a point's own cluster and the nearest
    other one are all that comes back.
    """
    units = points.select(*keys, "id", "label", unit(F.col("vec").cast("array<double>")).alias("u"))
    sums = rebuild(long_form(units, "u", *keys, "label").groupBy(*keys, "label", "dim").agg(F.sum("x").alias("x")), *keys, "label", out="s")
    clusters = sums.join(units.groupBy(*keys, "label").agg(F.count("*").alias("size")), [*keys, "label"])
    kinds = dict(units.dtypes)

    def one(left: pd.DataFrame, right: pd.DataFrame, head: dict) -> pd.DataFrame:
        u, s, size = np.stack(left["u"]), np.stack(right["s"]), right["size"].to_numpy(dtype=float)
        own = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]
        total = size[None, :] - u @ s.T - np.where(own, 1 - (u * u).sum(1)[:, None], 0)
        n = size[None, :] - own
        mean = np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0)
        a = np.where(own, mean, np.nan)
        b = np.where(own, np.inf, mean).min(axis=1)
        return left[["id", "label"]].assign(**head, a=np.where(own.any(1), np.nansum(a, axis=1) + np.where(np.isnan(a).all(1), np.nan, 0), np.nan), b=np.where(np.isfinite(b), b, np.nan))

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, "id", "label")], "a double", "b double"])
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    each = _against_labels(units, clusters, keys, one, schema).groupBy(*keys, "id", "label").agg(F.max(known("a")).alias("a"), F.min(known("b")).alias("b"))
    return each.groupBy(*keys).agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def scatter(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, dim, n, mean, within): size, mean and squared deviations by label and dimension."""
    long = long_form(points, "vec", *keys, "label")
    return long.groupBy(*keys, "label", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("within"))


def calinski_harabasz(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score) from label means; null with one label or no spread."""
    s = scatter(points, keys)
    dims = s.groupBy(*keys, "dim").agg(F.sum("n").alias("rows"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("within").alias("w"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    between = F.sum(F.col("q") - F.col("rows") * F.col("grand") * F.col("grand"))
    sums = dims.groupBy(*keys).agg(between.alias("b"), F.sum("w").alias("w"), F.max("rows").alias("rows"), F.max("k").alias("k"))
    return sums.select(*keys, F.try_divide(F.try_divide(F.col("b"), (F.col("k") - 1).cast("double")), F.try_divide(F.col("w"), (F.col("rows") - F.col("k")).cast("double"))).alias("score"))


def davies_bouldin(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score): mean over labels of the worst (s_i + s_j) / d_ij; labels, not rows, are compared, in blocks.

    Labels with the same centroid are not compared; null with one label.
    """
    centroids = rebuild(scatter(points, keys).withColumnRenamed("mean", "x"), *keys, "label", out="c")
    sizes = centroids.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("c")).alias("width")).agg(F.max("n"), F.sum("n"), F.max("width")).first()
    most, total, width = (x or 0 for x in sizes)
    joined = points.join(F.broadcast(centroids) if total * width <= 1 << 20 else centroids, [*keys, "label"])
    gap = F.sqrt(F.aggregate(F.zip_with(F.col("vec").cast("array<double>"), "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    spread = joined.groupBy(*keys, "label").agg(F.avg(gap).alias("s")).join(centroids, [*keys, "label"])
    kinds = dict(spread.dtypes)

    def one(left: pd.DataFrame, right: pd.DataFrame, head: dict) -> pd.DataFrame:
        a, b = np.stack(left["c"]), np.stack(right["c"])
        far = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) if len(a) * len(b) * a.shape[1] <= 1 << 22 else np.stack([np.sqrt(((x - b) ** 2).sum(1)) for x in a])
        other = (left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]) & (far > 0)
        both = left["s"].to_numpy()[:, None] + right["s"].to_numpy()[None, :]
        worst = np.divide(both, far, out=np.full(far.shape, -1.0), where=other).max(axis=1)
        return left[["label"]].assign(**head, r=np.where(worst >= 0, worst, np.nan))

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, "label")], "r double"])
    rows = spread.withColumn("id", F.col("label"))
    worst = _against_labels(rows, spread, keys, one, schema, most, total).groupBy(*keys, "label").agg(F.max(F.when(~F.isnan("r"), F.col("r"))).alias("r"))
    return worst.groupBy(*keys).agg(F.avg("r").alias("score"))
