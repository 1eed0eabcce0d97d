"""Ranking layers by metrics; ``metrics`` is long: (keys, layer, metric, value), null where a metric failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smaller is better for these.
ASCENDING = ("davies_bouldin",)
#: Chosen parameters, not scores; they are never ranked.
PARAMETERS = ("knn_best_k", "linear_probe_best_C", "logreg_best_C")


def merit(metric: str = "metric", value: str = "value") -> Column:
    """The value so that larger is better; NaN counts as missing."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    return F.when(F.col(metric).isin(*ASCENDING), -v).otherwise(v)


def rank_layers(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank within each metric: best first, missing last, ties to the lowest layer."""
    w = Window.partitionBy(*keys, "metric").orderBy(merit().desc_nulls_last(), "layer")
    return metrics.where(~F.col("metric").isin(*PARAMETERS)).withColumn("rank", F.row_number().over(w).cast("long"))


def top_layers(metrics: DataFrame, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    return rank_layers(metrics, keys).where(F.col("rank") <= n)


def best_layer(metrics: DataFrame, metric: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, layer, value) of the best layer by one metric, the lowest of equals."""
    rows = metrics.where((F.col("metric") == metric) & merit().isNotNull())
    best = F.min(F.struct((-merit()).alias("m"), F.col("layer").alias("layer"), F.col("value").alias("value"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.layer", "b.value")


def min_max(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds scaled in [0, 1] within each metric, 1 the best; null where all layers are equal."""
    w = Window.partitionBy(*keys, "metric")
    m = merit()
    return metrics.where(~F.col("metric").isin(*PARAMETERS)).withColumn("scaled", F.try_divide(m - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w)))


def with_best(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_best for curves: the first layer with the best value of its metric."""
    return rank_layers(metrics, keys).withColumn("is_best", (F.col("rank") == 1) & merit().isNotNull())


def join_metrics(clusters: DataFrame, *scores: DataFrame) -> DataFrame:
    """Cluster metrics by layer with the classifiers' columns beside them; what is missing is 0."""
    joined = reduce(lambda a, b: a.join(b, "layer", "left"), scores, clusters)
    added = [c for c in joined.columns if c not in clusters.columns]
    return joined.select(*clusters.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in added])


def compare_models(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """(layer, a, b) for layers of either model; what is missing is 0."""
    left, right = a.select("layer", F.col(value).alias("a")), b.select("layer", F.col(value).alias("b"))
    return left.join(right, "layer", "full_outer").select("layer", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def compare_metrics(models: dict[str, DataFrame], keys: tuple[str, ...] = ("metric", "layer")) -> DataFrame:
    """(keys, a column for each model): the union of the metrics and layers that any model has; what a model lacks is null."""
    out = None
    for name, metrics in models.items():
        one = metrics.where(~F.col("metric").isin(*PARAMETERS)).select(*keys, F.col("value").alias(name))
        out = one if out is None else out.join(one, list(keys), "full_outer")
    return out


def grid(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every row value with every column value; cells without a result are 0. The dimensions are joined, not the rows."""
    every = cells.select(row).distinct().crossJoin(cells.select(column).distinct())
    return every.join(cells.select(row, column, value), [row, column], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
