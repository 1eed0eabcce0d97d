"""Selection and combination of encoder layers; a row per (clip, layer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.vec import doubles, rebuild
from chorale.operators.clustering import calinski_harabasz, davies_bouldin, silhouette_cosine

STRATEGIES = ("specified", "early", "middle", "late", "early_middle_late", "all")


def select_layers(n: int, strategy: str = "all", layers: list[int] | None = None) -> list[int]:
    """Layer numbers out of ``n``; ValueError for an unknown strategy or a missing list."""
    if strategy == "specified":
        if not layers:
            raise ValueError("specified needs a list of layers")
        return [x for x in layers if 0 <= x < n]
    middle = n // 2
    chosen = {"early": range(min(3, n)), "middle": range(max(0, middle - 1), min(n, middle + 2)), "late": range(max(0, n - 3), n), "early_middle_late": sorted({0, middle, n - 1}), "all": range(n)}
    if strategy not in chosen:
        raise ValueError(f"unknown layer selection: {strategy}")
    return list(chosen[strategy])


def default_weights(layers: list[int]) -> dict[int, float]:
    """1 / (place + 1), scaled to sum 1."""
    raw = [1 / (i + 1) for i in range(len(layers))]
    return {layer: w / sum(raw) for layer, w in zip(layers, raw, strict=True)}


def scaled_weights(weights: dict[int, float]) -> dict[int, float]:
    whole = sum(weights.values())
    return {k: v / whole for k, v in weights.items()}


def check_layers(df: DataFrame, keys: list[str], layers: list[int]) -> None:
    """ValueError if a clip lacks one of the layers."""
    short = df.where(F.col("layer").isin(layers)).groupBy(*keys).agg(F.count_distinct("layer").alias("n")).where(F.col("n") != len(set(layers)))
    if short.take(1):
        raise ValueError("some clips lack some of the layers")


def combine_layers(df: DataFrame, keys: list[str], method: str, layers: list[int], weights: dict[int, float] | None = None, vec: str = "vec", check: bool = True) -> DataFrame:
    """(keys, vec): concatenation, mean, weighted_mean or max over the given layers, in that order.

    Several poolings are combined at once with their column among ``keys``. ValueError if one of the keys
    lacks a layer, unless ``check`` is false.
    """
    if check:
        check_layers(df, keys, layers)
    place = F.create_map(*[F.lit(x) for pair in enumerate(layers) for x in (pair[1], pair[0])])
    rows = df.where(F.col("layer").isin(layers)).select(*keys, "layer", place[F.col("layer")].alias("place"), doubles(vec).alias("v"))
    if method == "concatenation":
        return rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p["v"])).alias("vec"))
    long = rows.select(*keys, "layer", F.posexplode("v").alias("dim", "x"))
    if method == "mean":
        value = F.avg("x")
    elif method == "max":
        value = F.max("x")
    elif method == "weighted_mean":
        weights = weights or default_weights(layers)
        if set(weights) != set(layers):
            raise ValueError("one weight is needed for each layer")
        w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("layer")]
        value = F.sum(w * F.col("x")) / F.sum(w)
    else:
        raise ValueError(f"unknown combination: {method}")
    return rebuild(long.groupBy(*keys, "dim").agg(value.alias("x")), *keys)


def weights_from_scores(score: Column, *partition: str) -> Column:
    """score / sum of scores where the sum is positive, else equal weights."""
    w = Window.partitionBy(*partition)
    return F.when(F.sum(score).over(w) > 0, score / F.sum(score).over(w)).otherwise(F.lit(1.0) / F.count("*").over(w))


#: How layers are scored for their weights.
CONTRIBUTIONS = ("silhouette", "calinski", "davies_bouldin")


def layer_contributions(df: DataFrame, metric: str = "silhouette", keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(keys, score): cosine silhouette, Calinski-Harabasz or 1 / (Davies-Bouldin + 1e-6); 0 where it cannot be told, ValueError for another metric."""
    if metric not in CONTRIBUTIONS:
        raise ValueError(f"unknown metric: {metric}")
    if metric == "silhouette":
        found = silhouette_cosine(df, keys).withColumnRenamed("silhouette", "score")
    elif metric == "calinski":
        found = calinski_harabasz(df, keys)
    else:
        found = davies_bouldin(df, keys).withColumn("score", 1 / (F.col("score") + F.lit(1e-6)))
    return df.select(*keys).distinct().join(found, list(keys), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
