"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.shared import bounded, fits, table

#: Nodes with more edges are hubs: their few minima are sent to the edges, so that no task gets a whole star.
HUB = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (x, y) with m, the least y of their x."""
    least = table(edges.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")), "least")
    if fits(least):
        return edges.join(F.broadcast(least.drop("n")), "x")
    hubs = least.where(F.col("n") > HUB).select(F.col("x").alias("hub"), F.col("m").alias("hub_m"))  # fewer than edges / HUB
    told = edges.join(bounded(hubs), F.col("x") == F.col("hub"), "left")
    rest = told.where("hub IS NULL").select("x", "y").join(least.where(F.col("n") <= HUB).select("x", "m"), "x")
    return told.where("hub IS NOT NULL").select("x", "y", F.col("hub_m").alias("m")).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): every node of an edge and the smallest node that it is connected to.

    Null ends and loops are no edges, repeated edges count once. Each round is a written table, so a lost
    executor costs a task, not the rounds before it. An edge table without edges gives an empty result.
    """
    ends = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    stars, seen = table(ends.distinct(), "edges"), None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        told = _with_least(both).withColumn("m", F.least("x", "m"))
        large = table(told.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")), "large")
        small = _with_least(large).select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y").where("x <> y")
        stars = table(small.distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = stars.select(F.col("y").alias("node")).distinct().withColumn("label", F.col("node"))
    return table(stars.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(roots), "components")
