"""Trees grown by parts are the trees of a plain loop, however the points lie, in a few jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import forest, models


def noise(spark, n=400, labels=4, width=9):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, f"c{rng.integers(labels)}", rng.normal(size=width).tolist()) for i in range(n)], "id long, label string, vec array<double>")


def predicted(model, rows):
    return sorted((r["id"], r["prediction"]) for r in model.transform(rows).select("id", "prediction").collect())


def test_cells_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    rows = models.vectors(noise(spark)).select("id", "y", "vec", "weight").persist()
    grow = lambda parts: forest.RandomForest(trees=7, min_rows=2).fit(rows.repartition(parts, "id"))
    one = grow(1)
    whole = predicted(one, rows)
    assert {len(t.dim) for t in one.tops} == {1}
    monkeypatch.setattr(forest, "ROWS_IN_CELL", 60)
    monkeypatch.setattr(forest, "BLOCK", 50)
    monkeypatch.setattr(forest, "SEND", 1000)  # a few nodes a job
    cut = grow(3)
    assert min(len(t.dim) for t in cut.tops) > 5 and predicted(cut, rows) == whole
    one.forget(), cut.forget(), rows.unpersist()


def test_a_tree_is_that_of_a_plain_loop():
    rng = np.random.default_rng(4)
    bins, y, times = rng.integers(0, 32, (500, 9)).astype(np.uint8), rng.integers(0, 3, 500), rng.integers(1, 4, 500).astype(np.uint8)
    weights, rf = np.array([1.0, 0.5, 2.0]), forest.RandomForest(min_rows=2, depth=7)

    def impurity(rows):
        w = np.bincount(y[rows], weights=times[rows] * weights[y[rows]], minlength=3)
        return w.sum() - (w**2).sum() / w.sum()

    def leaves(rows, node, level):
        best = (0.0,)
        for dim in forest.subsets(np.array([node]), 5, 9, 3, rf.seed)[0] if level < rf.depth and len(set(y[rows])) > 1 else ():
            for cut in range(31):
                left, right = rows[bins[rows, dim] <= cut], rows[bins[rows, dim] > cut]
                if times[left].sum() >= 2 and times[right].sum() >= 2:
                    gain = impurity(rows) - impurity(left) - impurity(right)
                    if gain > best[0] + 1e-9:
                        best = gain, left, right
        if len(best) == 1:
            return [sorted(rows.tolist())]
        return leaves(best[1], 2 * node + 1, level + 1) + leaves(best[2], 2 * node + 2, level + 1)

    at = rf.grown(bins, y, times, 5, 0, weights).walk(bins)
    assert sorted(np.flatnonzero(at == k).tolist() for k in set(at.tolist())) == sorted(leaves(np.arange(500), 0, 0))


def test_a_forest_takes_a_few_jobs_whatever_its_depth(spark):
    """Spark ML ran a job and more for each level."""
    points = noise(spark)
    rows = models.vectors(points).persist()
    rows.count()
    spark.sparkContext.setJobGroup("forest", "jobs of a forest")
    try:
        models.random_forest(400, 20).fit(rows.coalesce(1)).forget()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()
    assert 0 < jobs <= 12  # 7; Spark ML's took 24 here
    trained = models.Classifier("random_forest", {"trees": 20}).train(points)
    assert trained.evaluate(points).first()["accuracy"] > 0.9  # its own points, noise as they are
    trained.forget()


def test_copies_that_no_cut_divides(spark, monkeypatch):
    """More copies than a cell holds are a leaf of a top; the likelier label wins, and a tie goes to the first."""
    monkeypatch.setattr(forest, "ROWS_IN_CELL", 20)
    df = spark.range(120).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0).alias("y"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"), F.lit(1.0).alias("weight"))
    model = forest.RandomForest(trees=5).fit(df)
    assert {p for _, p in predicted(model, df)} == {1.0}
    assert model.transform(df.limit(0)).count() == 0
    model.forget()


@pytest.mark.parametrize("n", [1, 2])
def test_hardly_any_points(spark, n):
    df = spark.range(n).select("id", F.col("id").cast("double").alias("y"), F.array(F.col("id").cast("double")).alias("vec"), F.lit(1.0).alias("weight"))
    assert len(predicted(forest.RandomForest().fit(df), df)) == n
