"""Linear machines reach the least hinge loss, in a few jobs, however the points lie."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from chorale.operators import models


def clouds(spark, n=240, labels=3):
    rng = np.random.default_rng(8)
    rows = [(i, f"c{i % labels}", (100 + 3 * rng.normal(size=5) + 4 * np.eye(5)[i % labels]).tolist() + [7.0]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, vec array<double>")


def losses(rows, mean, scale, weights, penalty):
    data = rows.select("y", "weight", "vec").toPandas()
    x, y, w = (np.stack(data["vec"]) - mean) * scale, data["y"].to_numpy().astype(int), data["weight"].to_numpy()
    short = 1 - np.where(y[:, None] == np.arange(len(weights)), 1, -1) * (x @ weights[:, :-1].T + weights[:, -1])
    return w @ np.maximum(short, 0) / w.sum() + penalty / 2 * (weights[:, :-1] ** 2).sum(axis=1)


def test_loss_is_that_of_a_plain_solver(spark):
    rows = models.vectors(clouds(spark)).persist()
    ours = models.linear_svm(240).fit(rows.coalesce(1))
    assert ours.scale[-1] == 0  # a dimension of one value
    scaled = rows.withColumn("features", F.transform("vec", lambda x, i: (x - F.lit(ours.mean.tolist())[i]) * F.lit(ours.scale.tolist())[i])).withColumn("features", models.array_to_vector("features"))
    for k, loss in enumerate(losses(rows, ours.mean, ours.scale, ours.weights, 1 / 240)):
        svm = LinearSVC(labelCol="own", weightCol="weight", regParam=1 / 240, maxIter=1000, tol=1e-6).fit(scaled.withColumn("own", (F.col("y") == k).cast("double")))
        theirs = losses(rows, ours.mean, ours.scale, np.tile(np.append(svm.coefficients.toArray(), svm.intercept), (3, 1)), 1 / 240)[k]
        assert loss <= theirs + 1e-3
    rows.unpersist()


def test_partitions_do_not_matter(spark):
    rows = models.vectors(clouds(spark)).persist()
    one, many = (models.linear_svm(240).fit(rows.repartition(n, "id")) for n in (1, 2))
    a, b = (losses(rows, m.mean, m.scale, m.weights, 1 / 240) for m in (one, many))
    assert np.abs(a - b).max() < 1e-4
    said = [[r["prediction"] for r in m.transform(rows).orderBy("id").collect()] for m in (one, many)]
    assert np.mean(np.array(said[0]) == np.array(said[1])) > 0.98
    rows.unpersist()


def test_machines_take_a_few_jobs(spark):
    """Spark ML ran a job for every step of every label."""
    rows = models.vectors(clouds(spark)).persist()
    rows.count()
    spark.sparkContext.setJobGroup("svm", "jobs of an SVM")
    try:
        models.linear_svm(240).fit(rows.coalesce(1))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()
    assert 0 < jobs <= 8
