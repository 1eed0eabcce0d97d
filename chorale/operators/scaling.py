"""How hard identification gets as individuals are added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.tables import small
from chorale.operators.models import Classifier
from chorale.operators.neighbors import holdout
from chorale.operators.sampling import placed


def choose(points: DataFrame, sizes: list[int], trials: int = 5, selection: str = "random", seed: int = 42) -> DataFrame:
    """(n, trial, label): labels of every trial, sizes beyond the labels that there are left out.

    random takes labels in hash order of seed and trial; most and least take those with the most or
    fewest rows, in a single trial.
    """
    counts = points.groupBy("label").agg(F.count("*").alias("rows"))
    configs = counts.sparkSession.createDataFrame([(n, t) for n in sizes for t in range(trials if selection == "random" else 1)], "n int, trial int")
    keyed = counts.crossJoin(F.broadcast(configs))  # one row for each size and trial asked for
    order = {
        "random": [F.md5(F.concat((F.col("trial") + seed).cast("string"), F.lit(":"), F.col("label").cast("string")))],
        "most": [F.desc("rows")],
        "least": [F.asc("rows")],
    }[selection]
    w = Window.partitionBy("n", "trial")
    placed = keyed.withColumn("place", F.row_number().over(w.orderBy(*order, "label"))).withColumn("there", F.count("*").over(w))
    return placed.where("place <= n AND n <= there").select("n", "trial", "label")


def split_trials(points: DataFrame, chosen: DataFrame, seed: int = 42) -> DataFrame:
    """(n, trial, id, label, vec, is_test): a stratified fifth of every label is for tests, anew in each trial.

    A label is split in a trial once, whatever sizes it is chosen for; rows are repeated for the sizes behind the shuffles of the split.
    """
    rows = points.join(small(chosen.select("trial", "label").distinct(), 2), "label")
    order = F.md5(F.concat((F.col("trial") + seed).cast("string"), F.lit(":"), F.col("id").cast("string")))
    told = placed(rows, ["trial", "label"], "id", order)
    told = told.withColumn("is_test", F.col("_place") <= F.floor((F.col("_total") + 4) / 5)).drop("_place", "_total")
    return told.join(small(chosen, 3), ["trial", "label"])


def scaling_study(points: DataFrame, sizes: list[int], trials: int = 5, selection: str = "random", k: int = 5, seed: int = 42) -> DataFrame:
    """(n, trials, mean and population deviation of accuracy, balanced accuracy and macro F1) with kNN.

    All trials are one grouped query; nothing loops on the driver.
    """
    rows = split_trials(points, choose(points, sizes, trials, selection, seed), seed).withColumnRenamed("n", "size")
    return _summed(holdout(rows, [k], ("size", "trial")))


def _summed(scores: DataFrame) -> DataFrame:
    stats = [f(F.col(m)).alias(f"{m}_{s}") for m in ("accuracy", "balanced_accuracy", "macro_f1") for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return scores.groupBy("size").agg(F.count("*").alias("trials"), *stats).withColumnRenamed("size", "n")


def classifier_study(name: str) -> Callable[..., DataFrame]:
    """A study like :func:`scaling_study` with a registered classifier; a model is fitted for each size and trial."""

    def study(points: DataFrame, sizes: list[int], trials: int = 5, selection: str = "random", seed: int = 42) -> DataFrame:
        rows = split_trials(points, choose(points, sizes, trials, selection, seed), seed).persist()
        scores = None
        for cell in rows.select("n", "trial").distinct().orderBy("n", "trial").collect():  # sizes times trials
            here = rows.where((F.col("n") == cell["n"]) & (F.col("trial") == cell["trial"])).select("id", "label", "vec", "is_test")
            one = Classifier(name).train_and_evaluate(here).withColumns({"size": F.lit(cell["n"]), "trial": F.lit(cell["trial"])})
            scores = one if scores is None else scores.unionByName(one)
        return _summed(scores)

    return study


def compare_scaling(sets: dict[str, DataFrame], sizes: list[int], studies: dict[str, Callable[..., DataFrame]] | None = None, **options) -> DataFrame:
    """Every study (kNN by default) of every feature set in one table with columns features and classifier."""
    out = None
    for name, points in sets.items():
        for classifier, study in (studies or {"knn": scaling_study}).items():
            rows = study(points, sizes, **options).withColumns({"features": F.lit(name), "classifier": F.lit(classifier)})
            out = rows if out is None else out.unionByName(rows)
    return out
