"""Classifiers and grid search on Spark ML; points are (id, label, vec)."""

from __future__ import annotations

import ast
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.labels import encode
from chorale.functions.tables import bare, small
from chorale.functions.vec import doubles
from chorale.operators import linear
from chorale.operators.boosting import Boosting
from chorale.operators.forest import RandomForest
from chorale.operators.margins import Margins
from chorale.operators.metrics import bundle, confusion
from chorale.operators.neighbors import nearest, vote
from chorale.operators.sampling import class_weights, drop_rare, stratified_folds, stratified_split


def vectors(points: DataFrame) -> DataFrame:
    """(id, label, y, features, weight, …): labels numbered in order, balanced weights."""
    codes = points.select("label").distinct().withColumn("y", encode("label").cast("double"))
    return class_weights(points.join(small(codes), "label"), "label").withColumn("features", array_to_vector(doubles("vec")))


def logistic(n_rows: int, c: float = 1.0) -> Estimator:
    """Multinomial with an L2 penalty; C counts against the summed loss, so regParam is 1 / (C n)."""
    return LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=1 / (c * n_rows), elasticNetParam=0, standardization=False, maxIter=1000)


def linear_svm(n_rows: int, c: float = 1.0) -> Margins:
    """One against the rest on scaled features, balanced, all labels in one optimiser."""
    return Margins(1 / (c * n_rows))


def random_forest(n_rows: int, trees: int = 100, depth: int = 30, min_rows: int = 1) -> RandomForest:
    """Depth 30 stands for no limit, as with Spark ML; a tree's parts are grown by tasks and stay on the executors."""
    return RandomForest(trees, depth, min_rows)


def boosted_trees(n_rows: int, rounds: int = 100, depth: int = 5, rate: float = 0.1) -> Boosting:
    """A tree for each label in every round, all labels in one aggregate a level."""
    return Boosting(rounds, depth, rate)


def fourier_map(points: DataFrame, gamma: float | str = "scale", n: int = 128, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007); a linear SVM on them stands for an RBF one.

    A gamma of scale or auto is taken from ``points``, which are those of training.
    """
    width = points.agg(F.max(F.size("vec"))).first()[0]
    spread = points.select(F.explode(doubles("vec")).alias("x")).agg(F.var_pop("x")).first()[0] if gamma == "scale" else None
    g = 1 / (width * max(spread, 1e-12)) if gamma == "scale" else 1 / width if gamma == "auto" else float(gamma)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * g), size=(n, width)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def lift(v):
        import pandas as pd

        m = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(np.sqrt(2 / n) * np.cos(m @ w.T + b)))

    return lambda df: df.withColumn("vec", lift(doubles("vec")))


#: Rows of a partition in training; many small partitions cost more than they share.
ROWS_IN_PART = 50_000

Maker = Callable[..., Estimator | Boosting | RandomForest | Margins]
#: Classifiers by name: how to make one, its default settings, its grid.
_classifiers: dict[str, tuple[Maker, dict, dict]] = {
    "linear_probe": (logistic, {"c": 1.0}, {"c": [0.001, 0.01, 0.1, 1.0, 10.0]}),
    "logistic_regression": (logistic, {"c": 1.0}, {"c": [0.001, 0.01, 0.1, 1.0, 10.0]}),
    "svm_linear": (linear_svm, {"c": 1.0}, {"c": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}),
    "svm_rbf": (linear_svm, {"c": 1.0, "gamma": "scale"}, {"c": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0]}),
    "random_forest": (random_forest, {}, {"trees": [50, 100, 200], "depth": [10, 20, 30], "min_rows": [1, 2, 5]}),
    "xgboost": (boosted_trees, {}, {"rounds": [50, 100, 200], "depth": [3, 5, 7], "rate": [0.01, 0.1, 0.3]}),
}


def register_classifier(name: str, make: Maker, defaults: dict | None = None, grid: dict | None = None) -> None:
    _classifiers[name] = (make, defaults or {}, grid or {})


def grid_of(name: str) -> dict:
    return _classifiers[name][2]


@dataclass
class Classifier:
    """train, predict, evaluate and train_and_evaluate under one name; without ``settings`` those it is registered with."""

    name: str
    settings: dict | None = None
    model: object | None = None
    labels: list | None = None

    lift: Callable[[DataFrame], DataFrame] | None = None

    def train(self, points: DataFrame) -> Classifier:
        if self.name not in _classifiers:
            raise ValueError(f"unknown classifier: {self.name}")
        make, defaults, _ = _classifiers[self.name]
        settings = dict(self.settings or defaults)
        gamma = settings.pop("gamma", None)
        self.lift = fourier_map(points, gamma) if gamma is not None else lambda df: df
        kept = vectors(self.lift(points)).persist()
        n = kept.count()
        rows = bare(kept)
        self.labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
        self.model = make(n, **settings).fit(rows.coalesce(max(1, n // ROWS_IN_PART)))
        kept.unpersist()
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        """(id, label, pred)."""
        if self.model is None:
            raise ValueError("the classifier is not trained")
        rows = self.lift(points).withColumns({"features": array_to_vector(doubles("vec")), "weight": F.lit(1.0)})
        names = F.array(*[F.lit(x) for x in self.labels])
        return self.model.transform(rows).select("id", "label", F.get(names, F.col("prediction").cast("int")).alias("pred"))

    def forget(self) -> None:
        """Give back what the model keeps on the executors."""
        if hasattr(self.model, "forget"):
            self.model.forget()

    def evaluate(self, points: DataFrame) -> DataFrame:
        return bundle(confusion(self.predict(points), "label", "pred"))

    def train_and_evaluate(self, split: DataFrame) -> DataFrame:
        return self.train(split.where("NOT is_test")).evaluate(split.where("is_test"))


#: Fits of a grid search that run at a time.
AT_A_TIME = 8


def grid_search(points: DataFrame, name: str, grid: dict | None = None, folds: int = 5) -> DataFrame:
    """(settings, cv_mean, cv_std, rank): balanced accuracy of every setting over stratified folds, best first.

    Multinomial regressions are fitted all at once; other classifiers AT_A_TIME.
    """
    grid = grid or _classifiers[name][2]
    rows = stratified_folds(points, "label", "id", folds)
    if _classifiers[name][0] is logistic and set(grid) == {"c"}:
        counts, cells, _ = linear.fit_grid(rows, (), list(grid["c"]), list(range(folds)))
        scored = bundle(counts, ("cell",)).collect()  # a row for each setting and fold
        scores = [(repr({"c": cells[r["cell"]].c}), cells[r["cell"]].fold, r["balanced_accuracy"]) for r in scored]
        counts.unpersist()
    else:
        scores = _fit_each(rows.persist(), name, grid, folds)
    table = points.sparkSession.createDataFrame(scores, "settings string, fold int, score double")
    means = table.groupBy("settings").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cv_mean"), "settings")))


def _fit_each(rows: DataFrame, name: str, grid: dict, folds: int) -> list[tuple[str, int, float]]:
    rows.count()

    def score(cell: tuple[dict, int]) -> tuple[str, int, float]:
        settings, fold = cell
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        trained = Classifier(name, settings).train(train)
        found = trained.evaluate(test).first()["balanced_accuracy"]
        trained.forget()
        return repr(settings), fold, found

    cells = [(dict(zip(grid, values, strict=True)), fold) for values in product(*grid.values()) for fold in range(folds)]
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        scores = list(pool.map(inheritable_thread_target(rows.sparkSession)(score), cells))
    rows.unpersist()
    return scores


def search_and_refit(points: DataFrame, name: str, grid: dict | None = None, folds: int = 5) -> tuple[Classifier, DataFrame]:
    """The classifier with the best settings of :func:`grid_search`, trained on all ``points``, and the scores."""
    scores = grid_search(points, name, grid, folds)
    best = ast.literal_eval(scores.where("rank = 1").first()["settings"])
    return Classifier(name, best).train(points), scores


def knn_metrics(split: DataFrame, k: int = 5) -> DataFrame:
    found = nearest(split.where("is_test"), split.where("NOT is_test"), k)
    return bundle(confusion(vote(found, [k]), "label", "pred"))


def bake_off(points: DataFrame, names: tuple[str, ...] = tuple(_classifiers)) -> DataFrame:
    """(classifier, metrics) of kNN and the named classifiers, all by default, on one stratified split without rare labels."""
    kept = stratified_split(drop_rare(points, "label"), "label", "id").persist()
    kept.count()
    split = bare(kept)

    def row(name: str) -> pa.Table:
        made = Classifier(name)
        scores = knn_metrics(split) if name == "knn" else made.train_and_evaluate(split)
        found = scores.withColumn("classifier", F.lit(name)).toArrow()
        made.forget()
        return found

    with ThreadPoolExecutor(AT_A_TIME) as pool:
        rows = list(pool.map(inheritable_thread_target(points.sparkSession)(row), ("knn", *names)))  # a row for each
    kept.unpersist()
    return points.sparkSession.createDataFrame(pa.concat_tables(rows))
