"""Boosting and linear fits against plain numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import fusion, linear, models, projection
from chorale.operators.boosting import Boosting, histograms


def cloud(n=160, width=5, labels=3, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, labels, n)
    x = rng.normal(size=(n, width)) + 3 * np.eye(labels, width)[y]
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, f"c{k}", float(k), v.tolist()) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, label string, y double, vec array<double>").repartition(parts)


def plain_tree(bins, g, h, depth, rate, l2, least, n_bins):
    """Score of each point by one tree, grown point set by point set."""
    out = np.zeros(len(g))

    def grow(rows, left_levels):
        whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        best = (1e-9, None)
        if left_levels:
            for d in range(bins.shape[1]):
                for b in range(n_bins - 1):
                    low = rows[bins[rows, d] <= b]
                    high = rows[bins[rows, d] > b]
                    if h[low].sum() >= least and h[high].sum() >= least:
                        gain = (g[low].sum() ** 2 / (h[low].sum() + l2) + g[high].sum() ** 2 / (h[high].sum() + l2) - whole) / 2
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
        if best[1] is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        else:
            for part in best[1]:
                grow(part, left_levels - 1)

    grow(np.arange(len(g)), depth)
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_boosting_equals_a_plain_loop(spark, parts):
    x, y = cloud()
    boosting = Boosting(rounds=12, depth=3, rate=0.3, n_bins=8)
    model = boosting.fit(frame(spark, x, y, parts))
    bins = model.bins(x)
    f = np.zeros((len(y), 3))
    for _ in range(12):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        g, h = p - np.eye(3)[y], 2 * p * (1 - p)
        f = f + np.stack([plain_tree(bins, g[:, k], h[:, k], 3, 0.3, 1.0, 1.0, 8) for k in range(3)], axis=1)
    assert np.allclose(model.scores(bins), f, atol=1e-9)
    told = model.transform(frame(spark, x, y)).select("y", "prediction").toPandas()
    assert (told["prediction"] == told["y"]).mean() == (f.argmax(axis=1) == y).mean() > 0.9


def test_boosting_of_one_label_and_constant_dimensions(spark):
    x, y = np.ones((20, 3)), np.zeros(20, int)
    model = Boosting(rounds=2).fit(frame(spark, x, y))
    assert np.allclose(model.scores(model.bins(x)).argmax(axis=1), 0) and all((t.dim == -1).all() for t in model.rounds)
    x, y = cloud(200, 4, 2)
    got = models.Classifier("xgboost", {"rounds": 20, "depth": 3}).train(frame(spark, x, y).select("id", "label", "vec"))
    assert got.evaluate(frame(spark, x, y).select("id", "label", "vec")).first()["balanced_accuracy"] > 0.9


def cells_of(spark, seeds=(1, 2), folds=3):
    """Two layers of points with folds, a fifth of them for tests."""
    rows = []
    for layer, seed in enumerate(seeds):
        x, y = cloud(150, 4, 3, seed)
        rows += [(layer, i, f"c{k}", (x[i] * 0.4).tolist(), linear.TEST if i % 5 == 0 else i % folds) for i, k in enumerate(y)]
    return rows, spark.createDataFrame(rows, "layer int, id long, label string, vec array<double>, fold int").repartition(3)


def test_many_fits_equal_single_ones(spark):
    rows, points = cells_of(spark)
    counts, cells, groups = linear.fit_grid(points, ("layer",), [0.01, 1.0], [0, 1, 2, linear.TEST])
    assert groups == [(0,), (1,)] and len(cells) == 2 * 4 * 2
    got = {}
    for r in counts.collect():
        got.setdefault(r["cell"], {})[r["y_true"], r["y_pred"]] = r["n"]
    for k in (0, 5, 8, 15):
        cell = cells[k]
        own = [r for r in rows if r[0] == cell.group]
        train = spark.createDataFrame([r[1:4] for r in own if r[4] not in (cell.fold, linear.TEST)], "id long, label string, vec array<double>")
        test = spark.createDataFrame([r[1:4] for r in own if r[4] == cell.fold], "id long, label string, vec array<double>")
        assert train.count() == cell.rows
        single = models.Classifier("logistic_regression", {"c": cell.c}).train(train).predict(test).groupBy("label", "pred").count().collect()
        assert {(r["label"], r["pred"]): r["count"] for r in single} == got[k]


def test_minimum_is_flat_and_the_same_for_each_cell_alone(spark):
    _, points = cells_of(spark)
    blocks = linear.to_blocks(points, ("layer",))
    cells = [linear.Cell(g, f, c, 100) for g in (0, 1) for f in (0, linear.TEST) for c in (0.1, 10.0)]
    size = (blocks.width + 1) * len(blocks.labels)
    together = linear.minimise(lambda k, w: linear.losses(blocks, [cells[i] for i in k], w), len(cells), size)
    f, slope = linear.losses(blocks, cells, together)
    assert np.abs(slope).max() < 1e-6 and (f < np.log(3)).all()
    alone = linear.minimise(lambda k, w: linear.losses(blocks, [cells[3]], w), 1, size)
    assert np.isclose(linear.losses(blocks, [cells[3]], alone)[0][0], f[3], atol=1e-9)
    x = np.random.default_rng(1).normal(size=(len(cells), size))
    e = 1e-6 * np.eye(size)[7]
    up, down = (linear.losses(blocks, cells, x + s * e)[0] for s in (1, -1))
    assert np.allclose((up - down) / 2e-6, linear.losses(blocks, cells, x)[1][:, 7], atol=1e-6)


def test_fits_of_many_partitions_and_of_nothing(spark, monkeypatch):
    _, points = cells_of(spark)
    fit = lambda: sorted(map(tuple, linear.fit_grid(points.repartition(9), ("layer",), [1.0], [linear.TEST])[0].collect()))
    few = fit()
    monkeypatch.setattr(linear, "ROWS_IN_PART", 30)
    assert linear.to_blocks(points.repartition(9), ("layer",)).parts > 4 and fit() == few
    assert linear.fit_grid(points.limit(0), ("layer",), [1.0], [0])[1] == []


def wide(spark, n=60, width=9984, rank=5, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) * np.arange(rank, 0, -1) * 3 @ rng.normal(size=(rank, width)) + 0.01 * rng.normal(size=(n, width)) + 100
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "file_key int, vec array<double>").repartition(3)


def test_wide_vectors_are_projected(spark):
    x, df = wide(spark)
    pca = fusion.CentredPCA(5).fit(df)
    _, values, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((np.array(pca.components) * axes[:5]).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(pca.explained, (values**2 / (values**2).sum())[:5], rtol=1e-6)
    got = {r["file_key"]: r["vec"] for r in pca.transform(df).collect()}
    assert np.allclose([got[i] for i in range(60)], (x - x.mean(0)) @ np.array(pca.components).T, atol=1e-6)
    scaled = {r["file_key"]: r["vec"] for r in fusion.Standardiser().fit(df).transform(df).collect()}
    assert np.allclose([scaled[i] for i in range(60)], (x - x.mean(0)) / x.std(0), atol=1e-6)


def test_sums_in_bands_equal_numpy(spark, monkeypatch):
    x, df = wide(spark, 40, 30)
    monkeypatch.setattr(projection, "BAND", 7)
    monkeypatch.setattr(projection, "BLOCK", 6)
    df = df.repartition(9)
    cov = {(r["i"], r["j"]): r["cov"] for r in projection.covariance(df).collect()}
    want = np.cov(x.T, bias=True)
    assert len(cov) == 30 * 31 // 2 and all(np.isclose(v, want[k], rtol=1e-9) for k, v in cov.items())
    whole, few = projection.principal(df, 3), projection.principal(df, 3, wide=8)
    assert np.allclose(whole[0], few[0], atol=1e-6) and np.allclose(whole[1], few[1])
    n, mean, std = projection.moments(df)
    assert n == 40 and np.allclose(mean, x.mean(0)) and np.allclose(std, x.std(0))
    assert projection.moments(df.limit(0))[0] == 0


def test_sums_of_boosting_stay_on_the_executors(spark):
    """What a level sends to the driver does not grow with dimensions and bins."""
    x, y = np.random.default_rng(5).normal(size=(400, 40)), np.arange(400) % 3
    kind, sent = type(spark.range(1)), []
    plain = kind.collect
    try:
        kind.collect = lambda df: (sent.append((df.columns, rows := plain(df))), rows)[1]
        Boosting(rounds=2, depth=3, rate=0.3, n_bins=32).fit(frame(spark, x, y, 3))
    finally:
        kind.collect = plain
    levels = [rows for columns, rows in sent if "gain" in columns]
    assert levels and max(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)) for rows in levels) < 32 * 3 * 8


def test_plans_of_boosting_do_not_grow(spark):
    """What the driver keeps of a job is as short in the last level as in the first ones."""
    x, y = np.random.default_rng(6).normal(size=(400, 6)), np.arange(400) % 3
    kind, plans = type(spark.range(1)), []
    plain = kind.collect
    try:
        kind.collect = lambda df: (plans.append((df.columns, len(df._jdf.queryExecution().toString()))), plain(df))[1]
        Boosting(rounds=3, depth=4, rate=0.3, n_bins=16).fit(frame(spark, x, y, 3).repartition(3, "label"))
    finally:
        kind.collect = plain
    lengths = [n for columns, n in plans if "gain" in columns]
    assert len(lengths) == 12 and max(lengths) < 1.2 * lengths[1]


def test_histograms_are_sums_over_points():
    rng = np.random.default_rng(7)
    bins, g, h, at = rng.integers(0, 5, (50, 3)).astype(np.uint8), rng.normal(size=(50, 2)), rng.random((50, 2)), rng.integers(3, 7, (50, 2))
    cells = np.array([[0, 3], [0, 5], [1, 3]])
    got = histograms(bins, g, h, at, cells, 5)
    for c, (k, node) in enumerate(cells):
        for d in range(3):
            for b in range(5):
                here = (at[:, k] == node) & (bins[:, d] == b)
                assert np.allclose(got[c, d, b], (g[here, k].sum(), h[here, k].sum()))


@pytest.mark.parametrize("many", [False, True])
def test_classifiers_do_not_see_how_their_points_came_about(spark, monkeypatch, many):
    """The plan of a split, with its windows and joins, is no part of the plans of training, and of a bake-off's predictions."""
    seen = []

    class Told:
        def fit(self, rows):
            seen.append(rows._jdf.queryExecution().toString())
            return self

        def transform(self, rows):
            if many:
                seen.append(rows._jdf.queryExecution().toString())
            return rows.withColumn("prediction", F.lit(0.0))

    x, y = cloud(60)
    points = frame(spark, x, y).select("id", "label", "vec")
    monkeypatch.setitem(models._classifiers, "told", (lambda n: Told(), {}, {}))
    if many:
        assert models.bake_off(points, ("told",)).count() == 2
    else:
        split = models.stratified_split(models.drop_rare(points, "label"), "label", "id")
        assert models.Classifier("told").train_and_evaluate(split).first()["n_samples"] == split.where("is_test").count()
    assert len(seen) == 1 + many and not any("Window" in plan or "Aggregate" in plan for plan in seen)
