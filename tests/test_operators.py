"""Hand-computed cases and invariants of the operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import labels
from chorale.operators import clustering, fusion, layers, metrics, models, neighbors, pooling, ranking, reduction, sampling, scaling, stats, waveform
from chorale.plans import pipelines, reports


def nested(spark, frames, method):
    df = spark.createDataFrame([(frames,)], "f array<array<double>>")
    return df.select(pooling.pool_nested(F.col("f"), method).alias("v")).first()["v"]


TINY = [[1.0, 2.0], [3.0, 6.0], [5.0, 4.0]]


@pytest.mark.parametrize(("method", "want"), [("mean", [3, 4]), ("max", [5, 6]), ("first", [1, 2]), ("last", [5, 4]), ("mean_std", [3, 4, math.sqrt(8 / 3), math.sqrt(8 / 3)])])
def test_pooling_by_hand(spark, method, want):
    assert nested(spark, TINY, method) == pytest.approx(want)
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(TINY)], "k string, t int, vec array<double>")
    got = pooling.pool_frames(rows, ["k"], "t", methods=(method,)).orderBy("dim").collect()
    assert [r["x"] for r in got] == pytest.approx(want)


def test_pooling_edges(spark):
    for m in ("mean", "max", "weighted"):
        assert nested(spark, [[2.0, 0.0]] * 4, m) == pytest.approx([2, 0])
    for m in ("mean", "max", "first", "last", "weighted"):
        assert nested(spark, [[7.0, -1.0]], m) == pytest.approx([7, -1])
    assert nested(spark, [], "mean") is None
    assert nested(spark, [[1000.0, 0.0], [0.0, 1.0]], "weighted") == pytest.approx([1000, 0])
    with pytest.raises(ValueError):
        pooling.pool_nested(F.col("f"), "median")
    rows = spark.createDataFrame([("a", 0, [1.0], 0.5), ("a", 1, [3.0], 2.0)], "k string, t int, vec array<double>, w double")
    assert pooling.pool_frames(rows, ["k"], "t", methods=("weighted",), weights="w").first()["x"] == pytest.approx(6.5)


def test_layers_by_hand(spark):
    df = spark.createDataFrame([("a", 0, [6.0]), ("a", 1, [3.0]), ("a", 2, [0.0])], "k string, layer int, vec array<double>")
    got = {m: layers.combine_layers(df, ["k"], m, [0, 1, 2]).first()["vec"] for m in ("mean", "max", "weighted_mean", "concatenation")}
    assert got["mean"] == [3] and got["max"] == [6] and got["weighted_mean"] == pytest.approx([45 / 11]) and got["concatenation"] == [6, 3, 0]
    assert layers.combine_layers(df, ["k"], "concatenation", [2, 0]).first()["vec"] == [0, 6]
    assert layers.select_layers(13, "early_middle_late") == [0, 6, 12]
    assert layers.select_layers(13, "middle") == [5, 6, 7]
    assert layers.select_layers(13, "late") == [10, 11, 12] and layers.select_layers(13, "early") == [0, 1, 2]
    for bad in (lambda: layers.select_layers(3, "specified"), lambda: layers.select_layers(3, "odd"), lambda: layers.combine_layers(df, ["k"], "sum", [0]), lambda: layers.check_layers(df, ["k"], [0, 5]), lambda: layers.combine_layers(df, ["k"], "weighted_mean", [0, 1], {0: 1.0})):
        with pytest.raises(ValueError):
            bad()
    scores = spark.createDataFrame([(0, 1.0), (1, 3.0)], "layer int, score double")
    assert sorted(r[0] for r in scores.select(layers.weights_from_scores(F.col("score"))).collect()) == [0.25, 0.75]


def test_fusion(spark):
    assert fusion.fusion_weights([2, 6]) == pytest.approx([2, 2 / 3])
    a = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "file_key int, vec array<double>")
    scaled = [r["vec"] for r in fusion.Standardiser().fit(a).transform(a).orderBy("file_key").collect()]
    assert np.mean(scaled, axis=0) == pytest.approx([0, 0]) and np.std(scaled, axis=0) == pytest.approx([1, 0])
    b = a.where("file_key > 0")
    assert fusion.Fusion("concatenation", normalise=False).fit_transform({"a": a, "b": b}).count() == 3
    for bad in (lambda: fusion.Fusion("sum"), lambda: fusion.Fusion("pca_fusion"), lambda: fusion.Standardiser().transform(a)):
        with pytest.raises(ValueError):
            bad()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) * [5, 2, 1, 0.1]
    p = fusion.CentredPCA(2).fit(spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>"))
    assert p.explained[0] >= p.explained[1] > 0


def conf(spark, pairs):
    return metrics.confusion(spark.createDataFrame(pairs, "t string, p string"), "t", "p")


def test_metrics_by_hand(spark):
    m = metrics.bundle(conf(spark, [("a", "a")] * 8 + [("b", "a"), ("b", "b")])).first()
    assert m["accuracy"] == pytest.approx(0.9) and m["balanced_accuracy"] == pytest.approx(0.75) and m["macro_f1"] == pytest.approx((16 / 17 + 2 / 3) / 2)
    m = metrics.bundle(conf(spark, [("a", "a"), ("a", "c")])).first()
    assert m["balanced_accuracy"] == pytest.approx(0.5) and m["macro_recall"] == pytest.approx(0.25) and m["n_classes"] == 1
    assert {r["label"]: r["f1"] for r in metrics.per_class(conf(spark, [("a", "a"), ("a", "c")])).collect()}["c"] == 0
    assert metrics.matrix(conf(spark, [("a", "b")]), ["a", "b"]).first().asDict() == {"y_true": "a", "a": 0, "b": 1}


def test_clusters_by_hand(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [10.0]), (3, 1, [11.0])], "id int, label int, vec array<double>")
    assert clustering.calinski_harabasz(df).first()["score"] == pytest.approx(200)
    assert clustering.davies_bouldin(df).first()["score"] == pytest.approx(0.1)
    assert clustering.silhouette_euclidean(df).first()["silhouette"] == pytest.approx(0.8997, abs=1e-4)


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=5).tolist()) for i in range(40)], "id int, label int, vec array<double>")
    key = lambda d: sorted((r["id"], r["rank"], r["neighbour"]) for r in d.collect())
    assert key(neighbors.nearest(df, df, 4)) == key(neighbors.nearest(df, df, 4, block=7))
    one, many = (neighbors.cluster_distances(df, block=b).orderBy("id", "other").toPandas() for b in (4096, 9))
    assert np.allclose(one["total"], many["total"]) and (one["n"] == many["n"]).all()


def test_vote_ties_go_to_the_smallest_label(spark):
    train = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [1.0, 0.2]), (4, "a", [1.0, 0.3])], "id int, label string, vec array<double>")
    test = spark.createDataFrame([(9, "a", [1.0, 0.0])], "id int, label string, vec array<double>")
    assert neighbors.vote(neighbors.nearest(test, train, 4), [4]).first()["pred"] == "a"


def test_split_and_folds(spark):
    df = spark.createDataFrame([(i, i % 4 if i < 40 else 9) for i in range(43)], "id int, label int")
    split = sampling.stratified_split(df, "label", "id").toPandas()
    assert len(split) == 43 and split.groupby("label")["is_test"].sum().to_dict() == {0: 2, 1: 2, 2: 2, 3: 2, 9: 1}
    folds = sampling.stratified_folds(df, "label", "id", 5).toPandas()
    assert set(folds["fold"]) == set(range(5))
    assert sampling.drop_rare(df, "label", 4).count() == 40
    assert sampling.sample_per_group(df, "label", "id", 2).count() == 10
    w = sampling.class_weights(df, "label").select("label", "weight").distinct().toPandas().set_index("label")["weight"]
    assert w[0] == pytest.approx(43 / (5 * 10)) and w[9] == pytest.approx(43 / (5 * 3))


def test_ranking(spark):
    m = spark.createDataFrame([(0, "acc", 0.5), (1, "acc", 0.9), (2, "acc", None), (0, "davies_bouldin", 3.0), (1, "davies_bouldin", 1.0), (2, "davies_bouldin", 1.0), (0, "flat", 1.0), (1, "flat", 1.0), (0, "knn_best_k", 3.0)], "layer int, metric string, value double")
    rank = {(r["metric"], r["layer"]): r["rank"] for r in ranking.rank_layers(m).collect()}
    assert [rank["acc", i] for i in (1, 0, 2)] == [1, 2, 3] and [rank["davies_bouldin", i] for i in (1, 2, 0)] == [1, 2, 3]
    scaled = {(r["metric"], r["layer"]): r["scaled"] for r in ranking.min_max(m).collect()}
    assert scaled["acc", 1] == 1 and scaled["davies_bouldin", 0] == 0 and scaled["flat", 0] is None and ("knn_best_k", 0) not in scaled
    assert ranking.best_layer(m, "davies_bouldin").first()["layer"] == 1


def test_labels(spark):
    paths = ["AL/x.wav", "HPi4748_MON_1-DC.wav", "noext", "a/b/c.wav"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(labels.label_from_path(F.col("p"))).collect()] == ["AL", "HPi4748", "noext", "b"]
    assert [r[0] for r in df.select(labels.call_type(labels.stem(F.col("p")))).collect()] == [None, "DC", None, None]
    assert len(labels.mfcc_names()) == 26 and len(labels.spectral_names()) == labels.spectral_dim() == 24 and len(labels.PROSODIC) == 26


def test_waveforms(spark):
    v = lambda x, m: spark.createDataFrame([(x,)], "v array<double>").select(waveform.normalise(F.col("v"), m).alias("o")).first()["o"]
    assert v([0.5, -2.0], "peak") == [0.25, -1] and v([0.0, 0.0], "peak") == [0, 0] and v([0.0], "rms") == [0]
    assert v([3.0, 4.0], "rms") == pytest.approx([3 / math.sqrt(12.5), 4 / math.sqrt(12.5)])
    with pytest.raises(ValueError):
        waveform.normalise(F.col("v"), "loud")
    df = spark.createDataFrame([(x,) for x in (0.0999, 0.1, 10.0, 10.0001)], "s double")
    assert df.where(waveform.duration_ok(F.col("s"))).count() == 2
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "c array<array<double>>").select(waveform.mono(F.col("c")).alias("m")).first()["m"]
    assert m == [2, 3]


def test_framing_and_totals(spark):
    df = spark.createDataFrame([("a", t, float((-1) ** t)) for t in range(10)], "k string, t int, x double")
    out = stats.framed(df, ["k"], "t", "x", 4, 2).orderBy("frame").collect()
    assert [r["frame"] for r in out] == [0, 1, 2, 3] and all(r["rms"] == 1 and r["zcr"] == 0.75 for r in out)
    t = stats.totals(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, ok boolean"), "g", "ok").collect()
    assert {r["g"]: (r["n_ok"], r["n_all"]) for r in t} == {"a": (1, 2), "b": (1, 1), None: (2, 3)}


def separable(spark, n=90):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, f"c{i % 3}", (rng.normal(size=4) + 6 * np.eye(4)[i % 3]).tolist()) for i in range(n)], "id int, label string, vec array<double>")


@pytest.mark.parametrize("name", ["linear_probe", "svm_linear", "random_forest", "svm_rbf"])
def test_models_learn_what_can_be_learnt(spark, name):
    split = sampling.stratified_split(separable(spark), "label", "id")
    assert models.Classifier(name).train_and_evaluate(split).first()["balanced_accuracy"] > 0.9


def test_model_errors(spark):
    with pytest.raises(ValueError):
        models.Classifier("oracle").train(separable(spark, 9))
    with pytest.raises(ValueError):
        models.Classifier("svm_linear").predict(separable(spark, 9))


def test_scaling_skips_what_is_not_there(spark):
    out = scaling.scaling_study(separable(spark, 60), [2, 3, 4], trials=2, k=3).toPandas()
    assert sorted(out["n"]) == [2, 3] and (out["accuracy_mean"] > 0.8).all() and (out["trials"] == 2).all()


def test_boosted_trees_and_forest_defaults_are_whole(spark):
    split = sampling.stratified_split(separable(spark, 60), "label", "id")
    assert models.Classifier("xgboost", {"rounds": 2, "depth": 2}).train_and_evaluate(split).first()["balanced_accuracy"] > 0.9
    forest = models.random_forest(10)
    boosted = models.boosted_trees(10)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 30) and (boosted.rounds, boosted.depth, boosted.rate) == (100, 5, 0.1)


def test_grid_search_ranks_and_refits(spark):
    points = separable(spark, 60)
    best, scores = models.search_and_refit(points, "linear_probe", {"c": [1e-6, 1.0]}, folds=2)
    rows = scores.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["settings"] == repr(best.settings) and rows[0]["cv_mean"] >= rows[1]["cv_mean"]
    assert best.evaluate(points).first()["accuracy"] > 0.9
    two = models.search_and_refit(points, "svm_rbf", {"c": [1.0], "gamma": ["auto", 0.1]}, folds=2)
    assert two[1].count() == 2 and "gamma" in two[0].settings


def test_bake_off_and_comprehensive(spark):
    points = separable(spark, 45)
    assert set(models._classifiers) == {"linear_probe", "logistic_regression", "svm_linear", "svm_rbf", "random_forest", "xgboost"}
    out = models.bake_off(points, ("logistic_regression",)).toPandas()
    assert sorted(out["classifier"]) == ["knn", "logistic_regression"] and (out["balanced_accuracy"] > 0.9).all()
    stored = points.select(F.lit("d").alias("dataset"), F.lit("m").alias("model"), F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"), F.lit("mean").alias("method"), F.col("id").cast("string").alias("file_key"), "label", "vec")
    stored = stored.withColumn("vec", F.when(F.col("layer") == 1, F.col("vec")).otherwise(F.transform("vec", lambda x: F.lit(1.0) + 0 * x)))
    got = pipelines.comprehensive(stored, ("logistic_regression",)).toPandas()
    assert set(got["layer"]) == {1} and sorted(got["classifier"]) == ["knn", "logistic_regression"]
    sets = points.select(F.explode(F.array(F.lit("mfcc"), F.lit("spectral"))).alias("feature_type"), F.col("id").cast("string").alias("file_key"), "label", "vec")
    table = reports.bakeoff_table(pipelines.evaluate_sets(sets, ("logistic_regression",))).toPandas()
    assert sorted(table["features"]) == ["mfcc", "spectral"] and {"knn", "logistic_regression", "best"} <= set(table.columns)


def test_layer_comparison_has_every_column(spark):
    rows = separable(spark, 45).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    out = pipelines.compare_layers(rows, ks=(3,), probes=pipelines.PROBES, grid={"c": [1.0]}, folds=2).toPandas()
    want = {"silhouette", "calinski_harabasz", "davies_bouldin"} | {f"{p}_{m}" for p in ("knn", "linear_probe", "logreg") for m in ("accuracy", "balanced_accuracy", "macro_f1")} | {"knn_best_k", "linear_probe_best_C", "logreg_best_C"}
    assert set(out["metric"]) == want and len(out) == 2 * len(want)
    lines = reports.overall_lines(spark.createDataFrame(out)).orderBy("place").collect()
    assert [r["line"].split(" (")[0] for r in lines] == ["k-NN", "Linear Probe", "Logistic Regression"]


def test_contributions_fail_to_nought(spark):
    one = spark.createDataFrame([(0, i, "only", [float(i), 1.0]) for i in range(4)], "layer int, id int, label string, vec array<double>")
    assert [layers.layer_contributions(one, m).first()["score"] for m in layers.CONTRIBUTIONS] == [0, 0, 0]
    with pytest.raises(ValueError):
        layers.layer_contributions(one, "entropy")
    with pytest.raises(ValueError):
        layers.combine_layers(one, ["id"], "mean", [0, 1])


def test_cluster_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 7, rng.normal(size=5).tolist()) for i in range(60)], "id int, label int, vec array<double>")
    scores = lambda: (clustering.silhouette_cosine(df).first()[0], clustering.davies_bouldin(df).first()[0])
    whole = scores()
    monkeypatch.setattr(clustering, "LABELS", 3)
    monkeypatch.setattr(clustering, "BLOCK", 16)
    assert scores() == pytest.approx(whole)


def test_layouts_have_every_point(spark):
    df = separable(spark, 60).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    for method, options in (("tsne", {"steps": 120, "perplexity": 5}), ("umap", {"epochs": 60, "neighbours": 6}), ("other", {})):
        out = reduction.layout_2d(df, method, ("layer",), most=30, **options).toPandas()
        assert len(out) == 120 and out["error"].isna().all() and np.isfinite(out[["x", "y"]].to_numpy()).all()
        if method == "umap":  # those placed by landmarks lie with their own
            for _, g in out.groupby("layer"):
                at = g[["x", "y"]].to_numpy()
                centres = np.stack([at[(g["label"] == c).to_numpy()].mean(0) for c in ("c0", "c1", "c2")])
                assert (np.linalg.norm(at[:, None] - centres, axis=2).argmin(1) == g["label"].str[1].astype(int)).mean() > 0.85


def test_classifier_scaling(spark):
    out = scaling.compare_scaling({"a": separable(spark, 45)}, [2, 3], {"knn": scaling.scaling_study, "logistic": scaling.classifier_study("logistic_regression")}, trials=1).toPandas()
    assert sorted(zip(out["classifier"], out["n"], strict=True)) == [("knn", 2), ("knn", 3), ("logistic", 2), ("logistic", 3)] and (out["accuracy_mean"] > 0.8).all()


def test_places_are_those_of_a_window(spark):
    """A label with two thirds of all rows, one row alone, and null, by plain sorting; many tasks share the large label."""
    import hashlib

    rows = [(i, "hot" if i % 3 else "one" if i == 0 else None if i % 2 else f"c{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, label string").repartition(5)
    got = {(r["label"], r["id"]): (r["_place"], r["_total"]) for r in sampling.placed(df, ["label"], "id", sampling.hash_order("id"), digits=2).collect()}
    want = {}
    for label in {x for _, x in rows}:
        own = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, x in rows if x == label)
        want |= {(label, i): (k + 1, len(own)) for k, (_, i) in enumerate(own)}
    assert got == want
    split = sampling.stratified_split(df, "label", "id").toPandas()
    assert split["is_test"].sum() == sum(-(-2 * n // 10) for n in Counter(x for _, x in rows).values())


def test_sql_functions_equal_the_dataframe_forms(spark, sf_dir):
    from chorale.functions import lateral
    from chorale.plans.queries import QUERIES

    base = QUERIES["mfcc_features"](spark, sf_dir).select("id", "vec").orderBy("id").limit(20).collect()
    rows = QUERIES["sql_mfcc"](spark, sf_dir).where(F.col("id") <= base[-1]["id"]).toPandas()
    for r in base:
        assert np.allclose(np.stack(rows[rows["id"] == r["id"]].sort_values("frame")["vec"]).mean(0), r["vec"], atol=1e-3)
    lateral.register(spark)
    assert spark.sql("SELECT * FROM wave_frames(NULL, 4, 2)").count() == 0 and spark.sql("SELECT * FROM pool_frames(array(), 'mean')").count() == 0
    with pytest.raises(Exception, match="unknown pooling"):
        spark.sql("SELECT * FROM pool_frames(array(array(1D)), 'sum')").collect()


def test_stored_sets_join_without_a_shuffle(spark, tmp_path):
    from chorale.sources import tables

    points = separable(spark, 60).select(F.col("id").cast("string").alias("file_key"), "label", "vec")
    for k, name in enumerate(("stored_a", "stored_b")):
        tables.store_set(points.withColumn("vec", F.transform("vec", lambda x: x + k)), name, buckets=4, path=str(tmp_path / name))
    sets = {k: v.select("file_key", "vec") for k, v in tables.stored_sets(spark, {"a": "stored_a", "b": "stored_b"}).items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fused = fusion.Fusion("concatenation").fit_transform(sets)
        plan = fused._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        assert fused.count() == 60 and len(fused.first()["vec"]) == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("stored_a", "stored_b"):
            spark.sql(f"DROP TABLE {name}")


def test_zero_crossings_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """A value that equals its user's mean is on the side that the sum in order of time puts it, whatever order the file has."""
    from datetime import datetime

    from chorale.plans.queries import QUERIES

    values = [(0.1, 0.3, 0.2), (0.2, 0.3, 0.1), (0.7, 0.1, 0.4)] * 20
    rows = [(3 * u + t, datetime(2024, 1, 1, 0, 0, t), u, v) for u, vs in enumerate(values) for t, v in enumerate(vs)]
    found = []
    for name, some in (("ahead", rows), ("back", rows[::-1])):
        spark.createDataFrame(some, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        found.append([tuple(r) for r in QUERIES["event_duration_zcr"](spark, f"{tmp_path}/{name}").orderBy("user_id").collect()])
    assert found[0] == found[1]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_equals_a_plain_loop_over_many_tiles(spark, monkeypatch, metric):
    """Equal points, repeated in many tiles, are told apart by their ids; a whole matrix of distances says the same."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 5)), 2)
    x[::7] = x[0]
    n = 3 * len(x)
    df = spark.createDataFrame([(i, i % 4, x[i % len(x)].tolist()) for i in range(n)], "id long, label int, vec array<double>")
    x = np.tile(x, (3, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1, j) for i in range(n) for r, j in enumerate(sorted(range(n), key=lambda j: (d[i, j], j))[:4])}
    monkeypatch.setattr(neighbors, "TILE_FIRST", 8)
    for block in (40, 1000):
        got = {tuple(r) for r in neighbors.nearest(df, df, 4, metric=metric, block=block).select("id", "rank", "neighbour").collect()}
        assert got == want


def test_summary_reads_the_metrics_once(spark):
    metrics_of = spark.range(12).selectExpr("cast(id % 4 as int) layer", "concat('knn_', array('accuracy', 'balanced_accuracy', 'macro_f1')[int(id / 4)]) metric", "id / 12 value")
    for lines in (reports.overall_lines(metrics_of), reports.metric_lines(metrics_of)):
        assert lines._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_trials_split_a_label_once_for_all_sizes(spark, monkeypatch):
    """What is shuffled for the split are points x trials, not points x trials x sizes."""
    sizes, points = [], separable(spark, 60)
    plain = scaling.placed
    monkeypatch.setattr(scaling, "placed", lambda df, *rest: (sizes.append(df.count()), plain(df, *rest))[1])
    chosen = scaling.choose(points, [2, 3], trials=2)
    rows = scaling.split_trials(points, chosen).toPandas()
    assert sizes[0] <= 120 and len(rows) == sum(points.where(F.col("label") == r["label"]).count() for r in chosen.collect())
    assert rows.groupby(["trial", "id"])["is_test"].nunique().max() == 1


def test_table_functions_hold_few_clips(spark, monkeypatch):
    from chorale.functions import lateral

    class Probe:
        def eval(self, samples):
            import resource

            yield (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,)

    monkeypatch.setitem(lateral.FUNCTIONS, "probe", (Probe, "mb double"))
    lateral.register(spark)
    clips = spark.range(0, 4000, 1, 1).selectExpr("array_repeat(id + 0.5D, 16384) samples")
    assert spark.sql("SELECT max(p.mb) FROM {clips} c, LATERAL probe(c.samples) p", clips=clips).first()[0] < 1000


def test_points_reach_their_blocks_by_a_shuffle(spark):
    from chorale.operators import linear

    plan = linear.to_blocks(separable(spark, 60).withColumn("fold", F.lit(0)), ()).frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Coalesce" not in plan
