"""Reports, plot data and what runs over several corpora, on tables that can be checked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import fusion, metrics, ranking
from chorale.plans import pipelines, reports
from chorale.sources import audio


@pytest.fixture
def corpora(tmp_path):
    for key, n in {"apes/AL/a.wav": 8000, "apes/AL/b.wav": 8000, "apes/BE/c.wav": 16000, "finch/HPi1_day-DC.wav": 8000, "finch/HPi1_day-Te.wav": 8000, "finch/Bla2_x-DC.wav": 8000}.items():
        at = tmp_path / key
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(audio.encode_wav(np.sin(np.arange(n) / 7), 8000 if n == 8000 else 16000))
    return {"apes": str(tmp_path / "apes"), "finch": str(tmp_path / "finch")}


def test_layouts_headers_and_subsets(spark, corpora):
    files = audio.scan_corpora(spark, corpora, {"finch": "name"})
    got = {(r["dataset"], r["file_key"]): (r["label"], r["call_type"]) for r in files.collect()}
    assert got["apes", "AL/a.wav"] == ("AL", None) and got["finch", "HPi1_day-Te.wav"] == ("HPi1", "Te") and len(got) == 6
    kinds = {r["dataset"]: (r["sample_rates"], r["channels"], r["n_files"]) for r in audio.header_kinds(audio.headers(files), "dataset").collect()}
    assert kinds == {"apes": ([8000, 16000], [1], 3), "finch": ([8000], [1], 3)}
    clips, manifests = pipelines.subsets(spark, corpora, 1, layouts={"finch": "name"})
    assert clips.groupBy("dataset", "label").count().where("count > 1").count() == 0 and clips.count() == 4
    made = {r["dataset"]: r for r in manifests.collect()}
    assert made["apes"]["total_files"] == 2 and made["finch"]["individuals"]["HPi1"]["num_files"] == 1
    with pytest.raises(ValueError):
        audio.labelled(files, "elsewhere")


def test_lines(spark):
    counts = spark.createDataFrame([("a", "a", 8), ("b", "a", 1), ("b", "b", 1)], "y_true string, y_pred string, n long")
    lines = {r["place"]: r["line"] for r in reports.classification_lines(metrics.report(counts)).collect()}
    assert set(lines) == {"a", "b", "macro avg", "weighted avg"} and lines["b"].split() == ["b", "1.0000", "0.5000", "0.6667", "2"]
    sweep = spark.createDataFrame([(3, 0.5, 0.1, 0.6), (5, 0.7, 0.2, 0.8)], "k int, cv_mean double, cv_std double, accuracy double")
    told = {r["place"]: r["line"] for r in reports.sweep_lines(sweep, "k").collect()}
    assert told[5].endswith("*") and not told[3].endswith("*") and "cv 0.5000 +- 0.1000" in told[3]
    assert sorted(map(tuple, reports.sweep_points(sweep, "k").collect())) == [(3, 0.5, 0.1, 0.6), (5, 0.7, 0.2, 0.8)]
    corpus = spark.createDataFrame([("AL", 12, 1.5, 0.5, 2.0, 7200.0)], "who string, n_files long, avg_duration double, min_duration double, max_duration double, total_duration double")
    assert reports.corpus_lines(corpus, "who").first()["line"].split() == ["AL", "12", "files", "avg", "1.50", "s", "min", "0.50", "s", "max", "2.00", "s", "total", "2.00", "h"]


def test_plot_data(spark):
    layout = spark.createDataFrame([(float(i), 0.0, f"c{i}") for i in range(5)], "x double, y double, label string")
    assert {r["label"] for r in reports.scatter_points(layout, 4).collect()} == {None} and reports.scatter_points(layout, 5).where("label IS NULL").count() == 0
    long = spark.createDataFrame([(0, "knn_accuracy", 0.5), (0, "silhouette", 0.1), (1, "knn_accuracy", 0.75)], "layer int, metric string, value double")
    assert sorted(map(tuple, reports.wide_metrics(long, ["knn_accuracy", "silhouette"]).collect())) == [(0, 0.5, 0.1), (1, 0.75, None)]
    other = spark.createDataFrame([(1, "knn_accuracy", 0.25), (2, "logreg_accuracy", 0.5)], "layer int, metric string, value double")
    both = {(r["metric"], r["layer"]): (r["small"], r["large"]) for r in ranking.compare_metrics({"small": long, "large": other}).collect()}
    assert both == {("knn_accuracy", 0): (0.5, None), ("silhouette", 0): (0.1, None), ("knn_accuracy", 1): (0.75, 0.25), ("logreg_accuracy", 2): (None, 0.5)}


def test_grids_and_views_over_corpora(spark):
    cells = spark.createDataFrame([("apes", "base", 0, 0.5), ("apes", "base", 1, 0.75), ("apes", "large", 0, 0.25), ("finch", "base", 0, 0.5)], "dataset string, model string, layer int, value double").withColumn("metric", F.lit("knn_accuracy"))
    got = {(r["dataset"], r["model"]): (r["layer"], r["value"]) for r in pipelines.best_grid(cells, "knn_accuracy").collect()}
    assert got == {("apes", "base"): (1, 0.75), ("apes", "large"): (0, 0.25), ("finch", "base"): (0, 0.5), ("finch", "large"): (None, 0.0)}
    rng = np.random.default_rng(1)
    rows = [(d, "base", layer, "mean", f"{d}{i}", f"c{i % 2}", rng.normal(size=4).tolist()) for d in ("apes", "finch") for layer in (0, 1) for i in range(8)]
    features = spark.createDataFrame(rows, "dataset string, model string, layer int, method string, file_key string, label string, vec array<double>")
    seen = pipelines.views(features, "pca", [1]).toPandas()
    assert len(seen) == 16 and set(seen["layer"]) == {1} and seen["error"].isna().all() and set(seen["id"]) == {r[4] for r in rows}


def test_fusion_factories(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0 * i * i]) for i in range(4)], "file_key int, vec array<double>")
    assert sorted(fusion.simple_fusion().fit_transform({"a": df, "b": df}).collect())[3]["vec"] == [3.0, 9.0, 3.0, 9.0]
    assert len(fusion.pca_fusion({"a": 1, "b": 2}).fit_transform({"a": df, "b": df}).first()["vec"]) == 3
    assert fusion.weighted_fusion().fit({"a": df, "b": df}).weights == {"a": 1.0, "b": 1.0} and fusion.layer_fusion([0, 1], "mean").method == "mean"
