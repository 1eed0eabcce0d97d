"""The engine's operators applied to the plain tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import labels as L
from chorale.functions import lateral
from chorale.functions.tables import small
from chorale.functions.vec import long_form, reshape
from chorale.operators import clustering, fusion, layers, metrics, models, neighbors, pooling, projection, ranking, reduction, sampling, scaling, stats, waveform
from chorale.plans import pipelines, reports
from chorale.sources import audio
from chorale.sources.tables import layers4, points, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KS = [3, 5, 7, 9]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def _long(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    return long_form(df, vec, *keys).select(*keys, "dim", r6("x"))


def _split(df: DataFrame) -> DataFrame:
    return sampling.stratified_split(df, "label", "id")


# pooling


def _pool(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pooling.pool_frames(points(spark, sf_dir), ["label"], "id", methods=(method,)).select("label", "dim", r6("x"))

    return run


QUERIES |= {f"pool_{m}": _pool(m) for m in pooling.METHODS}


@query
def pool_all_methods(spark, sf_dir):
    return pooling.pool_frames(points(spark, sf_dir), ["label"], "id").select("label", "method", "dim", r6("x"))


@query
def pool_nested_frames(spark, sf_dir):
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vec", i * 8 + 1, 8))
    clips = points(spark, sf_dir).select("id", frames.alias("frames"))
    out = clips.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), pooling.pool_nested(F.col("frames"), m).alias("vec")) for m in pooling.METHODS])).alias("p"))
    return _long(out.select("id", "p.method", "p.vec"), "id", "method")


# series, frames and spectra


@query
def event_stats(spark, sf_dir):
    out = stats.series_stats(table(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", *[r6(c) for c in out.columns if c != "user_id"])


def _signal(spark, sf_dir):
    return long_form(points(spark, sf_dir), "vec", "id").withColumnRenamed("dim", "t")


@query
def frame_rms_zcr(spark, sf_dir):
    return stats.framed(_signal(spark, sf_dir), ["id"], "t", "x", 16, 8).select("id", "frame", r6("rms"), r6("zcr"))


@query
def event_duration_zcr(spark, sf_dir):
    """Duration of a user's series and how often it crosses its own mean."""
    from pyspark.sql import Window

    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = user.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order, so that the mean's last bit does not follow from the shuffle
    rows = table(spark, sf_dir, "events").withColumn("d", F.col("value") - F.avg("value").over(whole))
    rows = rows.withColumn("cross", (F.col("d") < 0) != (F.lag("d").over(user) < 0))
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) if hasattr(F, "timestamp_diff") else F.expr("timestampdiff(SECOND, min(ts), max(ts))")
    return rows.groupBy("user_id").agg(seconds.alias("duration_sec"), F.round(F.count_if("cross") / F.count("*"), 6).alias("zcr"))


@query
def dft_centroid_bandwidth_rolloff(spark, sf_dir):
    return stats.dft_shape(_signal(spark, sf_dir), "id", 64).select("id", r6("centroid"), r6("bandwidth"), "rolloff")


@query
def delta(spark, sf_dir):
    return stats.delta_frames(_signal(spark, sf_dir), ["id"], "t", "x").select("id", "t", r6("delta"))


@query
def delta_delta(spark, sf_dir):
    """Second-order deltas."""
    return stats.delta_frames(_signal(spark, sf_dir), ["id"], "t", "x", order=2).select("id", "t", r6("delta"))


def _features(kind: str) -> Query:
    def run(spark, sf_dir):
        """Features of embeddings played 64 times over as clips of 4,096 samples."""
        samples = F.flatten(F.array_repeat("embedding", 64))
        waves = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), samples.alias("samples"), F.lit(16000).alias("sr"))
        frames = audio.extract(waves, kind)
        return frames.select("id", pooling.pool_nested(F.col("frames"), "mean").alias("vec"), "error")

    return run


QUERIES |= {f"{k}_features": _features(k) for k in ("mfcc", "spectral", "prosodic")}


@query
def encoder_layers(spark, sf_dir):
    """The stand-in encoder's layers, mean-pooled."""
    waves = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.flatten(F.array_repeat("embedding", 32)).alias("samples"), F.lit(16000).alias("sr"))
    return audio.encode(waves, audio.RandomProjectionEncoder()).select("id", "layer", pooling.pool_nested(F.col("frames"), "mean").alias("vec"), "error")


# the same in SQL text


def _in_sql(text: str) -> Query:
    """A query in SQL over a view ``clips`` of (id, samples, sr, frames): embeddings as clips of 64 samples and as eight frames."""

    def run(spark, sf_dir):
        lateral.register(spark)
        frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vec", i * 8 + 1, 8))
        clips = points(spark, sf_dir).select("id", F.col("vec").alias("samples"), F.lit(16000).alias("sr"), frames.alias("frames"))
        return spark.sql(text, clips=clips)

    return run


QUERIES |= {
    "sql_frames": _in_sql("SELECT c.id, f.frame, round(f.rms, 6) AS rms, round(f.zcr, 6) AS zcr FROM {clips} c, LATERAL wave_frames(c.samples, 16, 8) f"),
    "sql_mfcc": _in_sql("SELECT c.id, m.frame, m.vec FROM {clips} c, LATERAL wave_mfcc(flatten(array_repeat(c.samples, 64)), c.sr) m"),
    "sql_pooling": _in_sql(" UNION ALL ".join(f"SELECT c.id, '{m}' AS method, p.dim, round(p.x, 6) AS x FROM {{clips}} c, LATERAL pool_frames(c.frames, '{m}') p" for m in pooling.METHODS)),
}


# waveforms and filters


@query
def peak_normalize(spark, sf_dir):
    return _long(points(spark, sf_dir).select("id", waveform.normalise(F.col("vec"), "peak").alias("vec")), "id")


@query
def rms_normalize(spark, sf_dir):
    return _long(points(spark, sf_dir).select("id", waveform.normalise(F.col("vec"), "rms").alias("vec")), "id")


@query
def mono_mix(spark, sf_dir):
    return _long(points(spark, sf_dir).select("id", waveform.mono(F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))).alias("vec")), "id")


@query
def duration_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(waveform.duration_ok(F.col("n_chars") / F.lit(1000.0))).select("doc_id", "n_chars")


@query
def rare_class_filter(spark, sf_dir):
    return sampling.drop_rare(table(spark, sf_dir, "events"), "user_id", 60).select("event_id", "user_id")


@query
def isin_filter(spark, sf_dir):
    return points(spark, sf_dir).where(F.col("label").isin(1, 3, 5)).select("id", "label")


# labels


@query
def label_from_path(spark, sf_dir):
    key = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("file_key")).withColumn("label", L.label_from_path(F.col("file_key")))


@query
def call_type_suffix(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.call_type(F.col("o_orderpriority")).alias("call_type"))


@query
def individual_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.prefix(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("individual"))


@query
def folder_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.folder_key(F.concat(F.lit("Data/"), F.col("p_name"))).alias("folder"))


@query
def label_encode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    codes = orders.select("o_orderpriority").distinct().withColumn("code", L.encode("o_orderpriority"))
    return orders.join(small(codes), "o_orderpriority").select("o_orderkey", "o_orderpriority", "code")


# layers


def _combined(method: str, chosen: list[int]) -> Query:
    def run(spark, sf_dir):
        return _long(layers.combine_layers(layers4(spark, sf_dir), ["id"], method, chosen), "id")

    return run


QUERIES |= {
    "layer_concat": _combined("concatenation", [0, 2, 3]),
    "layer_mean": _combined("mean", [0, 1, 2, 3]),
    "layer_weighted_mean": _combined("weighted_mean", [0, 1, 2, 3]),
    "layer_max": _combined("max", [0, 1, 2, 3]),
}


@query
def layer_select(spark, sf_dir):
    return _long(layers4(spark, sf_dir).where(F.col("layer").isin(layers.select_layers(4, "early_middle_late"))), "id", "layer")


def _ch_by_layer(spark, sf_dir):
    return clustering.calinski_harabasz(layers4(spark, sf_dir), ("layer",))


@query
def layer_contribution_weights(spark, sf_dir):
    return _ch_by_layer(spark, sf_dir).select("layer", r6("score"), F.round(layers.weights_from_scores(F.col("score")), 6).alias("weight"))


@query
def layer_silhouette(spark, sf_dir):
    return clustering.silhouette_cosine(layers4(spark, sf_dir), ("layer",)).select("layer", r6("silhouette"))


@query
def layer_contributions(spark, sf_dir):
    """Every layer's score and weight by each of the three metrics."""
    rows = layers4(spark, sf_dir)
    out = None
    for metric in layers.CONTRIBUTIONS:
        one = layers.layer_contributions(rows, metric).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out.select("metric", "layer", r6("score"), F.round(layers.weights_from_scores(F.col("score"), "metric"), 6).alias("weight"))


@query
def layer_mean_by_pooling(spark, sf_dir):
    """Layers of four frames of four dimensions, pooled by mean and by maximum, then averaged over the layers for each pooling."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vec", i * 4 + 1, 4))
    pooled = F.array(*[F.struct(F.lit(m).alias("method"), pooling.pool_nested(frames, m).alias("vec")) for m in ("mean", "max")])
    rows = layers4(spark, sf_dir).select("id", "layer", F.explode(pooled).alias("p")).select("id", "layer", "p.method", "p.vec")
    return _long(layers.combine_layers(rows, ["id", "method"], "mean", [0, 1, 2, 3]), "id", "method")


# fusion


def _sets(spark, sf_dir):
    p = points(spark, sf_dir)
    return {"handcrafted": p.select(F.col("id").alias("file_key"), F.slice("vec", 1, 16).alias("vec")), "encoder": p.select(F.col("id").alias("file_key"), F.slice("vec", 17, 48).alias("vec"))}


@query
def standardize(spark, sf_dir):
    p = points(spark, sf_dir)
    return _long(fusion.Standardiser().fit(p).transform(p), "id")


def _fused(method: str, **options) -> Query:
    def run(spark, sf_dir):
        return _long(fusion.Fusion(method, normalise=method == "pca_fusion", **options).fit_transform(_sets(spark, sf_dir)), "file_key")

    return run


QUERIES |= {"fusion_concat": _fused("concatenation"), "fusion_weighted": _fused("weighted"), "fusion_pca": _fused("pca_fusion", pca_dims={"handcrafted": 4, "encoder": 8})}


@query
def multi_layer_fusion(spark, sf_dir):
    rows = layers4(spark, sf_dir).withColumnRenamed("id", "file_key")
    return _long(fusion.MultiLayerFusion([0, 1, 2, 3], "mean").fit_transform(rows), "file_key")


@query
def covariance_matrix(spark, sf_dir):
    return projection.covariance(points(spark, sf_dir)).select("i", "j", F.round("cov", 9).alias("cov"))


@query
def class_scatter(spark, sf_dir):
    return clustering.scatter(points(spark, sf_dir)).select("label", "dim", "n", r6("mean"), r6("within"))


# joins and sets


@query
def feature_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return one("F").intersect(one("O")).intersect(one("P"))


@query
def feature_inner_join(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return _long(sets["handcrafted"].withColumnRenamed("vec", "m").join(sets["encoder"], "file_key").select("file_key", F.concat("m", "vec").alias("vec")), "file_key")


@query
def label_semi_join(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(open_, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query
def left_join_metrics(spark, sf_dir):
    knn = neighbors.holdout(_split_layers(spark, sf_dir), [5], ("layer",)).where("layer <> 2").select("layer", F.col("balanced_accuracy").alias("knn"))
    out = ranking.join_metrics(_ch_by_layer(spark, sf_dir).withColumnRenamed("score", "ch"), knn)
    return out.select("layer", r6("ch"), r6("knn"))


@query
def full_outer_layers(spark, sf_dir):
    b = reshape(points(spark, sf_dir), "vec", 8, 8, "layer", "id", "label").where("layer >= 2")
    out = ranking.compare_models(_ch_by_layer(spark, sf_dir), clustering.calinski_harabasz(b, ("layer",)), "score")
    return out.select("layer", r6("a"), r6("b"))


@query
def cross_grid_fill(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg(F.col("n_chars").cast("double")).alias("value"))
    return ranking.grid(cells, "lang", "source", "value").select("lang", "source", r6("value"))


@query
def metric_except(spark, sf_dir):
    names = spark.createDataFrame([("knn_accuracy",), ("knn_best_k",), ("silhouette",), ("logreg_best_C",)], "metric string")
    drop = spark.createDataFrame([(p,) for p in ranking.PARAMETERS], "metric string")
    return names.exceptAll(drop).select("metric", L.metric_title(F.col("metric")).alias("title"))


# summaries


@query
def dataset_stats(spark, sf_dir):
    out = stats.corpus_stats(table(spark, sf_dir, "documents"), "source", "n_chars")
    return out.select("source", "n_files", *[r6(c) for c in out.columns[2:]])


@query
def dataset_stats_estimate(spark, sf_dir):
    """The estimate from the first ten files of each source."""
    out = stats.corpus_estimate(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")
    return out.select("source", "n_files", *[r6(c) for c in out.columns[2:]])


@query
def stats_json(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("total"))
    return reports.as_json(rows, "source")


@query
def subset_manifest(spark, sf_dir):
    """The manifest of up to twenty documents of each source, unfolded."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.col("doc_id").cast("string").alias("file_key"))
    one = pipelines.manifest(sampling.sample_per_group(docs, "label", "file_key", 20), "documents", 20)
    return one.select("total_files", "random_seed", F.explode("individuals").alias("label", "v")).select("label", "v.num_files", F.array_join("v.files", ",").alias("files"), "total_files", "random_seed")


@query
def corpus_blocks(spark, sf_dir):
    """Blocks of orders by status: who is in them, and what kinds."""
    rows = table(spark, sf_dir, "orders").withColumn("kind", L.call_type(F.col("o_orderpriority")))
    out = stats.corpus_blocks(rows, "o_orderstatus", "o_custkey", "kind", "o_totalprice")
    return out.select("o_orderstatus", "num_files", "num_individuals", F.array_join("call_types", ",").alias("call_types"), F.round("avg_duration", 4).alias("avg_duration"))


@query
def distinct_sorted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_files"))


@query
def totals_rollup(spark, sf_dir):
    return stats.totals(table(spark, sf_dir, "documents").withColumn("ok", F.col("n_chars") >= 500), "lang", "ok")


# sampling


@query
def subset_sample(spark, sf_dir):
    return sampling.sample_per_group(table(spark, sf_dir, "documents"), "source", "doc_id", 20).select("source", "doc_id")


@query
def stratified_split(spark, sf_dir):
    return _split(points(spark, sf_dir)).select("id", "label", "is_test")


@query
def stratified_kfold(spark, sf_dir):
    return sampling.stratified_folds(points(spark, sf_dir), "label", "id").select("id", "label", "fold")


@query
def top10_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query
def trial_class_sample(spark, sf_dir):
    return sampling.sample_labels(points(spark, sf_dir), "label", 4, 5)


@query
def class_weight(spark, sf_dir):
    return sampling.class_weights(points(spark, sf_dir), "label").select("label", r6("weight")).distinct()


# neighbours and metrics


def _split_layers(spark, sf_dir):
    """Layers with the split of their points; a point is on the same side in every layer."""
    split = _split(points(spark, sf_dir)).select("id", "is_test")
    return layers4(spark, sf_dir).join(split, "id")


@query
def knn_predict_k5(spark, sf_dir):
    p = points(spark, sf_dir)
    return neighbors.vote(neighbors.nearest(p, p, 5), [5]).select("id", "label", "pred")


@query
def knn_sweep(spark, sf_dir):
    out = neighbors.holdout(_split_layers(spark, sf_dir), KS, ("layer",))
    return out.select("layer", "k", *[r6(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "macro_precision", "macro_recall")], "n_classes", "n_samples")


@query
def knn_cv(spark, sf_dir):
    out = neighbors.cross_validated(sampling.stratified_folds(points(spark, sf_dir), "label", "id"), KS)
    return out.select("k", r6("cv_mean"), r6("cv_std"))


def _judged(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query
def confusion_matrix(spark, sf_dir):
    return metrics.matrix(_judged(spark, sf_dir), [0, 1]).select("y_true", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query
def confusion_normalized(spark, sf_dir):
    return metrics.normalised(_judged(spark, sf_dir)).select("y_true", "y_pred", "n", r6("share"))


@query
def accuracy_bundle(spark, sf_dir):
    out = metrics.bundle(_judged(spark, sf_dir))
    return out.select(*[r6(c) for c in out.columns[:5]], "n_classes", "n_samples")


@query
def per_class_f1(spark, sf_dir):
    return metrics.per_class(_judged(spark, sf_dir)).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@query
def classification_report(spark, sf_dir):
    return metrics.report(_judged(spark, sf_dir)).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


# clusters and ranks


@query
def silhouette_euclidean(spark, sf_dir):
    return clustering.silhouette_euclidean(points(spark, sf_dir)).select(r6("silhouette"))


@query
def silhouette_cosine(spark, sf_dir):
    return clustering.silhouette_cosine(points(spark, sf_dir)).select(r6("silhouette"))


@query
def calinski_harabasz(spark, sf_dir):
    return clustering.calinski_harabasz(points(spark, sf_dir)).select(r6("score"))


@query
def davies_bouldin(spark, sf_dir):
    return clustering.davies_bouldin(points(spark, sf_dir)).select(r6("score"))


def _layer_metrics(spark, sf_dir):
    """(layer, metric, value) of two cluster scores and the kNN scores at k = 5."""
    l4 = layers4(spark, sf_dir)
    ch = clustering.calinski_harabasz(l4, ("layer",)).select("layer", F.lit("calinski_harabasz").alias("metric"), F.col("score").alias("value"))
    db = clustering.davies_bouldin(l4, ("layer",)).select("layer", F.lit("davies_bouldin").alias("metric"), F.col("score").alias("value"))
    knn = neighbors.holdout(_split_layers(spark, sf_dir), [5], ("layer",)).select("layer", F.explode(F.array(*[F.struct(F.lit(f"knn_{m}").alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy", "macro_f1")])).alias("e")).select("layer", "e.*")
    return ch.unionByName(db).unionByName(knn).withColumn("value", F.round("value", 9))


@query
def layer_rank(spark, sf_dir):
    return ranking.rank_layers(_layer_metrics(spark, sf_dir)).select("metric", "layer", r6("value"), "rank")


@query
def top3_per_metric(spark, sf_dir):
    return ranking.top_layers(_layer_metrics(spark, sf_dir)).select("metric", "layer", "rank")


@query
def minmax_heatmap(spark, sf_dir):
    return ranking.min_max(_layer_metrics(spark, sf_dir)).select("metric", "layer", r6("scaled"))


@query
def best_by_balanced_accuracy(spark, sf_dir):
    return ranking.best_layer(_layer_metrics(spark, sf_dir), "knn_balanced_accuracy").select("layer", r6("value"))


@query
def bench_report(spark, sf_dir):
    return reports.metric_lines(_layer_metrics(spark, sf_dir))


@query
def overall_summary(spark, sf_dir):
    return reports.overall_lines(_layer_metrics(spark, sf_dir))


@query
def flagship(spark, sf_dir):
    """Which layer and neighbour count identify the individual best?"""
    from pyspark.sql import Window

    cells = neighbors.holdout(_split_layers(spark, sf_dir), KS, ("layer",)).select("layer", "k", F.round("balanced_accuracy", 9).alias("b"))
    rank = F.row_number().over(Window.orderBy(F.desc("b"), "layer", "k")).cast("long")
    return cells.select("layer", "k", r6("b", "balanced_accuracy"), rank.alias("rank"))


@query
def scaling_study(spark, sf_dir):
    out = scaling.scaling_study(points(spark, sf_dir), [2, 3, 5, 8, 10, 50])
    return out.select("n", "trials", *[r6(c) for c in out.columns[2:]])


@query
def scaling_extremes(spark, sf_dir):
    most = scaling.choose(points(spark, sf_dir), [2, 4], selection="most").withColumn("selection", F.lit("most"))
    least = scaling.choose(points(spark, sf_dir), [2, 4], selection="least").withColumn("selection", F.lit("least"))
    return most.unionByName(least).select("selection", "n", "label")


# learned models and projections


def _model(name: str) -> Query:
    def run(spark, sf_dir):
        out = models.Classifier(name).train_and_evaluate(_split(points(spark, sf_dir)))
        return out.select(F.lit(name).alias("classifier"), *[r6(c) for c in out.columns[:5]], "n_classes", "n_samples")

    return run


QUERIES |= {"logreg_probe": _model("linear_probe"), "svm_linear": _model("svm_linear"), "svm_rbf": _model("svm_rbf"), "random_forest": _model("random_forest"), "gbt": _model("xgboost")}


@query
def grid_search(spark, sf_dir):
    return models.grid_search(points(spark, sf_dir), "linear_probe")


@query
def bakeoff(spark, sf_dir):
    return models.bake_off(points(spark, sf_dir))


@query
def layer_comparison(spark, sf_dir):
    """Cluster scores, the best kNN and the best linear probe and logistic regression of every layer."""
    out = pipelines.compare_layers(layers4(spark, sf_dir), probes=pipelines.PROBES)
    return out.select("layer", "metric", r6("value"))


@query
def scaling_by_features(spark, sf_dir):
    """The scaling study on two feature sets."""
    labels = points(spark, sf_dir).select(F.col("id").alias("file_key"), "label")
    sets = {k: v.join(labels, "file_key").select(F.col("file_key").alias("id"), "label", "vec") for k, v in _sets(spark, sf_dir).items()}
    out = scaling.compare_scaling(sets, [2, 5, 10])
    return out.select("features", "classifier", "n", "trials", *[r6(c) for c in out.columns if c.endswith(("_mean", "_std"))])


@query
def pca_2d(spark, sf_dir):
    return reduction.pca_2d(points(spark, sf_dir))


@query
def discriminant_2d(spark, sf_dir):
    return reduction.discriminant_2d(points(spark, sf_dir))


@query
def tsne_2d(spark, sf_dir):
    return reduction.layout_2d(layers4(spark, sf_dir), "tsne", ("layer",))


@query
def umap_2d(spark, sf_dir):
    return reduction.layout_2d(layers4(spark, sf_dir), "umap", ("layer",))
