"""The end-to-end plans: clips to pooled features, and pooled features to ranked layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chorale.operators import clustering, linear, metrics, models, neighbors, pooling, ranking, reduction, sampling
from chorale.sources import audio, tables


def preprocess(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """(waveforms, failures) of a corpus folder; failures tell durations out of range from bad files."""
    done = audio.waveforms(audio.scan(spark, root), **options)
    return done.where("error IS NULL").drop("error"), done.where("error IS NOT NULL").select("file_key", "error")


def counted(done: DataFrame, name: str = "clips") -> tuple[DataFrame, Observation]:
    """``done`` (…, error), and the counts success, failed and out_of_range that its next run makes on the way; no second decode."""
    seen = Observation(name)
    return done.observe(seen, *[F.count_if(_status() == k).alias(k) for k in ("success", "failed", "out_of_range")]), seen


def _status() -> Column:
    return F.when(F.col("error").isNull(), "success").when(F.col("error").contains("is out of range"), "out_of_range").otherwise("failed")


def preprocess_to(spark: SparkSession, root: str, out: str, **options) -> dict[str, int]:
    """Write waveforms and failures of a corpus folder, a folder for each status, in one run that decodes every clip once; its counts."""
    done, seen = counted(audio.waveforms(audio.scan(spark, root), **options))
    done.withColumn("status", _status()).write.partitionBy("status").mode("overwrite").parquet(out)
    return seen.get


def subset(spark: SparkSession, root: str, n: int = 20, seed: int = 42) -> DataFrame:
    """Manifest (label, file_key) of up to ``n`` clips of each individual; no file is opened or copied."""
    files = audio.scan(spark, root, content=False)
    return sampling.sample_per_group(files, "label", "file_key", n, seed).select("label", "file_key")


def manifest(chosen: DataFrame, dataset: str, n: int, seed: int = 42) -> DataFrame:
    """One row (dataset, samples_per_individual, individuals, total_files, random_seed) for a subset; individuals maps to number and list of files."""
    each = chosen.groupBy("label").agg(F.struct(F.count("*").alias("num_files"), F.array_sort(F.collect_list("file_key")).alias("files")).alias("v"))
    one = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "v")))).alias("individuals"), F.coalesce(F.sum("v.num_files"), F.lit(0)).alias("total_files"))
    return one.select(F.lit(dataset).alias("dataset"), F.lit(n).alias("samples_per_individual"), "individuals", "total_files", F.lit(seed).alias("random_seed"))


def chosen_clips(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """The clips of a manifest's rows (file_key), with content; others are not opened."""
    return audio.scan(spark, root).join(chosen.select("file_key"), "file_key", "left_semi")


def pooled(waves: DataFrame, frames: DataFrame, methods: tuple[str, ...] = pooling.METHODS) -> DataFrame:
    """(file_key, label, layer, method, vec): every pooling of every clip and layer without a shuffle."""
    rows = frames.where("error IS NULL") if "error" in frames.columns else frames
    layer = F.col("layer") if "layer" in rows.columns else F.lit(0).alias("layer")
    entries = F.array(*[F.struct(F.lit(m).alias("method"), pooling.pool_nested(F.col("frames"), m).alias("vec")) for m in methods])
    return rows.select("file_key", "label", layer, F.explode(entries).alias("p")).select("file_key", "label", "layer", "p.method", "p.vec")


def handcrafted(waves: DataFrame, methods: tuple[str, ...] = ("mean",)) -> DataFrame:
    """(file_key, label, feature_type, method, vec) of mfcc, spectral, prosodic and, where all three worked, combined.

    One pass over the waveforms; what belongs to a clip, a few vectors, meets in one row.
    """
    frames = audio.extract_many(waves, ("mfcc", "spectral", "prosodic")).withColumn("layer", F.col("kind"))
    each = pooled(waves, frames, tuple(dict.fromkeys((*methods, "mean")))).withColumnRenamed("layer", "feature_type")
    each = each.where(F.when(F.col("feature_type") == "prosodic", F.col("method") == "mean").otherwise(F.col("method").isin(*methods)))
    one = lambda kind, m: F.max(F.when((F.col("feature_type") == kind) & (F.col("method") == m), F.col("vec")))
    entry = lambda kind, m, vec: F.struct(kind.alias("feature_type"), m.alias("method"), vec.alias("vec"))
    whole = [F.concat(one("mfcc", m), one("spectral", m), one("prosodic", "mean")) for m in methods]
    combined = F.array(*[entry(F.lit("combined"), F.lit(m), v) for m, v in zip(methods, whole, strict=True)])
    clips = each.groupBy("file_key", "label").agg(F.collect_list(entry(F.col("feature_type"), F.col("method"), F.col("vec"))).alias("own"), combined.alias("combined"))
    rows = clips.select("file_key", "label", F.explode(F.concat("own", F.filter("combined", lambda e: e["vec"].isNotNull()))).alias("e"))
    return rows.select("file_key", "label", "e.feature_type", "e.method", "e.vec")


def extract_and_pool(spark: SparkSession, root: str, out: str, dataset: str, model: str, encoder: audio.Encoder) -> None:
    """Write features_raw and features_pooled of a corpus."""
    waves, _ = preprocess(spark, root)
    raw = audio.encode(waves, encoder).where("error IS NULL").withColumns({"dataset": F.lit(dataset), "model": F.lit(model)})
    tables.write_table(raw.select("dataset", "model", "file_key", "label", "layer", "frames"), out, "features_raw", "append")
    stored = tables.read_table(spark, out, "features_raw", dataset=dataset, model=model)
    tables.write_table(pooled(waves, stored).withColumns({"dataset": F.lit(dataset), "model": F.lit(model)}), out, "features_pooled", "append")


def _clean(features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, id, label, vec) of mean-pooled features, without labels that have a single clip."""
    label = Window.partitionBy(*keys, "label")
    rows = features.where(F.col("method") == "mean").select(*keys, F.col("file_key").alias("id"), "label", "vec").where(F.size("vec") > 0)
    return rows.withColumn("_n", F.count("*").over(label)).where("_n > 1").drop("_n")


def _long_metrics(cells: DataFrame, keys: tuple[str, ...], name: str, parameter: str, source: str = "") -> DataFrame:
    """(keys, metric, value) of a classifier's three scores and its chosen parameter."""
    at = lambda c: F.col(f"{source}{c}").cast("double")
    found = [(f"{name}_best_{parameter}", at(parameter)), *[(f"{name}_{m}", at(m)) for m in ("accuracy", "balanced_accuracy", "macro_f1")]]
    return cells.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in found])).alias("e")).select(*keys, "e.*")


def probe_layers(split: DataFrame, keys: tuple[str, ...], cs: list[float], folds: int = 5) -> DataFrame:
    """(keys, C, accuracy, balanced_accuracy, macro_f1): in every cell the best C by cross-validation on the training rows, scored on the test rows.

    All layers, folds and C are fitted together, those that train on every fold too.
    """
    train = sampling.stratified_folds(split.where("NOT is_test"), "label", "id", folds, within=keys)
    points = train.select(*keys, "label", "vec", "fold").unionByName(split.where("is_test").select(*keys, "label", "vec", F.lit(linear.TEST).cast("long").alias("fold")))
    counts, cells, groups = linear.fit_grid(points, keys, cs, [*range(folds), linear.TEST])
    found = {r["cell"]: r for r in metrics.bundle(counts, ("cell",)).collect()}  # a row for each cell
    counts.unpersist()
    out = []
    for g, key in enumerate(groups):
        at = {(c.c, c.fold): found[k] for k, c in enumerate(cells) if c.group == g and k in found}
        means = {c: [at[c, f]["balanced_accuracy"] for f in range(folds) if (c, f) in at] for c in cs}
        best = min(cs, key=lambda c: (-sum(means[c]) / max(len(means[c]), 1), repr({"c": c})))
        if (best, linear.TEST) in at:
            out.append((*key, float(best), *[float(at[best, linear.TEST][m]) for m in ("accuracy", "balanced_accuracy", "macro_f1")]))
    kinds = dict(split.dtypes)
    return split.sparkSession.createDataFrame(out, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "C double, accuracy double, balanced_accuracy double, macro_f1 double"]))


def compare_layers(rows: DataFrame, keys: tuple[str, ...] = ("layer",), ks: tuple[int, ...] = (3, 5, 7, 9), probes: dict[str, str] | None = None, grid: dict | None = None, folds: int = 5) -> DataFrame:
    """(keys, metric, value) of (keys, id, label, vec): three cluster scores, the best kNN, and the best linear probes.

    kNN and cluster scores are one grouped query over all cells. ``probes`` has multinomial regressions by the
    prefix of their metrics, whose fits all run in one optimiser; what a cell's score cannot tell is null or missing there and costs no other cell.
    """
    split = sampling.stratified_split(rows, "label", "id", within=keys)
    cells = neighbors.holdout(split, list(ks), keys)
    best = cells.groupBy(*keys).agg(F.max_by(F.struct("k", "accuracy", "balanced_accuracy", "macro_f1"), F.struct("balanced_accuracy", (-F.col("k")).alias("k"))).alias("b"))
    out = _long_metrics(best, keys, "knn", "k", "b.")
    scores = {"silhouette": clustering.silhouette_cosine(rows, keys).withColumnRenamed("silhouette", "score"), "calinski_harabasz": clustering.calinski_harabasz(rows, keys), "davies_bouldin": clustering.davies_bouldin(rows, keys)}
    for name, found in scores.items():
        out = out.unionByName(found.select(*keys, F.lit(name).alias("metric"), F.col("score").alias("value")))
    if probes:
        grids = {prefix: tuple((grid or models.grid_of(name))["c"]) for prefix, name in probes.items()}
        found = {cs: probe_layers(split, keys, list(cs), folds) for cs in dict.fromkeys(grids.values())}  # both are multinomial, so a grid is fitted once
        for prefix, cs in grids.items():
            out = out.unionByName(_long_metrics(found[cs], keys, prefix, "C"))
    return out


#: The linear classifiers of a full comparison by the prefix of their metrics.
PROBES = {"linear_probe": "linear_probe", "logreg": "logistic_regression"}


def evaluate_layers(features: DataFrame, ks: tuple[int, ...] = (3, 5, 7, 9), probes: dict[str, str] | None = None) -> DataFrame:
    """:func:`compare_layers` for every dataset, model and layer of stored features."""
    keys = ("dataset", "model", "layer")
    return compare_layers(_clean(features, keys), keys, ks, probes)


def evaluate_sets(features: DataFrame, classifiers: tuple[str, ...] | None = None) -> DataFrame:
    """(features, classifier, metrics): the whole bake-off on every set of (feature_type, file_key, label, vec)."""
    out = None
    for kind in sorted(r[0] for r in features.select("feature_type").distinct().collect()):  # a row for each set
        cell = features.where(F.col("feature_type") == kind).select(F.col("file_key").alias("id"), "label", "vec")
        rows = (models.bake_off(cell) if classifiers is None else models.bake_off(cell, classifiers)).withColumn("features", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def comprehensive(features: DataFrame, classifiers: tuple[str, ...] | None = None) -> DataFrame:
    """Scan the layers with kNN, then run every classifier, or those named, on the best layer of each dataset and model.

    Layer choice and scores share a split, as in the procedure that this reproduces, so scores are optimistic.
    """
    best = ranking.best_layer(evaluate_layers(features, (5,)), "knn_balanced_accuracy", ("dataset", "model"))
    out = None
    for r in best.collect():  # a row for each dataset and model
        at = (F.col("dataset") == r["dataset"]) & (F.col("model") == r["model"]) & (F.col("layer") == r["layer"]) & (F.col("method") == "mean")
        cell = features.where(at).select(F.col("file_key").alias("id"), "label", "vec")
        rows = (models.bake_off(cell) if classifiers is None else models.bake_off(cell, classifiers)).withColumns({"dataset": F.lit(r["dataset"]), "model": F.lit(r["model"]), "layer": F.lit(r["layer"])})
        out = rows if out is None else out.unionByName(rows)
    return out


def subsets(spark: SparkSession, roots: dict[str, str], n: int = 20, seed: int = 42, layouts: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(clips, manifests) of up to ``n`` clips of each individual of every corpus; one query for all, None if no corpus is there."""
    files = audio.scan_corpora(spark, roots, layouts, content=False)
    if files is None:
        return None
    rows = files.withColumn("_in", F.struct("dataset", "label"))
    chosen = sampling.sample_per_group(rows, "_in", "file_key", n, seed).select("dataset", "label", "file_key")
    each = chosen.groupBy("dataset", "label").agg(F.struct(F.count("*").alias("num_files"), F.array_sort(F.collect_list("file_key")).alias("files")).alias("v"))
    one = each.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "v")))).alias("individuals"), F.sum("v.num_files").alias("total_files"))
    return chosen, one.select("dataset", F.lit(n).alias("samples_per_individual"), "individuals", "total_files", F.lit(seed).alias("random_seed"))


def best_grid(metrics_of: DataFrame, metric: str) -> DataFrame:
    """(dataset, model, layer, value): the best layer of every model on every corpus by one metric; the whole grid, without a result 0."""
    best = ranking.best_layer(metrics_of, metric, ("dataset", "model"))
    return ranking.grid(best, "dataset", "model", "value").join(best.select("dataset", "model", "layer"), ["dataset", "model"], "left")


def views(features: DataFrame, method: str = "umap", layers: list[int] | None = None, **options) -> DataFrame:
    """(dataset, model, layer, id, label, x, y, error): every stored layer of every model and corpus in two dimensions."""
    keys = ("dataset", "model", "layer")
    rows = _clean(features, keys)
    return reduction.layout_2d(rows if layers is None else rows.where(F.col("layer").isin(layers)), method, keys, **options)
