"""Text reports and the data behind figures, as ordered DataFrames of lines or cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.labels import metric_title
from chorale.operators.ranking import rank_layers


def number(c: Column) -> Column:
    """Four decimals, N/A for null."""
    return F.coalesce(F.format_string("%.4f", c), F.lit("N/A"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(section, place, line): a line for each layer and metric, then the three best layers of each metric."""
    title = F.rpad(F.substring(metric_title(F.col("metric")), 1, 20), 20, " ")
    name, layer = F.col("metric"), F.col("layer").cast("string")
    cell = F.struct(F.lit(1).alias("section"), F.concat(F.lpad(layer, 3, "0"), name).alias("place"), F.concat(F.lit("Layer "), layer, F.lit("  "), title, F.lit("  "), number(F.col("value"))).alias("line"))
    best = F.struct(F.lit(2).alias("section"), F.concat(name, F.col("rank").cast("string")).alias("place"), F.concat(title, F.lit("  "), F.col("rank").cast("string"), F.lit(". layer "), layer, F.lit("  "), number(F.col("value"))).alias("line"))
    ranked = rank_layers(metrics)  # the metrics are computed once for both sections
    return ranked.select(F.explode(F.when(F.col("rank") <= 3, F.array(cell, best)).otherwise(F.array(cell))).alias("e")).select("e.*")


def sweep_lines(results: DataFrame, parameter: str, score: str = "accuracy") -> DataFrame:
    """(place, line): parameter, CV mean and deviation, test score; the best is marked."""
    best = results.agg(F.max(score).alias("_best"))
    marked = results.crossJoin(F.broadcast(best))  # one row
    line = F.concat(F.lit(f"{parameter} = "), F.col(parameter).cast("string"), F.lit("  cv "), number(F.col("cv_mean")), F.lit(" +- "), number(F.col("cv_std")), F.lit("  test "), number(F.col(score)), F.when(F.col(score) == F.col("_best"), F.lit("  *")).otherwise(F.lit("")))
    return marked.select(F.col(parameter).alias("place"), line.alias("line"))


def classification_lines(report: DataFrame) -> DataFrame:
    """(section, place, line) of :func:`chorale.operators.metrics.report`: a line for each label, then the means."""
    mean = F.col("label").isin("macro avg", "weighted avg")
    line = F.concat(F.rpad(F.col("label"), 20, " "), *[F.concat(F.lit("  "), number(F.col(c))) for c in ("precision", "recall", "f1")], F.lpad(F.col("support").cast("string"), 8, " "))
    return report.select(F.when(mean, 2).otherwise(1).alias("section"), F.col("label").alias("place"), line.alias("line"))


def corpus_lines(stats: DataFrame, label: str) -> DataFrame:
    """(place, line): files and durations of every individual; missing figures are 0."""
    line = F.concat(F.rpad(F.col(label), 20, " "), F.format_string("%8d files  avg %.2f s  min %.2f s  max %.2f s  total %.2f h", "n_files", "avg_duration", "min_duration", "max_duration", F.col("total_duration") / 3600))
    return stats.select(F.col(label).alias("place"), line.alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write ``line`` in order as one text file; for reports, which are small whatever the corpus."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def sweep_points(results: DataFrame, parameter: str) -> DataFrame:
    """What an error-bar figure of a sweep shows."""
    return results.select(F.col(parameter).alias("x"), F.col("cv_mean").alias("y"), F.col("cv_std").alias("error"), F.col("accuracy").alias("test"))


def scatter_points(layout: DataFrame, most_labels: int = 20) -> DataFrame:
    """(x, y, label) with label null if there are too many for a legend."""
    few = layout.agg((F.count_distinct("label") <= most_labels).alias("_few"))
    return layout.crossJoin(F.broadcast(few)).select("x", "y", F.when(F.col("_few"), F.col("label")).alias("label"))  # one row


def wide_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row per layer with a column for each metric."""
    return metrics.groupBy("layer").pivot("metric", names).agg(F.first("value"))


#: How the classifiers of a layer comparison are titled.
TITLES = {"knn": "k-NN", "linear_probe": "Linear Probe", "logreg": "Logistic Regression"}


def overall_lines(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, place, line): for each classifier the scores of the layer with its best accuracy; classifiers that are missing have no line."""
    scores = ("accuracy", "balanced_accuracy", "macro_f1")
    at = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    wide = metrics.groupBy(*keys, "layer").agg(*[at(f"{prefix}_{m}").alias(f"{prefix}_{m}") for prefix in TITLES for m in scores])  # the metrics are computed once for all classifiers
    each = [F.struct(F.lit(place).alias("place"), F.lit(title).alias("title"), *[F.col(f"{prefix}_{m}").alias(m) for m in scores]) for place, (prefix, title) in enumerate(TITLES.items())]
    rows = wide.select(*keys, "layer", F.explode(F.array(*each)).alias("e")).select(*keys, "layer", "e.*").where(F.col("accuracy").isNotNull() & ~F.isnan("accuracy"))
    best = F.min(F.struct((-F.col("accuracy")).alias("m"), "layer", "title", *scores)).alias("b")
    line = F.concat(F.col("b.title"), F.lit(" (Layer "), F.col("b.layer").cast("string"), F.lit("): accuracy "), number(F.col("b.accuracy")), F.lit(", balanced accuracy "), number(F.col("b.balanced_accuracy")), F.lit(", macro F1 "), number(F.col("b.macro_f1")))
    return rows.groupBy(*keys, "place").agg(best).select(*keys, "place", line.alias("line"))


def bakeoff_table(results: DataFrame, score: str = "balanced_accuracy") -> DataFrame:
    """A row for each feature set with a column for each classifier's score, and the best classifier; ties go to the first by name."""
    best = results.groupBy("features").agg(F.min(F.struct((-F.col(score)).alias("s"), "classifier"))["classifier"].alias("best"))
    return results.groupBy("features").pivot("classifier").agg(F.first(score)).join(best, "features")


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): every row as a JSON object."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines in one file; for statistics and manifests, which are small whatever the corpus."""
    df.coalesce(1).write.mode("overwrite").json(path)
