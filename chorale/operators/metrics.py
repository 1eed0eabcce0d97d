"""Classification metrics from confusion counts; predictions are aggregated once, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, true: str, said: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y_true, y_pred, n)."""
    return pred.groupBy(*keys, F.col(true).alias("y_true"), F.col(said).alias("y_pred")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, tp, support, predicted, precision, recall, f1) over the union of true and predicted labels; 0/0 is 0."""
    both = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("e")).select(*keys, "e.*")
    sums = both.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.withColumns({"precision": ratio(tp, predicted), "recall": ratio(tp, support), "f1": ratio(2 * tp, support + predicted)})


def bundle(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, accuracy, balanced_accuracy, macro_f1, macro_precision, macro_recall, n_classes, n_samples).

    Balanced accuracy is the mean recall of the labels that occur; macro means are over all labels, those
    only predicted too.
    """
    rows = per_class(counts, keys)
    present = F.when(F.col("support") > 0, F.col("recall"))
    return rows.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(present).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.count_if(F.col("support") > 0).alias("n_classes"), F.sum("support").alias("n_samples"),
    )


def normalised(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds share: each count as part of its true label."""
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*keys, "y_true"))))


def matrix(counts: DataFrame, labels: list) -> DataFrame:
    """The confusion matrix with a column for each label; missing cells are 0."""
    return counts.groupBy("y_true").pivot("y_pred", labels).sum("n").na.fill(0)


def report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) and the rows macro avg and weighted avg."""
    rows = per_class(counts).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    means = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "*")
    heavy = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "*")
    return rows.unionByName(means).unionByName(heavy)
