"""Samples, splits and folds in an order given by a hash of seed and key, so that runs can be replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _place(label: list[str], key: str, seed: int) -> Column:
    return F.row_number().over(Window.partitionBy(*label).orderBy(hash_order(key, seed), key)).cast("long")


def sample_per_group(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each label, without replacement; ranks are cut off before the shuffle."""
    return df.withColumn("_place", _place([label], key, seed)).where(F.col("_place") <= n).drop("_place")


#: Hex digits of the hash by which a label's rows are counted before they are ranked.
DIGITS = 3


def placed(df: DataFrame, group: list[str], key: str, order: Column, out: str = "_place", total: str = "_total", digits: int = DIGITS) -> DataFrame:
    """Adds the place of each row, from 1, in its group by ``order`` (a hex hash) and key, and the rows of the group.

    Rows are counted by group and first digits of the hash; a row's place is the number of those with smaller
    digits and its place among those with its own. So a group is ranked by as many tasks as there are digits,
    whatever part of all rows it has. Null is a group like any other.
    """
    rows = df.withColumn("_order", order).withColumn("_digits", F.substring("_order", 1, digits))
    counts = rows.groupBy(*group, "_digits").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)  # no more rows than digits
    before = F.sum("_n").over(whole.orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_digits").alias("_d"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total))
    same = F.col("_digits") == F.col("_d")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    within = F.row_number().over(Window.partitionBy(*group, "_digits").orderBy("_order", key))
    told = rows.withColumn("_within", within).join(offsets, same)
    return told.withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).select(*df.columns, out, total)


def stratified_split(df: DataFrame, label: str, key: str, test_size: str = "0.2", seed: int = 42, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_test: in each label the first ceil(test_size * n) rows in hash order."""
    share = F.ceil(F.expr(f"CAST({test_size} AS DECIMAL(4,3))") * F.col("_total").cast("decimal(18,0)"))
    return placed(df, [*within, label], key, hash_order(key, seed)).withColumn("is_test", F.col("_place") <= share).drop("_place", "_total")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds fold in 0..k-1; every label's rows are dealt in hash order."""
    return placed(df, [*within, label], key, hash_order(key, seed)).withColumn("fold", ((F.col("_place") - 1) % k).cast("long")).drop("_place", "_total")


def sample_labels(df: DataFrame, label: str, n: int, trials: int, seed: int = 42) -> DataFrame:
    """(trial, label): ``n`` labels for each trial; the labels, not the rows, are ordered."""
    labels = df.select(label).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    order = F.md5(F.concat((F.col("trial") + seed).cast("string"), F.lit(":"), F.col(label).cast("string")))
    place = F.row_number().over(Window.partitionBy("trial").orderBy(order, label))
    return labels.withColumn("_place", place).where(F.col("_place") <= n).select("trial", label)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = rows / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(counts.join(F.broadcast(whole)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def drop_rare(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of labels that have at least ``least`` rows; counts are aggregated before they are joined back."""
    common = df.groupBy(label).count().where(F.col("count") >= least).select(label)
    return df.join(common, label, "left_semi")
