"""Parquet layouts of the engine's tables, and views of plain tables as clips, frames and layers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.vec import doubles, reshape

PARTITIONS = {"features_handcrafted": ["dataset", "feature_type"], "features_raw": ["dataset", "model", "layer"], "features_pooled": ["dataset", "model", "method", "layer"]}


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Write one of the engine's tables; reads by dataset, model, method or layer are pruned to their folders."""
    df.write.mode(mode).partitionBy(*[c for c in PARTITIONS.get(name, []) if c in df.columns]).parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, **where: str | int) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


#: Buckets of a stored set of features; sets that are joined have equally many.
BUCKETS = 64


def store_set(df: DataFrame, name: str, key: str = "file_key", buckets: int = BUCKETS, path: str | None = None) -> None:
    """Store (key, label, vec, ...) as a table of the catalogue in buckets of the key, sorted: sets stored so are joined side by side, without a shuffle."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stored_sets(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """Sets by name from the tables that hold them, as :class:`chorale.operators.fusion.Fusion` takes them."""
    return {k: spark.table(v) for k, v in names.items()}


def design_matrix(pooled: DataFrame, layer: int, method: str = "mean") -> DataFrame:
    """(file_key, label, vec) of one layer and pooling."""
    return pooled.where((F.col("layer") == layer) & (F.col("method") == method)).select("file_key", "label", "vec")


#: The handcrafted sets that an evaluation compares.
HANDCRAFTED = ("mfcc", "spectral", "combined")


def handcrafted_sets(spark: SparkSession, path: str, dataset: str, method: str = "mean") -> DataFrame | None:
    """(feature_type, file_key, label, vec) of the stored handcrafted sets of a dataset; None if there is none of them."""
    try:
        stored = read_table(spark, path, "features_handcrafted", dataset=dataset)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = stored.where((F.col("method") == method) & F.col("feature_type").isin(*HANDCRAFTED)).select("feature_type", "file_key", "label", "vec")
    return rows if rows.take(1) else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec): embeddings as pooled features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vec"))


def layers4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, layer, vec): embeddings as four layers of 16 dimensions."""
    return reshape(points(spark, sf_dir), "vec", 4, 16, "layer", "id", "label")
