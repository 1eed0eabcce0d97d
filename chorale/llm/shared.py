"""Tables cut from their lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own: dict[str, str] = {}
_written: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="chorale-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/chorale/{uuid.uuid4().hex}-{name}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what :func:`table` wrote in this application; call it when no result needs it any more."""
    app = spark.sparkContext.applicationId
    for owner, path in [x for x in _written if x[0] == app]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove((owner, path))


#: The bound of a batch of rows on its way to a Python worker, here and where Spark has not been told another.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{4 << 20}b", f"{64 << 20}b"


def small_batches(spark: SparkSession) -> None:
    """Lower the bytes of a batch that a task sends to its Python worker, unless the session has a bound of its own.

    A task holds its batch and the batch's message outside the heap, the worker holds it again. Results don't depend
    on it. It stays set in the session, since a plan is run after the operator has returned.
    """
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fits(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 1 << 25) -> bool:
    """Whether a written table has few enough rows and bytes to be broadcast."""
    kinds = dict(df.dtypes)
    wide = [F.octet_length(f"`{c}`") for c, k in kinds.items() if k in ("string", "binary")]
    wide += [(64 if "struct" in k else 8) * F.size(f"`{c}`") for c, k in kinds.items() if k.startswith("array")]
    each = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(kinds)))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def bounded(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 1 << 25) -> DataFrame:
    """A written table, marked for broadcast if it :func:`fits`; else as it is, to be shuffled."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


#: Rows that a task makes of one group of alike rows at a time.
ALIKE = 1 << 16


def numbered_copies(df: DataFrame) -> DataFrame:
    """``df`` with ``copy``: 0, 1, ... among rows that are alike in every column, so that each row has a name
    that does not depend on how the table is partitioned. Alike rows are counted, then written out again in parts.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    few = counted.where(F.col("_n") == 1).drop("_n").withColumn("copy", F.lit(0).cast("long"))
    blocks = counted.where(F.col("_n") > 1).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(ALIKE).cast("long")))).repartition(F.xxhash64(*df.columns, "_at"))
    many = blocks.withColumn("copy", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + ALIKE, F.col("_n")) - 1))).drop("_n", "_at")
    return few.unionByName(many)


def words(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def squeezed(text: Column) -> Column:
    """The text with each run of white space replaced by one space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " ")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def release(spark: SparkSession) -> None:
    """Let Spark drop the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`table` wrote and that nothing reads any more, and :func:`release`."""
    spark = df.sparkSession
    for owner, path in [x for x in _written if x[0] == spark.sparkContext.applicationId]:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in df.inputFiles()[:1]):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            _written.remove((owner, path))
    release(spark)
