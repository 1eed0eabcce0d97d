"""Exact deduplication over an extendible-hash index kept in shared files.

Every row is reduced to a 64-bit key and a SHA-256 fingerprint of its normalised text. Distinct
(key, fingerprint) entries, so that a hot text is one of them, form the index. A directory addressed by the
leading bits of the key starts with one bucket and doubles whenever an overfull bucket sits at the
directory's depth; a bucket is a folder of files for the range of keys that it owns. The texts of entries
with several rows are dealt to the same buckets, each once for a partition that has it, so that a hot text is
not many. The task that owns a bucket sorts it, follows the chain of every key, compares the bytes, and gives
each different text its size and its keeper: nothing counts as a copy but by its verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.shared import bounded, is_empty, squeezed, table

#: The histogram that drives the directory has 2 ** MAX_DEPTH rows at most, whatever the corpus.
MAX_DEPTH = 16


def _key64(text: Column) -> Column:
    return F.xxhash64(text)


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int, int]]]:
    """Split overfull buckets, doubling the directory as needed.

    ``counts`` has the entries of each ``max_depth``-bit prefix. Returns the global depth and the buckets
    as (prefix, local depth, entries); a bucket that is overfull at ``max_depth`` stays and is chained.
    """
    total = sum(counts.values())
    sums = {max_depth: counts}
    for depth in range(max_depth - 1, -1, -1):
        below, sums[depth] = sums[depth + 1], {}
        for prefix, n in below.items():
            sums[depth][prefix >> 1] = sums[depth].get(prefix >> 1, 0) + n
    global_depth, open_buckets, done = 0, [(0, 0, total)], []
    while open_buckets:
        prefix, local, n = open_buckets.pop()
        if n <= capacity or local == max_depth:
            done.append((prefix, local, n))
            continue
        global_depth = max(global_depth, local + 1)
        open_buckets += [(half, local + 1, sums[local + 1].get(half, 0)) for half in (2 * prefix, 2 * prefix + 1)]
    return global_depth, sorted(done, key=lambda b: b[0] << (max_depth - b[1]))


@dataclass(frozen=True)
class Directory:
    """Which bucket owns the keys that begin with each pattern of ``depth`` bits; a slot is a pattern."""

    depth: int
    slots: DataFrame

    def deal(self, entries: DataFrame) -> DataFrame:
        """``entries`` with the bucket that owns their key; the directory has 2 ** MAX_DEPTH slots at most."""
        return entries.withColumn("slot", _prefix(F.col("key"), self.depth)).join(F.broadcast(self.slots), "slot").drop("slot")


def build_directory(entries: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    histogram = entries.groupBy(_prefix(F.col("key"), max_depth).alias("prefix")).count().collect()
    depth, buckets = grow_directory({r["prefix"]: r["count"] for r in histogram}, capacity, max_depth)
    slots = [(slot, number) for number, (prefix, local, _) in enumerate(buckets) for slot in range(prefix << (depth - local), (prefix + 1) << (depth - local))]
    names = pa.table([pa.array(c, kind) for c, kind in zip(zip(*slots, strict=True), (pa.int64(), pa.int32()), strict=True)], ["slot", "bucket"])
    return Directory(depth, entries.sparkSession.createDataFrame(names))  # from Arrow: a list of rows would start Python workers of their own on every executor


def bucket_files(directory: Directory, entries: DataFrame, name: str) -> DataFrame:
    """Write ``entries`` into one folder of files for each bucket."""
    return table(directory.deal(entries).repartition("bucket"), name, ["bucket"])


def owners(index: DataFrame, texts: DataFrame) -> DataFrame:
    """What the owner of each bucket finds along its chains: a link for every different text.

    ``index`` has the bucket files of entries and ``texts`` those of the texts of entries with several rows, any
    of them several times, as (key, fingerprint, norm, first, n). Along the sorted chain of a key a text whose
    bytes differ from those before it begins a link; the link's size is the sum of its texts, its keeper the
    least of them. Returns (key, fingerprint, link, norm, keep_id, keep_row, n): ``link`` is the place of a text
    in its chain; ``norm`` is null unless texts of one entry differ, in which case keep_row is null.
    """
    chain = Window.partitionBy("bucket", "key").orderBy("fingerprint", "norm")
    owned = texts.repartition("bucket")
    same = (F.col("norm") == F.lag("norm").over(chain)) & (F.col("fingerprint") == F.lag("fingerprint").over(chain))
    linked = owned.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("link", F.sum("new").over(chain) - 1)
    links = linked.groupBy("bucket", "key", "fingerprint", "link").agg(F.min("norm").alias("norm"), F.min("first").alias("first"), F.sum("n").alias("n"))
    alone = F.count("*").over(Window.partitionBy("bucket", "key", "fingerprint")) == 1
    told = links.withColumn("alone", alone).withColumn("norm", F.when(~F.col("alone"), F.col("norm")))
    rows = index.where("n > 1").select("key", "fingerprint", "first_row")
    return told.join(rows, ["key", "fingerprint"]).select("key", "fingerprint", "link", "norm", F.col("first.id").alias("keep_id"), F.when(F.col("alone"), F.col("first_row")).alias("keep_row"), "n")


#: Entries of a bucket, at most; a table has at least twice as many buckets as there are cores, if it has so many entries.
CAPACITY = 1 << 17


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH, normalise: Callable[[Column], Column] = squeezed, key: Callable[[Column], Column] = _key64, fingerprint: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, fingerprint.

    Null texts count as empty; empty texts are copies of each other. Of equal texts the smallest id stays,
    null ids last; of rows that repeat the same id and text exactly one is kept. Texts are compared whole,
    of any length. An empty table gives an empty result; other columns of ``docs`` are not looked at, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("norm"))
    marks = {"key": key(F.col("norm")).cast("long"), "fingerprint": fingerprint(F.col("norm"))}
    rows = table(slim.withColumns(marks).select("id", "key", "fingerprint", F.monotonically_increasing_id().alias("row")), "rows")
    least = F.struct(F.col("id").isNull().alias("no_id"), "id")
    entries = table(rows.groupBy("key", "fingerprint").agg(F.min_by("row", F.struct(least.alias("least"), "row")).alias("first_row"), F.count("*").alias("n")), "entries")
    if capacity is None:
        capacity = max(1, min(CAPACITY, entries.count() // (2 * docs.sparkSession.sparkContext.defaultParallelism)))
    directory = build_directory(entries, capacity, max_depth)
    index = bucket_files(directory, entries, "index")

    open_keys = bounded(table(index.where("n > 1").select("key").distinct(), "open-keys"))
    again = slim.withColumns(marks).join(open_keys, "key", "left_semi")
    here = again.withColumn("piece", F.spark_partition_id()).groupBy("piece", "key", "fingerprint", "norm").agg(F.min(least).alias("first"), F.count("*").alias("n"))
    texts = bucket_files(directory, here.drop("piece"), "texts")
    links = table(owners(index, texts), "links")

    one = bounded(links.where("norm IS NULL").drop("norm", "link"))
    joined = rows.join(one, ["key", "fingerprint"], "left")
    out = joined.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "fingerprint", "key",
    )
    clashes = links.where("norm IS NOT NULL").drop("keep_row")
    if not is_empty(clashes):
        collided = ["key", "fingerprint"]
        out = out.join(clashes.select(*collided).distinct(), collided, "left_anti").unionByName(_along_chains(again, clashes))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "fingerprint")


def _along_chains(again: DataFrame, clashes: DataFrame) -> DataFrame:
    """The rows whose fingerprints collide, each at the link with its own text."""
    link = ["key", "fingerprint", "norm"]
    rows = table(again.join(clashes, link).withColumn("row", F.monotonically_increasing_id()).drop("norm"), "collided")
    first = rows.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("key", "link").agg(F.min("row").alias("first_row"))
    return rows.join(table(first, "chain-heads"), ["key", "link"]).select("id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("first_row")).alias("kept"), "fingerprint", "key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns kept.

    Rows are dropped by id and text fingerprint; of rows that repeat both, one stays. Null counts as an empty
    text; an empty table stays empty.
    """
    verdicts = table(exact_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias("_id"), F.col("fingerprint").alias("_fingerprint"), F.col("kept").alias("_kept")), "verdicts")
    return drop_rows(docs, F.col(id_col), options.get("fingerprint", _sha256)(options.get("normalise", squeezed)(F.col(text_col))), verdicts)


def drop_rows(docs: DataFrame, ident: Column, mark: Column, verdicts: DataFrame) -> DataFrame:
    """``docs`` without rows whose (_id, _fingerprint) is dropped in ``verdicts``; of repeated rows one stays."""
    kept = verdicts.where("_kept").select("_id", "_fingerprint")
    dropped = table(verdicts.where("NOT _kept").select("_id", "_fingerprint").distinct(), "dropped")
    both = table(dropped.join(kept, (dropped["_id"].eqNullSafe(kept["_id"])) & (dropped["_fingerprint"] == kept["_fingerprint"]), "left_semi"), "repeats")
    same = lambda left, right: left["_id"].eqNullSafe(right["_id"]) & (left["_fingerprint"] == right["_fingerprint"])
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ident.alias("_id"), mark.alias("_fingerprint"))
    side = bounded(dropped)
    out = marked.join(side, same(marked, side), "left_anti")
    if not is_empty(both):
        repeats = marked.join(both, same(marked, both), "left_semi").dropDuplicates(["_id", "_fingerprint"])
        out = out.unionByName(repeats)
    return out.select("_row.*")
