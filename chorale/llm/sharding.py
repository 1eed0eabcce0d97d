"""Shards balanced jointly in bytes, tokens and rows by vector bin packing.

Rows with equal texts form a group that is placed as one item, unless it alone exceeds a shard; then its
rows are numbered and cut into equal pieces of a small part of a shard. Heavy items and such pieces, of which
there are few whatever the corpus, are placed first against the whole residual capacity. Light items are dealt by hash into packs; every task places
its pack's items, largest first, against its share of what the heavy items left. An item goes to the
shard where the dot product of its weights with the residual capacity is highest, among those it fits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.shared import n_words, numbered_copies, table

DIMENSIONS = ("bytes", "tokens", "rows")
#: An item is heavy above this part of a shard, and so large are the pieces of a split group; so there are at most 2 * 3 * 64 * n_shards of both.
HEAVY = 1 / 64
#: Number ranges of a shard that are counted apart, at most; the table of offsets is n_shards times as long.
MAX_RANGES = 4096


def place(weights: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each item, in the given order; ``residual`` (shards, dimensions) is used up in place."""
    out = np.empty(len(weights), dtype=np.int32)
    for i, w in enumerate(weights):
        dots = residual @ w
        fits = (residual >= w).all(axis=1)
        best = int(np.argmax(np.where(fits, dots, -np.inf) if fits.any() else dots))
        residual[best] -= w
        out[i] = best
    return out


def _ordered(pdf: pd.DataFrame, total: dict) -> tuple[pd.DataFrame, np.ndarray]:
    """Items largest first and their weights as parts of the whole."""
    weights = np.stack([pdf[d].to_numpy(dtype=float) / max(total[d], 1) for d in DIMENSIONS], axis=1)
    order = np.lexsort((pdf["piece"].to_numpy(), pdf["key"].to_numpy(dtype=str), -weights.max(axis=1)))
    return pdf.iloc[order], weights[order]


def _pieces(rows: DataFrame, splits: DataFrame, ranges: int) -> DataFrame:
    """``rows`` with the piece of a split group that each is in, null in others; pieces of a group differ by a row at most.

    A group's rows are counted by ranges of a hash and numbered within them, so no task has the whole of it.
    """
    told = rows.join(F.broadcast(splits), "key", "left")  # at most 3 * n_shards splits
    hot = told.where("pieces IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id", "copy"), F.lit(ranges)))
    counts = hot.groupBy("key", "part").count()
    before = F.sum("count").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("id", "copy")) - 1
    placed = hot.withColumn("within", within).join(F.broadcast(offsets), ["key", "part"])  # ranges for each split
    piece = F.floor((F.col("offset") + F.col("within")) * F.col("pieces") / F.col("of")).cast("int")
    return told.where("pieces IS NULL").withColumn("piece", F.lit(None).cast("int")).select(*rows.columns, "piece").unionByName(placed.withColumn("piece", piece).select(*rows.columns, "piece"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", pack_groups: int = 1 << 16) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 in every shard).

    A null text counts as empty: 8 bytes, no tokens, CRC 0. Long texts are one item whatever their length. Null and repeated ids are rows like any other.
    An empty table gives an empty result; other columns of ``docs`` are not looked at. Shards and slots follow
    from ids and texts alone, however the table is partitioned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = table(numbered_copies(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), n_words(text).alias("tokens"), F.sha2(text, 256).alias("key"))), "rows")
    sums = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = table(rows.groupBy("key").agg(*sums), "groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first().asDict()

    share = F.greatest(*[F.col(d) * n_shards / float(max(total[d], 1)) for d in DIMENSIONS])
    sized = groups.withColumn("share", share)
    splits = table(sized.where("share > 1").select("key", F.col("rows").alias("of"), F.ceil(F.col("share") / HEAVY).cast("int").alias("pieces")), "splits")
    ranges = min(MAX_RANGES, max(16, -(-total["rows"] // 250_000)))
    dealt = table(_pieces(rows, splits, ranges), "dealt")
    whole = sized.where("share <= 1").select("key", F.lit(0).alias("piece"), *DIMENSIONS, "share")
    pieces = dealt.where("piece IS NOT NULL").groupBy("key", "piece").agg(*sums).withColumn("share", share)
    items = table(whole.withColumn("hot", F.lit(False)).unionByName(pieces.withColumn("hot", F.lit(True))), "items")
    dealt = dealt.withColumn("piece", F.coalesce("piece", F.lit(0)))

    heavy, weights = _ordered(items.where((F.col("share") > HEAVY) | F.col("hot")).toPandas(), total)
    residual = np.full((n_shards, len(DIMENSIONS)), 1 / n_shards)
    heavy = heavy.assign(shard=place(weights, residual))[["key", "piece", "shard"]]
    residual = np.maximum(residual, 0)
    residual /= np.maximum(residual.sum(axis=0), 1e-12)

    light = items.where((F.col("share") <= HEAVY) & ~F.col("hot"))
    packs = max(1, -(-light.count() // pack_groups))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {d: pdf[d].sum() for d in DIMENSIONS}
        pdf, weights = _ordered(pdf, own)
        return pdf.assign(shard=place(weights, residual.copy()))[["key", "piece", "shard"]]

    schema = "key string, piece int, shard int"
    placed = light.withColumn("pack", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(packs))).groupBy("pack").applyInPandas(pack, schema)
    if len(heavy):
        placed = placed.unionByName(docs.sparkSession.createDataFrame(heavy, schema))
    placed = table(placed, "placed")

    number = table(dealt.join(placed, ["key", "piece"]).select("id", "size", "crc", "shard", "key", "copy", F.pmod(F.xxhash64("id", "key", "copy"), F.lit(ranges)).cast("int").alias("part")), "sharded")
    counts = number.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "key", "copy")) - 1
    return number.withColumn("within", within).join(F.broadcast(offsets), ["shard", "part"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("within")).alias("slot"))
