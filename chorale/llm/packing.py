"""Best-fit packing of documents into fixed-size training windows, without conflicts inside a window.

Documents longer than a window are cut into pieces. A window holds at most one piece of a source and at
most one piece of a duplicate cluster. Pieces are dealt by hash into packs of bounded size; each task
packs its own, largest piece first. Open windows are kept ordered by residual room, each with bitmaps
of its sources and clusters, and the search goes on to the next larger residual until a compatible window
is found. For frequent sources and clusters the windows still free of them are kept in orders of their own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.shared import n_words, numbered_copies, squeezed, table

#: A source, cluster or pair of them with this part of a pack's pieces has an order of its own.
FREQUENT = 0.01


class Residuals:
    """Windows by residual room; ``after`` walks them from the tightest that has enough."""

    def __init__(self) -> None:
        self.windows: dict[int, dict[int, None]] = defaultdict(dict)
        self.present = 0

    def add(self, window: int, room: int) -> None:
        if not self.windows[room]:
            self.present |= 1 << room
        self.windows[room][window] = None

    def remove(self, window: int, room: int) -> None:
        if self.windows[room].pop(window, 0) is None and not self.windows[room]:
            self.present &= ~(1 << room)

    def after(self, size: int) -> Iterator[int]:
        left = self.present >> size
        room = size
        while left:
            step = (left & -left).bit_length() - 1
            room += step
            yield from self.windows[room]
            left >>= step + 1
            room += 1


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece, in the given order. Source or cluster -1 conflicts with nothing."""
    least = max(2, FREQUENT * len(sizes))
    frequent = [{k for k, n in Counter(x).items() if n >= least} for x in (sources, clusters, list(zip(sources, clusters, strict=True)))]
    everything = Residuals()
    free = {("s", s): Residuals() for s in frequent[0] if s >= 0} | {("c", c): Residuals() for c in frequent[1] if c >= 0}
    free |= {("b", s, c): Residuals() for s, c in frequent[2] if ("s", s) in free and ("c", c) in free}
    room, has_source, has_cluster, out, offsets = [], [], [], [], []

    def orders(w: int):
        yield everything
        for key, order in free.items():
            hit = key[0] != "c" and has_source[w] >> key[1] & 1 or key[0] != "s" and has_cluster[w] >> key[-1] & 1
            if not hit:
                yield order

    for size, s, c in zip(sizes, sources, clusters, strict=True):
        order = free.get(("b", s, c)) or free.get(("c", c)) or free.get(("s", s)) or everything
        source_bit, cluster_bit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        w = next((w for w in order.after(size) if not has_source[w] & source_bit and not has_cluster[w] & cluster_bit), -1)
        if w < 0:
            w = len(room)
            room.append(capacity)
            has_source.append(0)
            has_cluster.append(0)
        else:
            for x in orders(w):
                x.remove(w, room[w])
        out.append(w)
        offsets.append(capacity - room[w])
        room[w] -= size
        has_source[w] |= source_bit
        has_cluster[w] |= cluster_bit
        for x in orders(w):
            x.add(w, room[w])
    return out, offsets


def _codes(values: pd.Series, single: bool) -> list[int]:
    """Small numbers for the values; -1 for null and, with ``single``, for values that occur once."""
    codes, _ = pd.factorize(values)
    if single and len(codes):
        once = np.bincount(codes[codes >= 0], minlength=1) if (codes >= 0).any() else np.zeros(1, int)
        codes = np.where((codes >= 0) & (once[np.maximum(codes, 0)] > 1), codes, -1)
        codes, _ = pd.factorize(pd.Series(codes).where(lambda x: x >= 0))
    return [int(c) for c in codes]


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", pack_rows: int = 1 << 15) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin, bin_offset; tokens are words.

    Every document has a piece, those without words (null or empty texts too) one of no tokens. Equal texts
    after squeezing white space are one duplicate cluster. A null source conflicts with no other. Null and
    repeated ids are rows like any other; an empty table gives an empty result. Pieces are dealt and ordered
    by what they are, so a table gives the same windows however it is partitioned.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("mark"), F.xxhash64(squeezed(F.col(text_col))).alias("cluster"), n_words(F.col(text_col)).alias("total"))
    cut = numbered_copies(slim).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = table(cut.select("id", "source", "mark", "cluster", "copy", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.col("total") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")), "pieces")
    packs = max(1, -(-pieces.count() // pack_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "cluster", "source", "id", "mark", "piece", "copy"], ascending=[False, *[True] * 6], kind="stable", ignore_index=True)
        windows, offsets = best_fit(pdf["n_tokens"].tolist(), _codes(pdf["source"], False), _codes(pdf["cluster"], True), capacity)
        base = int(pdf["pack"].iloc[0]) << 32
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["n_tokens"].astype("int64"), "bin": np.array(windows, dtype="int64") + base, "bin_offset": np.array(offsets, dtype="int64")})

    id_type = dict(slim.dtypes)["id"]
    out = pieces.withColumn("pack", F.pmod(F.xxhash64("id", "source", "mark", "piece", "copy"), F.lit(packs))).groupBy("pack").applyInPandas(pack, f"id {id_type}, piece int, start long, n_tokens long, bin long, bin_offset long")
    return out.withColumnRenamed("id", id_col)
