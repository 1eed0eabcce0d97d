"""Self-join of documents on the Jaccard similarity of their word shingles.

Documents with equal shingle sets are one class, represented by one document. Candidates are pairs of
representatives that share a band of MinHash values (40 bands of 5: a pair at similarity 0.8 shares none
with probability 1.3e-7). Their MinHash values are compared in steps; after each step a pair is dropped if,
by the Beta posterior of its agreements, it reaches the threshold with a probability below ``tolerance``
(BayesLSH-Lite, Satuluri and Parthasarathy, 2012). What is left is verified on the whole shingle sets.

Buckets of many documents are not joined pair by pair as rows. Their documents form a hot cluster that is
cut into blocks. First tasks compare the signatures of two blocks, and return the documents that any of
the other block may reach; only for those are shingle sets sent to the two blocks, whose task verifies the
pairs in memory and returns sums of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.components import components
from chorale.llm.exact_dedup import drop_rows
from chorale.llm.shared import bounded, is_empty, small_batches, table

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-9
#: Buckets with more documents, or more shingles, are handled as hot clusters.
COLD_DOCS, COLD_SHINGLES = 64, 1 << 21
#: Documents and shingles of a hot cluster's block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20


_POWERS: list[np.ndarray] = []


def _powers(most: int) -> list[np.ndarray]:
    """The powers 0 to ``most``, or more, of the base and of its inverse; kept for the longest piece seen so far."""
    if not _POWERS or len(_POWERS[0]) <= most:
        out = np.ones((2, 1 << max(12, most.bit_length())), dtype=np.uint64)
        out[:, 1:] = np.array([[_BASE], [_INVERSE]], dtype=np.uint64)
        _POWERS[:] = np.multiply.accumulate(out, axis=1)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order, from prefix sums over the bytes in pieces of bounded length."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    power, inverse = _powers(min(len(data), _PIECE))
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + _PIECE]
        space = _SPACE[piece]
        if at + len(piece) < len(data):
            stops = np.flatnonzero(space)
            if len(stops):
                piece, space = piece[: stops[-1] + 1], space[: stops[-1] + 1]
            else:
                rest = np.flatnonzero(_SPACE[data[at:]])
                word = data[at : at + (int(rest[0]) if len(rest) else len(data) - at)]
                parts = [_BYTE[word[k : k + _PIECE]] * power[: len(word[k : k + _PIECE])] for k in range(0, len(word), _PIECE)]
                out.append(_mix(np.array([sum(int(p.sum(dtype=np.uint64)) * (2 * k + 1) for k, p in enumerate(parts)) % 2**64], dtype=np.uint64)))
                at += len(word)
                continue
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * power[: len(piece)], dtype=np.uint64)))
        out.append(_mix((sums[last] - sums[first]) * inverse[first]))
        at += len(piece)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; a shorter text with words is one run, one without has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(_mix(total + np.uint64(width)))


def signature(items: np.ndarray) -> np.ndarray:
    """The low 16 bits of each MinHash value."""
    folded = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for k in range(0, len(folded), 512):
        low = np.minimum(low, (folded[k : k + 512, None] * _MULTIPLY + _ADD).min(axis=0))
    return low.astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    return _mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Agreements among the first n values below which a pair is dropped, by n."""
    out = np.zeros(HASHES + 1, dtype=np.int32)
    for n in range(1, HASHES + 1):
        tail, m = 0.0, 0
        while m <= n:  # with a uniform prior, P(J >= t | m of n agree) = P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, band: np.ndarray | None = None) -> np.ndarray:
    """Which of the pairs (a[left], b[right]) the incremental comparison leaves.

    With ``band`` (of each pair) those that already share an earlier band are dropped too: they belong to it.
    """
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int32)
    for k in range(0, HASHES, STEP):
        same = a[left[alive], k : k + STEP] == b[right[alive], k : k + STEP]
        matches[alive] += same.sum(axis=1, dtype=np.int32)
        keep = matches[alive] >= least[k + STEP]
        if band is not None:
            shared = same.reshape(len(alive), STEP // ROWS, ROWS).all(axis=2)
            earlier = np.arange(k // ROWS, (k + STEP) // ROWS) < band[alive][:, None]
            keep &= ~(shared & earlier).any(axis=1)
        alive = alive[keep]
        if not len(alive):
            break
    return alive


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[left] and b[right], by products of incidence matrices if the pairs are many."""
    if len(left) < 4 * (len(a) + len(b)):
        return np.array([common(a[i], b[j]) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    sizes = [len(x) for x in (*a, *b)]
    values, code = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    width = 4096
    for start in range(0, len(values), width):
        lo, hi = np.searchsorted(code, (start, start + width))
        grid = np.zeros((len(sizes), width), dtype=np.float32)
        grid[owner[lo:hi], code[lo:hi] - start] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out[left, right].astype(np.int64)


class Forest:
    """Union-find that remembers the edges that joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, sigs, bands = [], [], [], []
                for text in part.column("text"):
                    items = shingles(text.as_py() or "", width)
                    sig = signature(items)
                    # two differently mixed sums over the set and its size: 128 bits and a count
                    keys.append(int(_mix(items).sum(dtype=np.uint64)).to_bytes(8) + int(_mix(items + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8) + len(items).to_bytes(4))
                    sizes.append(len(items))
                    sigs.append(sig.tobytes())
                    bands.append(band_keys(sig) if len(items) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "mark", "key", "size", "sig", "bands"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and held and held[-1].column(column)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
        if done.num_rows:
            yield done
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _pairs_in_buckets(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "bucket"):
            bucket, rid, band, size = (t.column(c).to_numpy() for c in ("bucket", "rid", "band", "size"))
            hot = t.column("hot").to_numpy()
            sig = _matrix(t.column("sig"), np.uint16)
            for d in range(1, COLD_DOCS):
                left = np.flatnonzero(bucket[:-d] == bucket[d:]) if d < len(bucket) else np.empty(0, int)
                if not len(left):
                    break
                right = left + d
                fits = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
                fits &= (hot[left] < 0) | (hot[left] != hot[right])
                left, right = left[fits], right[fits]
                for k in range(0, len(left), 8192):
                    i, j = left[k : k + 8192], right[k : k + 8192]
                    alive = surviving(sig, sig, i, j, least, band[i])
                    i, j = i[alive], j[alive]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket[i]), pa.array(np.minimum(rid[i], rid[j])), pa.array(np.maximum(rid[i], rid[j]))], names=["bucket", "a", "b"])

    return run


LINKS = "a long, b long, to_a long, to_b long"


def _verify_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "bucket"):
            out, bucket, sets = [], None, {}
            for key, a, b, weight, items in zip(*[t.column(c) for c in ("bucket", "a", "b", "weight", "items")], strict=True):
                if (key := key.as_py()) != bucket:
                    bucket, sets = key, {}
                if items.is_valid:
                    sets[a.as_py()] = (np.frombuffer(items.as_py(), dtype=np.uint64), weight.as_py())
                    continue
                (x, wx), (y, wy) = sets[a.as_py()], sets[b.as_py()]
                both = common(x, y)
                if both / (len(x) + len(y) - both) >= threshold:
                    out.append((a.as_py(), b.as_py(), wy, wx))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "to_a", "to_b"])

    return run


def _fitting(sizes: list[np.ndarray], sigs: list[np.ndarray], same: bool, threshold: float, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The pairs of two blocks that sizes and signatures leave, 64 documents of the first at a time."""
    for start in range(0, len(sizes[0]), 64):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(start, min(start + 64, len(sizes[0]))), np.arange(len(sizes[1])), indexing="ij"))
        fits = np.minimum(sizes[0][i], sizes[1][j]) >= threshold * np.maximum(sizes[0][i], sizes[1][j]) - 1e-9
        if same:
            fits &= i < j
        i, j = i[fits], j[fits]
        alive = surviving(sigs[0], sigs[1], i, j, least)
        if len(alive):
            yield start, i[alive], j[alive]


def _reach_blocks(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hot, first, second = key
        one, two = pdf[pdf["block"] == first], pdf[pdf["block"] == second]
        sigs = [np.frombuffer(b"".join(x["sig"]), dtype=np.uint16).reshape(len(x), HASHES) for x in (one, two)]
        hit = [np.zeros(len(x), dtype=bool) for x in (one, two)]
        for _, i, j in _fitting([x["size"].to_numpy() for x in (one, two)], sigs, first == second, threshold, least):
            hit[0][i] = hit[1][j] = True
        found = pd.concat([one[hit[0]], two[hit[1]]]).drop_duplicates("rid")
        return found[["rid", "block"]].assign(hot=hot, first=first, second=second)

    return run


def _verify_blocks(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, first, second = key
        one, two = pdf[pdf["block"] == first], pdf[pdf["block"] == second]
        rids, weights = [x["rid"].to_numpy() for x in (one, two)], [x["weight"].to_numpy() for x in (one, two)]
        sets = [[np.frombuffer(v, dtype=np.uint64) for v in x["items"]] for x in (one, two)]
        sigs = [np.frombuffer(b"".join(x["sig"]), dtype=np.uint16).reshape(len(x), HASHES) for x in (one, two)]
        sizes = [np.array([len(v) for v in x]) for x in sets]
        links, forest = {}, Forest()
        for start, i, j in _fitting(sizes, sigs, first == second, threshold, least):
            both = overlaps(sets[0][start : start + 64], sets[1], i - start, j)
            yes = both / (sizes[0][i] + sizes[1][j] - both) >= threshold
            for x, y in zip(i[yes].tolist(), j[yes].tolist(), strict=True):
                a, b = int(rids[0][x]), int(rids[1][y])
                links[a] = links.get(a, 0) + int(weights[1][y])
                links[b] = links.get(b, 0) + int(weights[0][x])
                forest.join(a, b)
        rows = [(a, None, n, None) for a, n in links.items()] + [(a, b, 0, 0) for a, b in forest.edges]
        return pd.DataFrame(rows, columns=["a", "b", "to_a", "to_b"]).astype("Int64")

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                items = [shingles(t.as_py() or "", width).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("weight"), pa.array(items, pa.binary())], names=["rid", "weight", "items"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: id, mark, class_id, set_id, set_size, n_links, kept.

    set_id is the smallest id with the same shingle set and set_size the rows that have it; n_links counts
    the other rows whose similarity is at least ``threshold``, copies included; class_id is the smallest id
    among all rows connected by links, and kept marks one row of each class. Texts of fewer than ``width``
    words are one shingle; null texts and texts without words have the same, empty set and are linked to each
    other only. Null ids come last where the smallest is chosen; repeated rows are copies like others.
    ``mark`` is a hash of the text. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(slim.dtypes)["id"]
    made = slim.mapInArrow(_features(width), f"id {id_type}, mark long, key binary, size int, sig binary, bands array<long>")
    features = table(made.withColumn("rid", F.monotonically_increasing_id()), "features")

    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first")
    classes = features.groupBy("key").agg(first, F.count("*").alias("weight")).where("weight > 1")
    classes = table(classes.select("key", F.col("first.id").alias("set_id"), F.col("first.rid").alias("set_rid"), "weight"), "classes")
    ranked = features.join(bounded(classes), "key", "left").withColumns({"weight": F.coalesce("weight", F.lit(1).cast("long")), "set_rid": F.coalesce("set_rid", "rid"), "set_id": F.when(F.col("set_rid").isNull(), F.col("id")).otherwise(F.col("set_id"))})
    leaders = ranked.where("rid = set_rid")

    bands = leaders.select("rid", "size", F.posexplode("bands").alias("band", "bucket"))
    many = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("rid").alias("head"))
    many = table(many.where("n > 1").select("bucket", "head", ((F.col("n") > COLD_DOCS) | (F.col("total") > COLD_SHINGLES)).alias("is_hot")), "buckets")
    members = table(bands.join(bounded(many), "bucket").select("bucket", "rid", "band", "head", "is_hot"), "members")

    hot = components(members.where("is_hot"), "rid", "head").withColumnRenamed("node", "rid").withColumnRenamed("label", "hot")
    needed = table(members.select("rid").distinct(), "needed")
    sigs = table(leaders.join(bounded(needed), "rid", "left_semi").select("rid", "id", "mark", "size", "weight", "sig").join(bounded(hot), "rid", "left"), "sigs")
    cold = members.where("NOT is_hot").join(sigs, "rid").select("bucket", "rid", "band", "size", F.coalesce("hot", F.lit(-1).cast("long")).alias("hot"), "sig")
    pairs = table(cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairs_in_buckets(threshold, tolerance), "bucket long, a long, b long"), "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).union(hot.select("rid")).distinct()
    wanted = table(sigs.join(wanted, "rid", "left_semi").select("rid", F.col("id").alias("_id"), F.col("mark").alias("_mark"), "weight"), "wanted")
    side = bounded(wanted)
    texts = slim.join(side, slim["mark"].eqNullSafe(side["_mark"]) & slim["id"].eqNullSafe(side["_id"])).select("rid", "weight", "text")
    sets = table(texts.mapInArrow(_sets(width), "rid long, weight long, items binary"), "sets")
    if sets.count() > wanted.count():  # rows that repeat id and text
        sets = table(sets.groupBy("rid").agg(F.first("weight").alias("weight"), F.first("items").alias("items")), "sets")

    ends = pairs.select("bucket", F.explode(F.array("a", "b")).alias("rid")).distinct().join(sets, "rid")
    told = ends.select("bucket", F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), "weight", "items")
    asked = pairs.select("bucket", "a", "b", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("items"))
    links = told.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("b").isNotNull()).mapInArrow(_verify_pairs(threshold), LINKS)
    if not is_empty(hot):
        links = links.unionByName(_hot_links(sigs, sets, threshold, tolerance))
    links = table(links, "links")

    labels = components(links, "a", "b")
    counts = links.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("to_a").alias("n")), F.struct(F.col("b").alias("rid"), F.col("to_b").alias("n")))).alias("e")).select("e.*").where("rid IS NOT NULL").groupBy("rid").agg(F.sum("n").alias("links"))
    named = labels.join(ranked.join(bounded(labels), F.col("rid") == F.col("node"), "left_semi").select(F.col("rid").alias("node"), "set_id"), "node")
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("set_id").isNull().alias("no_id"), F.col("set_id").alias("id"), F.col("node").alias("rid"))).alias("head"))
    linked = named.join(heads, "label").join(counts, named["node"] == counts["rid"], "left").select("node", F.col("head.id").alias("class_id"), F.col("head.rid").alias("class_rid"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    linked = bounded(table(linked, "linked"))
    out = ranked.select("id", "mark", "rid", "set_id", "set_rid", "weight").join(linked, F.col("set_rid") == F.col("node"), "left")
    return out.select(
        F.col("id").alias(id_col), "mark",
        F.when(F.col("node").isNull(), F.col("set_id")).otherwise(F.col("class_id")).alias("class_id"), "set_id", F.col("weight").alias("set_size"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        (F.col("rid") == F.coalesce("class_rid", "set_rid")).alias("kept"),
    )


def _hot_links(sigs: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links inside hot clusters, block against block."""
    hot = sigs.where("hot IS NOT NULL")
    blocks = hot.groupBy("hot").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = hot.join(bounded(table(blocks, "blocks")), "hot").withColumn("block", F.expr("CAST(pmod(xxhash64(rid), blocks) AS INT)"))
    own = table(own.select("hot", "rid", "block", "blocks", "size", "sig"), "own")
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("hot", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rid", "size", "sig")
    reached = table(spread.groupBy("hot", "first", "second").applyInPandas(_reach_blocks(threshold, tolerance), "rid long, block int, hot long, first int, second int"), "reached")
    asked = reached.join(own.select("rid", "sig").join(sets, "rid"), "rid")
    return asked.groupBy("hot", "first", "second").applyInPandas(_verify_blocks(threshold, tolerance), LINKS)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of :func:`jaccard_join`, all columns kept, whatever their names.

    Texts without words, null ones too, are one class, and rows that repeat are copies, so one of each stays.
    An empty table gives an empty result.
    """
    joined = jaccard_join(docs, id_col, text_col, **options)
    verdicts = table(joined.select(F.col(id_col).alias("_id"), F.col("mark").alias("_fingerprint"), F.col("kept").alias("_kept")), "verdicts")
    return drop_rows(docs, F.col(id_col), F.xxhash64(F.col(text_col)), verdicts)
