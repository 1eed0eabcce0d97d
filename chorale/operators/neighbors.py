"""All-pairs work in blocks: k nearest neighbours and mean distances to clusters.

Both sides are cut into blocks by a hash of the id; every task gets one pair of blocks and goes through it in
tiles that stay in the processor's cache, keeping the k best of each point or its sums. Pairs never become rows,
nothing is broadcast, and a point is sent once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.vec import doubles
from chorale.operators.metrics import bundle, confusion

#: Points of a block; a task has one of queries and one, twice as large, of those they are compared with.
BLOCK = 1 << 15
#: Points of a tile: queries, others, and others of the first tile, which gives the first bounds.
TILE_Q, TILE_T, TILE_FIRST = 1 << 8, 1 << 12, 1 << 9


def _most(df: DataFrame, keys: tuple[str, ...] = ()) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _blocks(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def _dealt(df: DataFrame, side: int, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    placed = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"))
    return placed.withColumn("side", F.lit(side)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _sides(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Queries and others of a pair of blocks, the others in order of id."""
    q, t = (group.filter(pc.equal(group.column("side"), k)) for k in (0, 1))
    return q, t.take(pc.sort_indices(t.column("id")))


def _matrix(side: pa.Table) -> np.ndarray:
    return side.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)


def _codes(q: pa.ChunkedArray, t: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of both sides as equal numbers; a null equals nothing."""
    known = pc.unique(t)
    code = lambda x, none: pc.fill_null(pc.index_in(x, known, skip_nulls=True), none).to_numpy().astype(np.int64)
    return code(q, -1), code(t, -2)


class _Space:
    """Distances of queries and others: ``part`` is what a product gives, and grows with the distance."""

    def __init__(self, q: np.ndarray, t: np.ndarray, metric: str) -> None:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        self.cosine = metric == "cosine"
        self.q, self.t = (-unit(q), unit(t)) if self.cosine else (-2 * q, t)
        self.q2, self.t2 = (None, None) if self.cosine else ((q * q).sum(1), (t * t).sum(1))
        self.q4, self.t4 = (self.q.astype("f4"), self.t.astype("f4")) if self.cosine else (self.q, self.t)
        self.slack = (q.shape[1] + 4) * 2.0**-23 if self.cosine else 0.0  # no product of unit vectors in single precision is further off

    def rough(self, a: slice, b: slice) -> np.ndarray:
        """``part`` within ``slack``."""
        return self.q4[a] @ self.t4[b].T if self.cosine else self.part(a, b)

    def exact(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Distances of single pairs."""
        part = np.einsum("ij,ij->i", self.q[row], self.t[col])
        return self.distance(part if self.cosine else part + self.t2[col], row)

    def part(self, a: slice, b: slice) -> np.ndarray:
        out = self.q[a] @ self.t[b].T
        if not self.cosine:
            out += self.t2[b]
        return out

    def distance(self, part: np.ndarray, row: np.ndarray) -> np.ndarray:
        return 1 + part if self.cosine else np.sqrt(np.maximum(part + self.q2[row], 0))

    def bound(self, far: np.ndarray, row: np.ndarray) -> np.ndarray:
        """No ``part`` above it has a distance that rounds to less than ``far``."""
        return far - 1 - 4e-10 if self.cosine else far * far - self.q2[row]


def _k_best(space: _Space, k: int, q_code: np.ndarray, t_code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, other, distance) of the k nearest others in tiles of queries; of equal distances, rounded to 9 places, the first ones."""
    n, m = len(space.q), len(space.t)
    order = np.argsort(t_code, kind="stable")
    begin, end = (np.searchsorted(t_code[order], q_code, side=s) for s in ("left", "right"))
    edges = [0, *range(min(TILE_FIRST, m), m, TILE_T), m]
    for low in range(0, n, TILE_Q):
        rows = np.arange(low, min(low + TILE_Q, n))
        own = [(np.flatnonzero(end[rows] - begin[rows] > j), j) for j in range(int((end[rows] - begin[rows]).max(initial=0)))]
        at = [(r, order[begin[rows[r]] + j]) for r, j in own]  # the point itself, however often it is there
        row, col, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        far = np.full(len(rows), np.inf)
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            part = space.rough(slice(low, low + len(rows)), slice(first, last))
            for r, c in at:
                here = (c >= first) & (c < last)
                part[r[here], c[here] - first] = np.inf
            limit = space.bound(far, rows) + space.slack
            fresh = np.flatnonzero(~np.isfinite(far)) if last - first > k else []
            if len(fresh):  # nothing is known of them yet: what cannot be among the k best of this tile goes
                kth = np.partition(part[fresh], k - 1, axis=1)[:, k - 1]
                limit[fresh] = kth + 2 * space.slack + 1e-8 * (1 + np.abs(kth))  # what rounds to the same distance stays
            r, c = np.divmod(np.flatnonzero(part <= limit.astype(part.dtype)[:, None]), last - first)
            r, c = r[np.isfinite(part[r, c])], c[np.isfinite(part[r, c])]
            d = np.round(space.exact(rows[r], c + first), 9)
            good = d < far[r]
            if not good.any():
                continue
            row, col, dist = np.concatenate((row, r[good])), np.concatenate((col, c[good] + first)), np.concatenate((dist, d[good]))
            best = np.lexsort((col, dist, row))
            row, col, dist = row[best], col[best], dist[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, dist = row[place < k], col[place < k], dist[place < k]
            full = place[place < k] == k - 1
            far[row[full]] = dist[full]
        yield rows[row], col, dist


def nearest(queries: DataFrame, train: DataFrame, k: int, keys: tuple[str, ...] = (), metric: str = "cosine", block: int = BLOCK, apart: str | None = None, most: tuple[int, int] | None = None) -> DataFrame:
    """(keys, id, label, rank, neighbour, neighbour_label, dist): the ``k`` nearest of ``train`` (keys, id, label, vec).

    A point is no neighbour of itself, nor of those with its value of ``apart``. Distances are compared after rounding to 9 places, ties go to the
    smallest id, so that any engine gives the same neighbours. ``most`` queries and points of one key are counted here if they are not known.
    """
    cols = [*keys, "id", "label", doubles("vec").alias("vec"), *([F.col(apart).alias("_apart")] if apart else [])]
    if most is None:
        q = _most(queries, keys)
        most = q, q if queries is train else _most(train, keys)
    n_q, n_t = _blocks(most[0], block), _blocks(most[1], 2 * block)
    both = _dealt(queries.select(*cols), 0, "qb", n_q, "tb", n_t).unionByName(_dealt(train.select(*cols), 1, "tb", n_t, "qb", n_q))
    kinds = dict(both.dtypes)

    def pair(group: pa.Table) -> pa.Table:
        q, t = _sides(group)
        found = []
        if len(q) and len(t):
            x, y = _matrix(q), _matrix(t)
            codes = _codes(q.column("id"), t.column("id"))
            sets = [(np.arange(len(q)), np.arange(len(t)))]
            if apart:
                mine, theirs = _codes(q.column("_apart"), t.column("_apart"))
                sets = [(np.flatnonzero(mine == c), np.flatnonzero(theirs != c)) for c in np.unique(mine)]
            for a, b in sets:
                if len(b):
                    found += [(a[r], b[c], d) for r, c, d in _k_best(_Space(x[a], y[b], metric), k, codes[0][a], codes[1][b])]
        row, at, dist = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        of_q, of_t = q.select([*keys, "id", "label"]).take(row), t.select(["id", "label"]).take(at)
        return pa.Table.from_arrays([*of_q.columns, *of_t.columns, pa.chunked_array([dist])], names=[*keys, "id", "label", "neighbour", "neighbour_label", "dist"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"id {kinds['id']}", f"label {kinds['label']}", f"neighbour {kinds['id']}", f"neighbour_label {kinds['label']}", "dist double"])
    found = both.groupBy(*keys, "qb", "tb").applyInArrow(pair, schema)
    rank = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("dist", "neighbour"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, ks: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, id, label, pred): majority label for every k from one ranking; ties go to the smallest label."""
    spread = neighbours.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    votes = spread.groupBy(*keys, "k", "id", "label", "neighbour_label").agg(F.count("*").alias("votes"))
    return votes.groupBy(*keys, "k", "id", "label").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("neighbour_label").alias("l")))["l"].alias("pred"))


def holdout(points: DataFrame, ks: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics for every k (and key): neighbours of the rows with is_test among the others."""
    counts = points.groupBy(*keys, "is_test").agg(F.count("*").alias("n")).groupBy("is_test").agg(F.max("n")).collect()  # two rows, counted in one job
    most = {r[0]: r[1] for r in counts}
    found = nearest(points.where("is_test"), points.where("NOT is_test"), max(ks), keys, most=(most.get(True, 0), most.get(False, 0)))
    return bundle(confusion(vote(found, ks, keys), "label", "pred", (*keys, "k")), (*keys, "k"))


def cross_validated(points: DataFrame, ks: list[int]) -> DataFrame:
    """(k, cv_mean, cv_std): accuracy of each fold among the others, from one search; ``points`` has fold."""
    told = vote(nearest(points, points, max(ks), apart="fold"), ks).join(points.select("id", "fold"), "id")
    scores = told.groupBy("k", "fold").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("score"))
    return scores.groupBy("k").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def cluster_distances(points: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(id, label, other, total, n): summed distance of every point to every cluster, itself left out."""
    cols = ["id", "label", doubles("vec").alias("vec")]
    most = _most(points)
    n_q, n_t = _blocks(most, block), _blocks(most, 2 * block)
    both = _dealt(points.select(*cols), 0, "qb", n_q, "tb", n_t).unionByName(_dealt(points.select(*cols), 1, "tb", n_t, "qb", n_q))
    kinds = dict(both.dtypes)

    def pair(group: pa.Table) -> pa.Table:
        q, t = _sides(group)
        if not len(q) or not len(t):
            return pa.Table.from_arrays([q.column("id").slice(0, 0), q.column("label").slice(0, 0), t.column("label").slice(0, 0), pa.chunked_array([np.empty(0)]), pa.chunked_array([np.empty(0, np.int64)])], names=["id", "label", "other", "total", "n"])
        t = t.take(pc.sort_indices(t, [("label", "ascending"), ("id", "ascending")]))
        others = pc.unique(t.column("label"))
        code = pc.index_in(t.column("label"), others).to_numpy()
        q_code, t_code = _codes(q.column("id"), t.column("id"))
        space = _Space(_matrix(q), _matrix(t), metric)
        counts = np.tile(np.bincount(code, minlength=len(others)), (len(q), 1))
        order = np.argsort(t_code, kind="stable")
        begin, end = (np.searchsorted(t_code[order], q_code, side=s) for s in ("left", "right"))
        own_row = np.repeat(np.arange(len(q)), end - begin)
        own_col = order[np.repeat(begin, end - begin) + np.arange(len(own_row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)]
        np.subtract.at(counts, (own_row, code[own_col]), 1)
        sums = np.zeros((len(q), len(others)))
        for low in range(0, len(q), TILE_Q):
            rows = np.arange(low, min(low + TILE_Q, len(q)))
            mine = slice(*np.searchsorted(own_row, (rows[0], rows[-1] + 1)))
            for first in range(0, len(t), TILE_T):
                d = space.distance(space.part(slice(low, low + len(rows)), slice(first, first + TILE_T)), rows[:, None])
                here = (own_col[mine] >= first) & (own_col[mine] < first + TILE_T)
                d[own_row[mine][here] - low, own_col[mine][here] - first] = 0
                of = code[first : first + TILE_T]
                edges = np.flatnonzero(np.diff(of, prepend=-1))  # labels are in order
                sums[low : low + len(rows), of[edges]] += np.add.reduceat(d, edges, axis=1)
        row, col = np.repeat(np.arange(len(q)), len(others)), np.tile(np.arange(len(others)), len(q))
        of_q = q.select(["id", "label"]).take(row)
        return pa.Table.from_arrays([*of_q.columns, pa.chunked_array([others.take(pa.array(col))]), pa.chunked_array([sums.ravel()]), pa.chunked_array([counts.ravel()])], names=["id", "label", "other", "total", "n"])

    schema = f"id {kinds['id']}, label {kinds['label']}, other {kinds['label']}, total double, n long"
    parts = both.groupBy("qb", "tb").applyInArrow(pair, schema)
    return parts.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
