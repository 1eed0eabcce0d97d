"""Gradient boosting with histograms: one aggregate a level for the trees of all labels.

Dimensions are cut once into quantile bins; a point is a row of bytes. In every round each label gets a tree, and
a level of all these trees takes one pass: tasks sum gradients and hessians of the softmax loss by (label, node,
dimension, bin), the sums meet by (label, node), and the best cuts come from the sums. Only left children are
summed; the right one is its parent less its sibling. Sums stay on the executors; what reaches the driver is a cut
and two totals for each label and node.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.tables import bare
from chorale.functions.vec import doubles, long_form

#: Points of a block, and rounds after which the points' scores are taken anew from all trees.
BLOCK, STORED = 1 << 13, 10
#: Columns of blocks with scores (point, label).
SCORED = "n int, bins binary, y binary, f binary"


@dataclass
class Trees:
    """Trees of equal depth as arrays (tree, node); the children of node i are 2 i + 1 and 2 i + 2, a leaf has dimension -1."""

    depth: int
    dim: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def blank(n: int, depth: int) -> Trees:
        nodes = 2 ** (depth + 1) - 1
        return Trees(depth, np.full((n, nodes), -1, np.int32), np.zeros((n, nodes), np.uint8), np.zeros((n, nodes)))

    def walk(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node (point, tree) where each point is after ``levels`` levels, or its leaf."""
        tree, point = np.arange(len(self.dim))[None, :], np.arange(len(bins))[:, None]
        at = np.zeros((len(bins), len(self.dim)), np.int64)
        for _ in range(self.depth if levels is None else levels):
            dim = self.dim[tree, at]
            right = bins[point, np.maximum(dim, 0)] > self.cut[tree, at]
            at = np.where(dim >= 0, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.dim))[None, :], self.walk(bins)]


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by label; second ones are doubled, as is usual with a diagonal one."""
    p = softmax(f)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g, np.maximum(2 * p * (1 - p), 1e-16)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, cells: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums (cell, dimension, bin, 2) over the points that are at each listed (label, node), in order of labels."""
    columns = np.ascontiguousarray(bins.T)
    out = np.zeros((len(cells), len(columns), n_bins, 2))
    for k in np.unique(cells[:, 0]):
        mine = np.flatnonzero(cells[:, 0] == k)
        place = np.full(max(int(at[:, k].max(initial=0)), int(cells[mine, 1].max())) + 1, -1)
        place[cells[mine, 1]] = np.arange(len(mine))
        here = place[at[:, k]]
        rows = np.flatnonzero(here >= 0)
        first, own, index = here[rows] * n_bins, columns[:, rows], np.empty(len(rows), np.int64)
        both, sums = (g[rows, k], h[rows, k]), np.empty((2, len(columns), len(mine) * n_bins))
        for d, x in enumerate(own):  # the sums of a dimension stay in the processor's cache
            np.add(first, x, out=index)
            for j, weights in enumerate(both):
                sums[j, d] = np.bincount(index, weights=weights, minlength=sums.shape[2])
        out[mine] = sums.reshape(2, len(columns), len(mine), n_bins).transpose(2, 1, 3, 0)
    return out


def best_cuts(sums: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, dimension, last bin on the left) of each of the sums (..., dimension, bin, 2); the first of equal ones."""
    left = np.cumsum(sums, axis=-2)[..., :-1, :]
    whole = sums.sum(axis=-2, keepdims=True)
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), -np.inf)
    flat = gain.reshape(*gain.shape[:-2], gain.shape[-2] * gain.shape[-1])
    best = flat.argmax(axis=-1)
    return np.take_along_axis(flat, best[..., None], -1)[..., 0] / 2, best // gain.shape[-1], best % gain.shape[-1]


@dataclass
class Boosted:
    """Trees in the order of rounds and labels, and the bins' edges."""

    edges: list[np.ndarray]
    labels: int
    rounds: list[Trees] = field(default_factory=list)

    def bins(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, vectors[:, d], side="left") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def scores(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.labels))
        for trees in self.rounds[since:]:
            out += trees.scores(bins)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (…, vec) with the number of the likeliest label as prediction."""

        @F.pandas_udf("double")
        def predict(v):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype=float)
            return pd.Series(self.scores(self.bins(np.stack(v.to_numpy()).astype(float))).argmax(axis=1).astype(float))

        return rows.withColumn("prediction", predict(doubles("vec")))


#: From trees, level and cells (label, node) to all cells of the level, both children of a parent, and what :meth:`Boosting.cuts` tells of them.
Look = Callable[[Trees, int, np.ndarray], tuple[np.ndarray, ...]]


@dataclass
class Boosting:
    """``fit`` on (y, vec): ``rounds`` of a tree for each label, of ``depth`` levels, shrunk by ``rate``."""

    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1.0
    n_bins: int = 64

    def edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Quantiles of each dimension, each value once; a point's bin is how many of them are below it."""
        shares = F.array(*[F.lit(k / self.n_bins) for k in range(1, self.n_bins)])
        found = long_form(rows, "vec").groupBy("dim").agg(F.percentile_approx("x", shares, F.lit(10_000)).alias("q")).orderBy("dim").collect()  # a row for each dimension
        return [np.unique(np.array(r["q"], dtype=float)) for r in found]

    def fit(self, rows: DataFrame) -> Boosted:
        labels = int(rows.agg(F.max("y")).first()[0]) + 1
        model = Boosted(self.edges(rows), labels)
        kept = rows.select(F.col("y").cast("int").alias("y"), doubles("vec").alias("vec")).mapInArrow(_to_blocks(model), "n int, bins binary, y binary").persist()
        blocks = bare(kept)
        parts = blocks.rdd.getNumPartitions()
        while len(model.rounds) < self.rounds:  # scores by all trees up to here, every STORED rounds from the blocks, so that lineage does not grow
            n = min(STORED, self.rounds - len(model.rounds))
            state = blocks.mapInArrow(_scored(model), SCORED)
            if parts == 1:  # all sums are those of one task, which need not send them
                model.rounds += [pickle.loads(r["trees"]) for r in state.mapInArrow(_grown(self, model, n), "trees binary").collect()]
                continue
            last = None
            for k in range(n):
                state = state.persist()
                scored = bare(state)
                far = _Far(self, scored, model)
                model.rounds.append(self.grow(model, far))
                far.done()
                if last is not None:
                    last.unpersist()
                last = state
                if k < n - 1:
                    state = scored.mapInArrow(_scored(Boosted(model.edges, model.labels, model.rounds[-1:])), SCORED)
            last.unpersist()
        kept.unpersist()
        return model

    def grow(self, model: Boosted, look: Look) -> Trees:
        """A tree for each label, level by level; ``look`` at the listed (label, node) of a level, the root or left children, is the only one at the points."""
        trees = Trees.blank(model.labels, self.depth)
        asked = np.stack([np.arange(model.labels), np.zeros(model.labels, np.int64)], axis=1)
        for level in range(self.depth):
            cells, gain, dim, cut, total, low = look(trees, level, asked)
            label, node = cells.T
            trees.value[label, node] = self.weight(total)
            split = gain > 1e-9
            label, node, dim, cut, total, low = label[split], node[split], dim[split], cut[split], total[split], low[split]
            trees.dim[label, node], trees.cut[label, node] = dim, cut
            trees.value[label, 2 * node + 1], trees.value[label, 2 * node + 2] = self.weight(low), self.weight(total - low)
            if not len(label):
                break
            asked = np.stack([label, 2 * node + 1], axis=1)
        return trees

    def cuts(self, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gain, dimension, cut, total, total on the left) of each of the sums."""
        gain, dim, cut = best_cuts(sums, self.l2, self.least_hessian)
        whole = sums[np.arange(len(dim)), dim]
        low = (whole * (np.arange(whole.shape[1])[None, :] <= cut[:, None])[..., None]).sum(axis=1)
        return gain, dim, cut, sums[:, 0].sum(axis=-2), low  # every dimension has every point

    def weight(self, total: np.ndarray) -> np.ndarray:
        return -self.rate * total[..., 0] / (total[..., 1] + self.l2)


def _to_blocks(model: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column(0).to_numpy().astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([model.bins(vectors).tobytes()]), pa.array([y.tobytes()])], names=["n", "bins", "y"])

    return run


def _arrays(batch: pa.RecordBatch, model: Boosted) -> Iterator[tuple[np.ndarray, ...]]:
    for k in range(batch.num_rows):
        n = batch.column(0)[k].as_py()
        bins = np.frombuffer(batch.column(1)[k].as_py(), np.uint8).reshape(n, -1)
        y = np.frombuffer(batch.column(2)[k].as_py(), "<i4")
        f = np.frombuffer(batch.column(3)[k].as_py(), "<f8").reshape(n, model.labels) if batch.num_columns > 3 else None
        yield bins, y, f


def _scored(model: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with scores by the trees of ``model``, added to those that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [((0.0 if f is None else f) + model.scores(bins)).astype("<f8").tobytes() for bins, _, f in _arrays(batch, model)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(f, pa.binary())], names=["n", "bins", "y", "f"])

    return run


def _grown(boosting: Boosting, model: Boosted, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``n`` more rounds over the blocks of the only partition."""
    plain = Boosted(model.edges, model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in batches for x in _arrays(batch, plain)]
        scores = [f.copy() for _, _, f in blocks]
        for _ in range(n):
            both = [gradients(f, y) for f, (_, y, _) in zip(scores, blocks, strict=True)]

            def sums_of(trees: Trees, level: int, cells: np.ndarray, both: list = both) -> np.ndarray:
                return sum(histograms(bins, g, h, trees.walk(bins, level), cells, boosting.n_bins) for (bins, _, _), (g, h) in zip(blocks, both, strict=True))

            trees = boosting.grow(plain, _Near(boosting, sums_of))
            for f, (bins, _, _) in zip(scores, blocks, strict=True):
                f += trees.scores(bins)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])

    return run


class _Near:
    """Cuts from sums that are at hand."""

    def __init__(self, boosting: Boosting, sums_of: Callable[[Trees, int, np.ndarray], np.ndarray]) -> None:
        self.boosting, self.sums_of, self.parents = boosting, sums_of, {}

    def __call__(self, trees: Trees, level: int, asked: np.ndarray) -> tuple[np.ndarray, ...]:
        cells, sums = asked, self.sums_of(trees, level, asked)
        if level:
            whole = np.stack([self.parents[label, (node - 1) // 2] for label, node in asked.tolist()])
            cells, sums = np.concatenate((asked, asked + [0, 1])), np.concatenate((sums, whole - sums))
        self.parents = dict(zip(map(tuple, cells.tolist()), sums, strict=True))
        return cells, *self.boosting.cuts(sums)


class _Far:
    """Cuts from sums over all tasks; a job for each level, whose sums stay on the executors for the next."""

    def __init__(self, boosting: Boosting, state: DataFrame, model: Boosted) -> None:
        self.boosting, self.state, self.parents, self.kept = boosting, state, None, None
        self.width, self.plain = len(model.edges), Boosted([], model.labels)

    def __call__(self, trees: Trees, level: int, asked: np.ndarray) -> tuple[np.ndarray, ...]:
        boosting, plain, nodes = self.boosting, self.plain, 2 ** (self.boosting.depth + 1)
        shape = (self.width, boosting.n_bins, 2)
        own = asked[:, 0] * nodes + asked[:, 1]
        keys = asked[:, 0] * nodes + (asked[:, 1] - 1) // 2 if level else own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(asked), *shape))
            for batch in batches:
                for bins, y, f in _arrays(batch, plain):
                    g, h = gradients(f, y)
                    out += histograms(bins, g, h, trees.walk(bins, level), asked, boosting.n_bins)
            for k, x in enumerate(out):
                yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int32()), pa.array([False]), pa.array([x.tobytes()], pa.binary())], names=["cell", "whole", "sums"])

        def merge(group: pa.Table) -> pa.Table:
            whole = group.column("whole").to_pylist()
            each = [np.frombuffer(x.as_py()).reshape(shape) for x in group.column("sums")]
            parts = [x for x, w in zip(each, whole, strict=True) if not w]
            key = group.column("cell")[0].as_py()
            label, node = divmod(key, nodes)
            cells, sums = [], np.empty((0, *shape))
            if parts:  # else the node is a leaf
                sums = sum(parts)[None]
                cells = [key]
                if level:
                    cells, sums = [label * nodes + 2 * node + 1, label * nodes + 2 * node + 2], np.concatenate((sums, each[whole.index(True)][None] - sums))
            gain, dim, cut, total, low = boosting.cuts(sums)
            packed = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
            return pa.table({"cell": pa.array(cells, pa.int32()), "sums": packed(sums), "gain": gain, "dim": pa.array(dim, pa.int32()), "cut": pa.array(cut, pa.int32()), "total": packed(total), "low": packed(low)})

        rows = self.state.mapInArrow(run, "cell int, whole boolean, sums binary")
        if level:
            rows = rows.unionByName(self.parents.select("cell", F.lit(True).alias("whole"), "sums"))
        level_ = rows.groupBy("cell").applyInArrow(merge, "cell int, sums binary, gain double, dim int, cut int, total binary, low binary").persist()
        found = sorted(level_.drop("sums").collect())  # labels x nodes
        self.done()
        self.parents, self.kept = bare(level_), level_
        cell = np.array([r["cell"] for r in found])
        pair = lambda c: np.stack([np.frombuffer(r[c]) for r in found])
        return np.stack(np.divmod(cell, nodes), axis=1), np.array([r["gain"] for r in found]), np.array([r["dim"] for r in found]), np.array([r["cut"] for r in found]), pair("total"), pair("low")

    def done(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
