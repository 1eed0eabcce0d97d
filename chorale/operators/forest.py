"""Random forests whose trees are grown, kept and asked by parts on the executors.

Dimensions are cut once into quantile bins; a point is a row of bytes. How often a point is in the bag of a tree, and
which dimensions a node may split by, are hashes of the point, tree and node, so a tree is the same however the points
lie. A node with more than ROWS_IN_CELL points in its bag is split by a job for each level, over the counts of all
tasks; the points of any smaller one, a cell, meet in a task that grows it down to its leaves. So a table of a usual
size takes one shuffle, whatever the depth. Cells stay on the executors: points to be predicted are sent to the cells
where they fall, and their votes are added.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.vec import doubles
from chorale.operators.boosting import Boosted, Boosting

#: Points of a block; points in the bag of a node that one task grows; counts that a task looks at, or sends, at a time.
BLOCK, ROWS_IN_CELL, LOOK, SEND = 1 << 13, 1 << 16, 1 << 20, 1 << 23
#: Points of a node whose cuts are compared one by one, without counts of every bin.
FEW = 8
#: Points, once for each tree, that make a task.
ROWS_IN_TASK = 20_000
#: Votes are whole numbers, so that their sum has no order.
ONE = 1 << 30
_BAG = np.cumsum([np.exp(-1) / factorial(k) for k in range(16)])
_GOLD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each point is in the bag of a tree: Poisson with mean 1, as with Spark ML."""
    own = mixed(np.array([(seed * _GOLD + tree + 1) % (1 << 64)], np.uint64))
    return np.searchsorted(_BAG, (mixed(keys ^ own) >> np.uint64(11)) / 2.0**53, side="right").astype(np.uint8)


def subsets(nodes: np.ndarray, tree: int, width: int, n: int, seed: int) -> np.ndarray:
    """``n`` dimensions (node, n) in order, for each node of a tree."""
    own = mixed(mixed(np.array([(seed * _GOLD + tree + 1) % (1 << 64)], np.uint64)) + nodes.astype(np.uint64))
    drawn = mixed(own[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_GOLD))
    return np.sort(np.argpartition(drawn, n - 1, axis=1)[:, :n], axis=1)


def counts(bins: np.ndarray, y: np.ndarray, times: np.ndarray, slot: np.ndarray, dims: np.ndarray, labels: int, n_bins: int) -> np.ndarray:
    """Points in the bag (slot, dimension of the slot's, bin, label)."""
    n, width = dims.shape
    index = (slot[:, None] * width + np.arange(width)) * n_bins + bins[np.arange(len(bins))[:, None], dims[slot]]
    index = index * labels + y[:, None]
    return np.bincount(index.ravel(), weights=np.repeat(times, width), minlength=n * width * n_bins * labels).reshape(n, width, n_bins, labels)


def best_cuts(left: np.ndarray, whole: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, which dimension, which cut) of each node, from the counts on the left of each cut (node, dimension, cut,
    label) and all of the node (node, label): the fall in Gini's impurity; the first of equal ones."""
    m, width, n_cuts, labels = left.shape
    left = left.reshape(m, -1, labels)
    square, all_ = weights**2, whole * weights
    n, w, both = np.moveaxis(left @ np.stack([np.ones_like(whole), np.broadcast_to(weights, whole.shape), whole * square], axis=2), 2, 0)
    own = (left * left) @ square
    n_all, w_all, own_all = (x[:, None] for x in (whole.sum(axis=1), all_.sum(axis=1), (all_**2).sum(axis=1)))
    fall = own / np.maximum(w, 1e-300) + (own_all - 2 * both + own) / np.maximum(w_all - w, 1e-300) - own_all / w_all
    gain = np.where((n >= least) & (n_all - n >= least), np.round(fall / w_all, 12), -np.inf)
    best = gain.argmax(axis=1)
    return gain[np.arange(m), best], best // n_cuts, best % n_cuts


def few_cuts(bins: np.ndarray, y: np.ndarray, times: np.ndarray, slot: np.ndarray, dims: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (node, dimension, cut) at the bins of the nodes' own points, in order, and the counts on their left; for nodes of FEW points at most, by slot."""
    place = np.arange(len(slot)) - np.searchsorted(slot, slot)
    at = np.full((len(dims), dims.shape[1], FEW), 255, np.uint8)
    at[slot, :, place] = bins[np.arange(len(bins))[:, None], dims[slot]]
    each = np.zeros((len(dims), FEW, labels))
    each[slot, place, y] = times
    cuts = np.sort(at, axis=2)
    below = (at[:, :, None, :] <= cuts[..., None]).astype(float).reshape(len(dims), -1, FEW)
    return cuts, (below @ each).reshape(*cuts.shape, labels)


@dataclass
class Part:
    """A tree, or a part of one: node i has the children left[i] and left[i] + 1, and -1 is a leaf; a leaf's share of each label that it has."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    label: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(dim: np.ndarray, cut: np.ndarray, left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> Part:
        own = np.where((left < 0)[:, None], total * weights, 0.0)
        leaf, label = np.nonzero(own)
        return Part(dim.astype(np.int32), cut.astype(np.uint8), left.astype(np.int32), leaf.astype(np.int32), label.astype(np.int32), np.rint(ONE * own[leaf, label] / own.sum(axis=1)[leaf]).astype(np.int64))

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[self.left[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.dim[here]] > self.cut[here])
        return at

    def votes(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, label, share) of each label that a point's leaf has."""
        at = self.walk(bins)
        first, last = np.searchsorted(self.leaf, at, side="left"), np.searchsorted(self.leaf, at, side="right")
        n = last - first
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(bins)), n), self.label[place], self.share[place]


@dataclass
class Top:
    """The part of a tree that jobs split: nodes with their names in the whole tree (children of i: 2 i + 1, 2 i + 2) and counts."""

    name: list[int]
    dim: list[int]
    cut: list[int]
    left: list[int]
    total: list[np.ndarray]

    def part(self, weights: np.ndarray) -> Part:
        return Part.of(np.array(self.dim), np.array(self.cut), np.array(self.left), np.stack(self.total), weights)

    def add(self, name: int, total: np.ndarray) -> None:
        for column, x in ((self.name, name), (self.dim, 0), (self.cut, 0), (self.left, -1), (self.total, total)):
            column.append(x)


@dataclass
class Forest:
    """The tops of the trees; (tree, cell, part) of what is below, where a cell is a leaf of a top."""

    binned: Boosted
    tops: list[Part]
    cells: DataFrame
    tasks: int

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, vec, …) with the number of the likeliest label as prediction: that with the greatest sum of leaves' shares."""
        key, tops = F.xxhash64("id", "vec"), self.tops

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bins, keys, _ in _arrays(batches):
                for tree, top in enumerate(tops):
                    yield _by_cell(tree, top.walk(bins), {"bins": bins, "keys": keys})

        def vote(points: pa.Table, cell: pa.Table) -> pa.Table:
            found = []
            if cell.num_rows:
                part = pickle.loads(cell.column("part")[0].as_py())
                for bins, keys in zip(points.column("bins"), points.column("keys"), strict=True):
                    keys = np.frombuffer(keys.as_py(), "<i8")
                    point, label, share = part.votes(np.frombuffer(bins.as_py(), np.uint8).reshape(len(keys), -1))
                    found.append((keys[point], label, share))
            key, label, share = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            return pa.table({"_key": pa.array(key, pa.int64()), "y": pa.array(label, pa.int32()), "share": pa.array(share, pa.int64())})

        blocks = rows.select(key.alias("key"), F.lit(0).alias("y"), doubles("vec").alias("vec")).mapInArrow(_to_blocks(self.binned), "bins binary, keys binary, y binary")
        dealt = blocks.mapInArrow(deal, "tree int, cell int, bins binary, keys binary").repartition(self.tasks, "tree", "cell")
        votes = dealt.groupBy("tree", "cell").cogroup(self.cells.repartition(self.tasks, "tree", "cell").groupBy("tree", "cell")).applyInArrow(vote, "_key long, y int, share long")
        said = votes.groupBy("_key", "y").agg(F.sum("share").alias("n")).groupBy("_key").agg((-F.max(F.struct("n", (-F.col("y")).alias("y")))["y"]).cast("double").alias("_said"))
        return rows.withColumn("_key", key).join(said, "_key", "left").withColumn("prediction", F.coalesce("_said", F.lit(0.0))).drop("_key", "_said")

    def forget(self) -> None:
        self.cells.unpersist()


@dataclass
class RandomForest:
    """``fit`` on (id, y, vec, weight), where weight is the same for all points of a label; a node looks at the root of all dimensions."""

    trees: int = 100
    depth: int = 30
    min_rows: int = 1
    n_bins: int = 32
    seed: int = 42

    def getNumTrees(self) -> int:  # noqa: N802
        return self.trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth

    def fit(self, rows: DataFrame) -> Forest:
        n_of = {int(r["y"]): (r["n"], r["weight"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).collect()}  # a row for each label
        labels = max(n_of) + 1
        sizes, weights = (np.array([float(n_of.get(k, (0, 0))[j]) for k in range(labels)]) for j in (0, 1))
        binned = Boosted(Boosting(n_bins=self.n_bins).edges(rows), labels)
        blocks = rows.select(F.xxhash64("id").alias("key"), F.col("y").cast("int").alias("y"), doubles("vec").alias("vec")).mapInArrow(_to_blocks(binned), "bins binary, keys binary, y binary").persist()
        tops = self.tops(blocks, len(binned.edges), sizes, weights)
        parts, seed = [top.part(weights) for top in tops], self.seed
        name, shut = [top.name for top in tops], [[not self.open(top, k) for k in range(len(top.name))] for top in tops]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bins, keys, y in _arrays(batches):
                for tree, part in enumerate(parts):
                    times = bag(keys, tree, seed)
                    used = np.flatnonzero(times)
                    at = part.walk(bins[used])
                    mine = ~np.array(shut[tree])[at]
                    used = used[mine]
                    yield _by_cell(tree, at[mine], {"bins": bins[used], "y": y[used], "times": times[used]})

        def grow(points: pa.Table) -> pa.Table:
            tree, cell = points.column("tree")[0].as_py(), points.column("cell")[0].as_py()
            y, times = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in points.column(c)]) for c, kind in (("y", "<i4"), ("times", np.uint8)))
            bins = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in points.column("bins")]).reshape(len(y), -1)
            part = self.grown(bins, y, times, tree, name[tree][cell], weights)
            return pa.table({"tree": pa.array([tree], pa.int32()), "cell": pa.array([cell], pa.int32()), "part": pa.array([pickle.dumps(part)], pa.binary())})

        leaf = [(tree, k, Part.of(*np.array([[0], [0], [-1]]), top.total[k][None], weights)) for tree, top in enumerate(tops) for k in range(len(top.name)) if top.left[k] < 0 and shut[tree][k]]
        tasks = int(min(max(sizes.sum() * self.trees // ROWS_IN_TASK, 8), 2 * sum(x.count(False) for x in shut) + 1))
        cells = blocks.mapInArrow(deal, "tree int, cell int, bins binary, y binary, times binary").repartition(tasks, "tree", "cell").groupBy("tree", "cell").applyInArrow(grow, "tree int, cell int, part binary")
        if leaf:
            cells = cells.unionByName(rows.sparkSession.createDataFrame([(tree, k, pickle.dumps(part)) for tree, k, part in leaf], "tree int, cell int, part binary"))
        cells = cells.persist()
        cells.count()
        blocks.unpersist()
        return Forest(binned, parts, cells, tasks)

    def open(self, top: Top, k: int) -> bool:
        """Is the node left to a task?"""
        return top.left[k] < 0 and top.total[k].sum() <= ROWS_IN_CELL

    def tops(self, blocks: DataFrame, width: int, sizes: np.ndarray, weights: np.ndarray) -> list[Top]:
        """Split nodes of more than ROWS_IN_CELL points, all trees at once, a level at a time."""
        tops = [Top([], [], [], [], []) for _ in range(self.trees)]
        for top in tops:
            top.add(0, sizes)
        asked = [(tree, 0) for tree in range(self.trees) if not self.open(tops[tree], 0)]
        at_a_time = max(1, SEND // (self.subset(width) * self.n_bins * len(weights)))
        for _ in range(self.depth):
            more = []
            for first in range(0, len(asked), at_a_time):
                some = asked[first : first + at_a_time]
                for cell, gain, dim, cut, low, total in self.level(blocks, [top.part(weights) for top in tops], [tops[tree].name for tree in range(self.trees)], some, width, weights):
                    tree, k = some[cell]
                    top = tops[tree]
                    top.total[k] = total
                    if gain > 1e-12:
                        top.dim[k], top.cut[k], top.left[k] = dim, cut, len(top.name)
                        top.add(2 * top.name[k] + 1, low)
                        top.add(2 * top.name[k] + 2, total - low)
                        more += [(tree, j) for j in (top.left[k], top.left[k] + 1) if top.total[j].sum() > ROWS_IN_CELL]
            asked = more
        return tops

    def level(self, blocks: DataFrame, parts: list[Part], names: list[list[int]], asked: list[tuple[int, int]], width: int, weights: np.ndarray) -> Iterator[tuple]:
        """(place in ``asked``, gain, dimension, cut, counts on the left, counts) of each of the nodes (tree, place in its top)."""
        labels, n_bins, seed, least = len(weights), self.n_bins, self.seed, self.min_rows
        by_tree: dict[int, list[int]] = {}
        for cell, (tree, _) in enumerate(asked):
            by_tree.setdefault(tree, []).append(cell)
        dims = {tree: subsets(np.array([names[tree][asked[c][1]] for c in cells]), tree, width, self.subset(width), seed) for tree, cells in by_tree.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = {tree: 0.0 for tree in by_tree}
            for bins, keys, y in _arrays(batches):
                for tree, cells in by_tree.items():
                    times = bag(keys, tree, seed)
                    used = np.flatnonzero(times)
                    slot = np.full(len(names[tree]), -1)
                    slot[[asked[c][1] for c in cells]] = np.arange(len(cells))
                    slot = slot[parts[tree].walk(bins[used])]
                    used, slot = used[slot >= 0], slot[slot >= 0]
                    out[tree] = out[tree] + counts(bins[used], y[used], times[used], slot, dims[tree], labels, n_bins)
            for tree, cells in by_tree.items():
                for place, cell in enumerate(cells if not np.isscalar(out[tree]) else []):
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([out[tree][place].tobytes()], pa.binary())], names=["cell", "sums"])

        def merge(group: pa.Table) -> pa.Table:
            cell = group.column("cell")[0].as_py()
            found = sum(np.frombuffer(x.as_py()) for x in group.column("sums")).reshape(1, -1, n_bins, labels)
            tree, total = asked[cell][0], found[0, 0].sum(axis=0)
            gain, which, cut = best_cuts(np.cumsum(found, axis=2)[:, :, :-1], total[None], weights, least)
            low = found[0, which[0], : cut[0] + 1].sum(axis=0)
            return pa.table({"cell": group.column("cell").slice(0, 1), "gain": gain, "dim": pa.array([dims[tree][by_tree[tree].index(cell), which[0]]], pa.int32()), "cut": pa.array(cut, pa.int32()), "low": pa.array([low.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary())})

        merged = blocks.mapInArrow(run, "cell int, sums binary").groupBy("cell").applyInArrow(merge, "cell int, gain double, dim int, cut int, low binary, total binary")
        for r in sorted(merged.collect()):  # nodes of more than ROWS_IN_CELL points
            yield r["cell"], r["gain"], r["dim"], r["cut"], np.frombuffer(r["low"]), np.frombuffer(r["total"])

    def subset(self, width: int) -> int:
        return ceil(sqrt(width)) if self.trees > 1 else width

    def grown(self, bins: np.ndarray, y: np.ndarray, times: np.ndarray, tree: int, root: int, weights: np.ndarray) -> Part:
        """The node ``root`` of a tree down to its leaves, a level of all its nodes at a time."""
        labels, columns, made = len(weights), [], 1
        nodes, slot = np.array([root]), np.zeros(len(y), np.int64)
        while len(nodes):
            total = np.bincount(slot * labels + y, weights=times, minlength=len(nodes) * labels).reshape(-1, labels)
            dim, cut, split = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
            mixed_up = ((total > 0).sum(axis=1) > 1) & (total.sum(axis=1) >= 2 * self.min_rows) & ((int(nodes[0]) + 1).bit_length() <= self.depth)
            few = np.bincount(slot, minlength=len(nodes)) <= FEW
            for look, singly, n_cuts in ((np.flatnonzero(mixed_up & few), True, FEW), (np.flatnonzero(mixed_up & ~few), False, self.n_bins)):
                place = np.full(len(nodes), -1)
                place[look] = np.arange(len(look))
                rows = np.flatnonzero(place[slot] >= 0)
                rows = rows[np.argsort(place[slot[rows]], kind="stable")]
                at = place[slot[rows]]
                step = max(1, LOOK // (self.subset(bins.shape[1]) * n_cuts * labels))
                for first in range(0, len(look), step):
                    some = look[first : first + step]
                    lo, hi = np.searchsorted(at, (first, first + step))
                    dims, mine = subsets(nodes[some], tree, bins.shape[1], self.subset(bins.shape[1]), self.seed), rows[lo:hi]
                    told = bins[mine], y[mine], times[mine], at[lo:hi] - first, dims, labels
                    if singly:
                        cuts, lower = few_cuts(*told)
                    else:
                        lower = np.cumsum(counts(*told, self.n_bins), axis=2)[:, :, :-1]
                    gain, which, best = best_cuts(lower, total[some], weights, self.min_rows)
                    dim[some], split[some] = dims[np.arange(len(some)), which], gain > 1e-12
                    cut[some] = cuts[np.arange(len(some)), which, best] if singly else best
            order = np.cumsum(split) - 1
            columns.append((dim, cut, np.where(split, made + 2 * order, -1), np.where(split[:, None], 0, total)))
            made += 2 * int(split.sum())
            here = split[slot]
            bins, y, times, slot = bins[here], y[here], times[here], slot[here]
            slot = 2 * order[slot] + (bins[np.arange(len(y)), dim[slot]] > cut[slot])
            nodes = (2 * nodes[split][:, None] + [1, 2]).ravel()
        return Part.of(*(np.concatenate(c) for c in zip(*columns, strict=True)), weights)


def _to_blocks(binned: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            bins = binned.bins(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1))
            own = [batch.column(c).to_numpy().astype(kind).tobytes() for c, kind in ((0, "<i8"), (1, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (bins.tobytes(), *own)], names=["bins", "keys", "y"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, keys, y) of each block."""
    for batch in batches:
        for bins, keys, y in zip(*batch.columns, strict=True):
            keys = np.frombuffer(keys.as_py(), "<u8")
            yield np.frombuffer(bins.as_py(), np.uint8).reshape(len(keys), -1), keys, np.frombuffer(y.as_py(), "<i4")


def _by_cell(tree: int, at: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of a block, packed by cell."""
    order = np.argsort(at, kind="stable")
    cell, first = np.unique(at[order], return_index=True)
    packed = {k: pa.array([x.tobytes() for x in np.split(v[order], first[1:])] if len(at) else [], pa.binary()) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(cell), pa.int32()), "cell": pa.array(cell, pa.int32())} | packed)
