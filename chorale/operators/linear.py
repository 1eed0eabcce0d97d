"""Many multinomial regressions in one optimiser.

Every setting, fold, and layer is a cell with a weight matrix of its own. The matrices of all cells that see a
block of points stand side by side, so one product with the block serves them all; a pass over the points gives
the loss and gradient of every cell, and all cells take their steps of L-BFGS together. A comparison of many
layers over a grid of settings and folds thus takes as many passes as its slowest fit, not a job for each step of
each fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.tables import array_sums, small
from chorale.functions.vec import doubles

#: Points of a block; steps that a cell remembers; passes, and the largest entry of a gradient with which a cell is done.
BLOCK, MEMORY, PASSES, NEAR = 1 << 12, 8, 500, 1e-6
#: Points of a partition; many small ones cost more in every pass than they share.
ROWS_IN_PART = 50_000
#: The fold of points for tests, and the fold left out by a cell that trains on all other points.
TEST = -1


@dataclass(frozen=True)
class Cell:
    """A fit: points of ``group`` that are neither for tests nor in ``fold``, with penalty 1 / (c rows)."""

    group: int
    fold: int
    c: float
    rows: int


@dataclass
class Blocks:
    """Points by group, persisted as blocks of packed numbers."""

    frame: DataFrame
    parts: int
    width: int
    labels: list
    groups: list[tuple]


def to_blocks(points: DataFrame, keys: tuple[str, ...]) -> Blocks:
    """``points`` (keys, label, vec, fold) as blocks; a fold of TEST is for tests."""
    groups = [tuple(r) for r in points.select(*keys).distinct().orderBy(*keys).collect()] if keys else [()]  # a row for each model and layer
    labels = [r[0] for r in points.select("label").distinct().orderBy("label").collect()]
    kinds = dict(points.dtypes)
    spark = points.sparkSession
    codes = small(spark.createDataFrame(list(zip(labels, range(len(labels)), strict=True)), f"label {kinds['label']}, y int"))
    rows = points.join(codes, "label")
    if keys:
        names = spark.createDataFrame([(*g, k) for k, g in enumerate(groups)], ", ".join([*[f"{k} {kinds[k]}" for k in keys], "g int"]))
        rows = rows.join(small(names), list(keys))
    else:
        rows = rows.withColumn("g", F.lit(0))
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            g = batch.column(0).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k in np.unique(g):
                here = g == k
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *[pa.array([batch.column(c).to_numpy()[here].astype("<i4").tobytes()]) for c in (1, 2)], pa.array([np.ascontiguousarray(x[here]).tobytes()])], names=["g", "y", "fold", "x"])

    parts = max(1, rows.count() // ROWS_IN_PART)  # by a shuffle: a coalesced task would hold the sorts of all partitions before it
    frame = rows.select("g", "y", F.col("fold").cast("int").alias("fold"), doubles("vec").alias("vec")).repartition(parts).mapInArrow(pack, "g int, y binary, fold binary, x binary").persist()
    return Blocks(frame, frame.rdd.getNumPartitions(), width, labels, groups)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, y, fold, points with a column of ones) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            y, fold = (np.frombuffer(batch.column(c)[k].as_py(), "<i4") for c in (1, 2))
            x = np.frombuffer(batch.column(3)[k].as_py()).reshape(len(y), width)
            yield batch.column(0)[k].as_py(), y, fold, np.concatenate((x, np.ones((len(y), 1))), axis=1)


def _beside(cells: list[Cell], weights: np.ndarray, shape: tuple[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group: which cells it has, the folds that they leave out, and their matrices side by side."""
    out = {}
    for g in sorted({c.group for c in cells}):
        mine = np.array([k for k, c in enumerate(cells) if c.group == g])
        out[g] = mine, np.array([cells[k].fold for k in mine]), weights[mine].reshape(-1, *shape).transpose(1, 0, 2).reshape(shape[0], -1)
    return out


def losses(blocks: Blocks, cells: list[Cell], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every cell at its weights: one job."""
    width, labels = blocks.width, len(blocks.labels)
    shape = (width + 1, labels)
    beside = _beside(cells, weights, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros((1 + shape[0] * shape[1]) * len(mine)) for g, (mine, _, _) in beside.items()}
        for g, y, fold, x in _rows(batches, width):
            if g not in beside:
                continue
            mine, out_of, w = beside[g]
            scores = (x @ w).reshape(len(y), len(mine), labels)
            scores -= scores.max(axis=2, keepdims=True)
            p = np.exp(scores)
            norm = p.sum(axis=2)
            used = ((fold[:, None] != out_of[None, :]) & (fold[:, None] != TEST)).astype(float)
            loss = (used * (np.log(norm) - scores[np.arange(len(y)), :, y])).sum(axis=0)
            p /= norm[..., None]
            p[np.arange(len(y)), :, y] -= 1
            p *= used[..., None]
            slope = (x.T @ p.reshape(len(y), -1)).reshape(shape[0], len(mine), labels).transpose(1, 0, 2)
            sums[g] += np.concatenate((loss, slope.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["cell", "sums"])

    found = array_sums(blocks.frame.mapInArrow(run, "cell int, sums binary"), blocks.parts)
    f, slope = np.zeros(len(cells)), np.zeros((len(cells), shape[0] * shape[1]))
    for g, (mine, _, _) in beside.items():
        f[mine], slope[mine] = found[g][: len(mine)], found[g][len(mine) :].reshape(len(mine), -1)
    rows = np.array([max(c.rows, 1) for c in cells], float)
    penalty = 1 / (np.array([c.c for c in cells]) * rows)
    free = np.ones(shape)
    free[-1] = 0  # the intercepts
    held = weights * free.ravel()
    return f / rows + penalty / 2 * (held**2).sum(axis=1), slope / rows[:, None] + penalty[:, None] * held


class Steps:
    """Directions of L-BFGS for many cells at once."""

    def __init__(self, n: int, size: int) -> None:
        self.s, self.y, self.rho, self.scale = np.zeros((MEMORY, n, size)), np.zeros((MEMORY, n, size)), np.zeros((MEMORY, n)), np.ones(n)

    def learn(self, k: np.ndarray, s: np.ndarray, y: np.ndarray) -> None:
        """Steps and changes of slope of the cells ``k``; ones that do not curve upwards are not remembered."""
        sy = (s * y).sum(axis=1)
        good = sy > 1e-12 * np.linalg.norm(s, axis=1) * np.linalg.norm(y, axis=1)
        k, s, y, sy = k[good], s[good], y[good], sy[good]
        for memory, new in ((self.s, s), (self.y, y), (self.rho, 1 / sy)):
            memory[:-1, k] = memory[1:, k]
            memory[-1, k] = new
        self.scale[k] = sy / (y * y).sum(axis=1)

    def towards(self, k: np.ndarray, slope: np.ndarray) -> np.ndarray:
        q, a = slope.copy(), np.zeros((MEMORY, len(k)))
        for i in range(MEMORY - 1, -1, -1):
            a[i] = self.rho[i, k] * (self.s[i, k] * q).sum(axis=1)
            q -= a[i][:, None] * self.y[i, k]
        q *= self.scale[k][:, None]
        for i in range(MEMORY):
            b = self.rho[i, k] * (self.y[i, k] * q).sum(axis=1)
            q += self.s[i, k] * (a[i] - b)[:, None]
        return -q


def minimise(value: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, size: int, near: float = NEAR, passes: int = PASSES, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (n, size) that minimise n smooth functions, from 0 or ``start``; ``value`` of some cells and weights is one pass for all of them."""
    w, steps, every = np.zeros((n, size)) if start is None else start.copy(), Steps(n, size), np.arange(n)
    f, slope = value(every, w)
    d, t = -slope, 1 / np.maximum(np.linalg.norm(slope, axis=1), 1.0)
    todo = every[np.abs(slope).max(axis=1) > near]
    for _ in range(passes):
        if not len(todo):
            break
        trial = w[todo] + t[todo, None] * d[todo]
        f1, slope1 = value(todo, trial)
        down = (slope[todo] * d[todo]).sum(axis=1)
        ok = f1 <= f[todo] + 1e-4 * t[todo] * down + 1e-15
        yes = todo[ok]
        steps.learn(yes, trial[ok] - w[yes], slope1[ok] - slope[yes])
        w[yes], f[yes], slope[yes] = trial[ok], f1[ok], slope1[ok]
        d[yes], t[yes] = steps.towards(yes, slope[yes]), 1.0
        t[todo[~ok]] /= 2
        todo = todo[(np.abs(slope[todo]).max(axis=1) > near) & (t[todo] > 1e-10)]
    return w


def predictions(blocks: Blocks, cells: list[Cell], weights: np.ndarray) -> DataFrame:
    """(cell, y_true, y_pred, n) by label, of the points that each cell did not train on: its fold, or those for tests."""
    width, labels = blocks.width, len(blocks.labels)
    beside = _beside(cells, weights, (width + 1, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(cells), labels, labels), np.int64)
        for g, y, fold, x in _rows(batches, width):
            if g not in beside:
                continue
            mine, out_of, w = beside[g]
            said = (x @ w).reshape(len(y), len(mine), labels).argmax(axis=2)
            row, col = np.nonzero(fold[:, None] == out_of[None, :])
            np.add.at(counts, (mine[col], y[row], said[row, col]), 1)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*[pa.array(a, pa.int32()) for a in at], pa.array(counts[at])], names=["cell", "t", "p", "n"])

    names = F.array(*[F.lit(x) for x in blocks.labels])
    each = blocks.frame.mapInArrow(run, "cell int, t int, p int, n long").groupBy("cell", "t", "p").agg(F.sum("n").alias("n"))
    return each.select("cell", F.get(names, F.col("t")).alias("y_true"), F.get(names, F.col("p")).alias("y_pred"), "n")


def fit_grid(points: DataFrame, keys: tuple[str, ...], cs: list[float], folds: list[int]) -> tuple[DataFrame, list[Cell], list[tuple]]:
    """Fit every c with every fold left out, in every group of ``points`` (keys, label, vec, fold), and count what
    each cell says of the points left out: :func:`predictions`, the cells, and the groups' keys.

    A fold of TEST trains on all points that are not for tests.
    """
    blocks = to_blocks(points, keys)
    if not blocks.labels:
        return points.sparkSession.createDataFrame([], f"cell int, y_true {dict(points.dtypes)['label']}, y_pred {dict(points.dtypes)['label']}, n long"), [], []
    counts: dict[tuple[int, int], int] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, fold, _ in _rows(batches, blocks_width):
            values, n = np.unique(fold, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(n), pa.int32()), pa.array(values, pa.int32()), pa.array(n)], names=["g", "fold", "n"])

    blocks_width = blocks.width
    for g, fold, n in blocks.frame.mapInArrow(count, "g int, fold int, n long").groupBy("g", "fold").agg(F.sum("n")).collect():  # groups x folds
        counts[g, fold] = n
    cells = [Cell(g, fold, c, sum(n for (h, f), n in counts.items() if h == g and f not in (TEST, fold))) for g in range(len(blocks.groups)) for fold in folds for c in cs]

    def value(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return losses(blocks, [cells[i] for i in k], w)

    weights = minimise(value, len(cells), (blocks.width + 1) * len(blocks.labels))
    out = predictions(blocks, cells, weights).persist()
    out.count()
    blocks.frame.unpersist()
    return out, cells, blocks.groups
