"""Linear machines with the hinge loss, one label against the rest, all labels in one optimiser.

Points are scaled to mean 0 and deviation 1. The hinge is rounded over a width that falls in steps, each from where the
last one ended: the loss of the last step differs from the hinge's by half of its width at most. A pass over the
points gives the loss and slope of every label; a table of one partition is fitted in its task, of a larger one each
pass is a job whose sums alone reach the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.tables import array_sums
from chorale.functions.vec import doubles
from chorale.operators.linear import minimise

#: Points of a block; widths over which the hinge is rounded; the largest entry of a slope, and passes, with which a width is done.
BLOCK, WIDTHS, NEAR, PASSES = 1 << 12, (1.0, 0.1, 0.01, 0.001), 1e-4, 500

#: From y, weights and points of a block to an array that is added over blocks; and from such a function to its sum.
Part = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Total = Callable[[Part], np.ndarray]


@dataclass
class Machines:
    """A row of weights for each label, the intercept last, on points that are scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (…, vec) with the number of the label of the greatest margin as prediction."""

        @F.pandas_udf("double")
        def predict(v):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype=float)
            x = (np.stack(v.to_numpy()).astype(float) - self.mean) * self.scale
            return pd.Series((x @ self.weights[:, :-1].T + self.weights[:, -1]).argmax(axis=1).astype(float))

        return rows.withColumn("prediction", predict(doubles("vec")))


def hinge(z: np.ndarray, sign: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss max(0, 1 - sign z), rounded over ``width``, and its slope by z."""
    short = 1 - sign * z
    slope = np.clip(short / width, 0.0, 1.0)
    return slope * (short - width * slope / 2), -sign * slope


def solve(total: Total, labels: int, penalty: float) -> Machines:
    first = total(lambda y, w, x: np.concatenate(([len(y), w.sum()], x.sum(axis=0))))
    n, heavy, mean = first[0], first[1], first[2:] / first[0]
    spread = np.sqrt(total(lambda y, w, x: ((x - mean) ** 2).sum(axis=0)) / max(n - 1, 1))
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    size, every = len(mean) + 1, np.arange(labels)
    weights = np.zeros((labels, size))
    held = np.append(np.ones(len(mean)), 0.0)  # not the intercept
    for width in WIDTHS:

        def value(k: np.ndarray, at: np.ndarray, width: float = width) -> tuple[np.ndarray, np.ndarray]:
            def part(y: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
                x = np.concatenate(((x - mean) * scale, np.ones((len(y), 1))), axis=1)
                loss, slope = hinge(x @ at.T, np.where(y[:, None] == every[k], 1.0, -1.0), width)
                return np.concatenate((w @ loss, ((slope * w[:, None]).T @ x).ravel()))

            sums = total(part) / heavy
            return sums[: len(k)] + penalty / 2 * (at**2 * held).sum(axis=1), sums[len(k) :].reshape(len(k), size) + penalty * at * held

        weights = minimise(value, labels, size, NEAR, PASSES, weights)
    return Machines(mean, scale, weights)


@dataclass
class Margins:
    """``fit`` on (y, vec, weight): the mean loss, weighted, and ``penalty`` / 2 times the squares of the weights but the intercept."""

    penalty: float

    def fit(self, rows: DataFrame) -> Machines:
        labels, penalty = int(rows.agg(F.max("y")).first()[0]) + 1, self.penalty
        blocks = rows.select(F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"), doubles("vec").alias("vec")).mapInArrow(_to_blocks, "y binary, w binary, x binary").persist()
        parts = blocks.rdd.getNumPartitions()
        if parts == 1:  # all sums are those of one task, which need not send them

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = list(_arrays(batches))
                model = solve(lambda part: sum(part(*block) for block in held), labels, penalty)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

            model = pickle.loads(blocks.mapInArrow(whole, "model binary").first()["model"])
        else:
            model = solve(lambda part: array_sums(blocks.mapInArrow(_summed(part), "cell int, sums binary"), parts)[0], labels, penalty)
        blocks.unpersist()
        return model


def _summed(part: Part) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum(part(*block) for block in _arrays(batches))
        if not np.isscalar(sums):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["cell", "sums"])

    return run


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
        packed = [batch.column(0).to_numpy().astype("<i4"), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()]) for x in packed], names=["y", "w", "x"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, weights, points) of each block."""
    for batch in batches:
        for y, w, x in zip(*batch.columns, strict=True):
            y = np.frombuffer(y.as_py(), "<i4")
            yield y, np.frombuffer(w.as_py()), np.frombuffer(x.as_py()).reshape(len(y), -1)
