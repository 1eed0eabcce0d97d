"""Sums over wide vectors: moments, covariance and principal directions from blocks of points.

A task stacks its vectors into blocks and adds up what one matrix product gives for each; the sums meet by bands of
rows, so no vector is spread into its products. Up to WIDE dimensions principal directions come from the whole
covariance; beyond that from subspace iteration on a few random directions (Halko, Martinsson and Tropp, 2011),
where a pass moves dimensions times directions, never dimensions squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.tables import added, array_sums
from chorale.functions.vec import doubles

#: Dimensions up to which the whole covariance is formed; vectors of a block; rows of a band of a sum.
WIDE, BLOCK, BAND = 2048, 1024, 256
#: Random directions besides those asked for, and passes of subspace iteration.
SPARE, PASSES = 10, 7


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
        yield batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


def _banded(df: DataFrame, vec: str, product: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(cell, sums): by bands of rows the sum over all blocks of ``product``, a matrix of the same shape for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _stacked(batches):
            part = product(x)
            total = part if total is None else total + part
        if total is not None:
            bands = [total[at : at + BAND].tobytes() for at in range(0, len(total), BAND)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(bands)), pa.int32()), pa.array(bands, pa.binary())], names=["cell", "sums"])

    return df.select(doubles(vec).alias("v")).where("v IS NOT NULL").mapInArrow(run, "cell int, sums binary")


def _matrix(each: DataFrame, width: int) -> np.ndarray:
    bands = array_sums(each, each.rdd.getNumPartitions())
    return np.concatenate([bands[k] for k in sorted(bands)]).reshape(-1, width)


def moments(df: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population deviations of every dimension; sums are taken about the first vector, so that large means cost no digits."""
    first = df.select(doubles(vec).alias("v")).where("v IS NOT NULL").first()
    if first is None:
        return 0, np.zeros(0), np.zeros(0)
    about = np.array(first["v"])
    sums = _matrix(_banded(df, vec, lambda x: np.stack([np.full(len(about), len(x), float), (x - about).sum(axis=0), ((x - about) ** 2).sum(axis=0)])), len(about))
    n = int(sums[0, 0])
    mean = sums[1] / n
    return n, about + mean, np.sqrt(np.maximum(sums[2] / n - mean**2, 0))


def covariance_array(df: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Population covariance, dimensions squared, and means, on the driver."""
    n, mean, _ = moments(df, vec)
    return _matrix(_banded(df, vec, lambda x: (x - mean).T @ (x - mean)), len(mean)) / max(n, 1), mean


def covariance(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, cov) for i <= j, population covariance; it stays in tasks, a band of rows in each."""
    n, mean, _ = moments(df, vec)
    width = len(mean)

    def spread(group: pa.Table) -> pa.Table:
        total = np.frombuffer(added(group).column("sums")[0].as_py()).reshape(-1, max(width, 1)) / max(n, 1)
        first = group.column("cell")[0].as_py() * BAND
        i, j = np.nonzero(np.arange(width)[None, :] >= first + np.arange(len(total))[:, None])
        return pa.table({"i": pa.array(i + first, pa.int32()), "j": pa.array(j, pa.int32()), "cov": total[i, j]})

    return _banded(df, vec, lambda x: (x - mean).T @ (x - mean)).groupBy("cell").applyInArrow(spread, "i int, j int, cov double")


def principal(df: DataFrame, k: int, vec: str = "vec", wide: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions k x dimensions, their shares of the variance, means); the largest entry of a direction is positive."""
    n, mean, std = moments(df, vec)
    width, whole = len(mean), float((std**2).sum())
    k = min(k, width)
    if width <= (WIDE if wide is None else wide):
        cov = _matrix(_banded(df, vec, lambda x: (x - mean).T @ (x - mean)), width) / max(n, 1)
        values, found = np.linalg.eigh(cov)
        values, axes = values[::-1][:k], found[:, ::-1][:, :k].T
    else:
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + SPARE))))[0]
        for _ in range(PASSES):  # a pass over the points each
            moved = _matrix(_banded(df, vec, lambda x, q=q: (x - mean).T @ ((x - mean) @ q)), q.shape[1]) / max(n, 1)
            values, small = np.linalg.eigh((q.T @ moved + moved.T @ q) / 2)
            axes, values = (q @ small[:, ::-1][:, :k]).T, values[::-1][:k]
            q = np.linalg.qr(moved)[0]
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    return axes, np.maximum(values, 0) / (whole or 1.0), mean


def applied(vec: Column, change: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``change`` of stacked vectors in an Arrow step; its matrices travel with the task, not as literals of the plan."""

    @F.pandas_udf("array<double>")
    def run(v):
        import pandas as pd

        return pd.Series(list(change(np.stack(v.to_numpy()).astype(float))) if len(v) else [], dtype=object)

    return run(vec)
