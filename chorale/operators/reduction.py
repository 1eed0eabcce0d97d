"""Two-dimensional views of vectors: PCA, linear discriminants, t-SNE and UMAP.

The first two are aggregates over all rows. The last two fit points one by one against each other, in the task
of their group (a layer or a pooling). A group of more than ``most`` points is fitted on so many landmarks of
it, taken in hash order; every other point is then placed among its nearest landmarks, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.vec import doubles
from chorale.operators.clustering import scatter
from chorale.operators.fusion import CentredPCA
from chorale.operators.neighbors import nearest
from chorale.operators.projection import covariance_array
from chorale.operators.sampling import hash_order


def _named(df: DataFrame) -> DataFrame:
    return df.select("id", "label", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def pca_2d(points: DataFrame) -> DataFrame:
    return _named(CentredPCA(2).fit(points).transform(points))


def discriminant_2d(points: DataFrame) -> DataFrame:
    """(id, label, x, y) on the two best linear discriminants; y is null with two labels, ValueError with one.

    Class means and the total covariance are aggregated in Spark; the driver solves for the directions.
    """
    s = scatter(points).toPandas()  # labels * dimensions rows
    total, _ = covariance_array(points)
    labels, d = s["label"].nunique(), int(s["dim"].max()) + 1
    if labels < 2:
        raise ValueError("linear discriminants need two labels")
    means = s.pivot(index="label", columns="dim", values="mean").to_numpy()
    sizes = s[s["dim"] == 0].sort_values("label")["n"].to_numpy()
    grand = sizes @ means / sizes.sum()
    between = ((means - grand) * (sizes / sizes.sum())[:, None]).T @ (means - grand)
    within = total - between + 1e-9 * np.trace(total) / d * np.eye(d)
    half = np.linalg.inv(np.linalg.cholesky(within))
    values, vecs = np.linalg.eigh(half @ between @ half.T)
    n = min(2, labels - 1)
    axes = (half.T @ vecs[:, ::-1][:, :n]).T
    axes *= np.sign(axes[np.arange(n), np.abs(axes).argmax(1)])[:, None]
    at = [F.aggregate(F.zip_with(doubles("vec"), F.array(*[F.lit(float(x)) for x in a]), lambda p, q: p * q), F.lit(float(-(a @ grand))), lambda m, p: m + p) for a in axes]
    return points.select("id", "label", at[0].alias("x"), (at[1] if n > 1 else F.lit(None).cast("double")).alias("y"))


def tsne(x: np.ndarray, perplexity: float = 30.0, rate: float = 200.0, steps: int = 1000, seed: int = 42) -> np.ndarray:
    """Exact t-SNE (van der Maaten and Hinton, 2008)."""
    n = len(x)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(d.mean(), 1e-12)
    for _ in range(50):
        p = np.exp(-d * beta[:, None])
        np.fill_diagonal(p, 0)
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(min(perplexity, max(n - 1, 2) / 3))
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + np.minimum(high, 1e300)) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, move, gain = np.random.default_rng(seed).normal(scale=1e-4, size=(n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for step in range(steps):
        q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        force = ((12 if step < 250 else 1) * p - np.maximum(q / q.sum(), 1e-12)) * q
        slope = 4 * (force.sum(1)[:, None] * y - force @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if step < 250 else 0.8) * move - rate * gain * slope
        y = y + move
        y -= y.mean(0)
    return y


def umap(x: np.ndarray, neighbours: int = 15, min_dist: float = 0.1, epochs: int = 200, seed: int = 42) -> np.ndarray:
    """A fuzzy neighbour graph on cosine distances laid out by sampled attraction and repulsion (McInnes et al., 2018)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.maximum(1 - u @ u.T, 0)
    np.fill_diagonal(d, np.inf)
    k = min(neighbours, n - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    rho = dist[:, :1]
    low, high = np.full((n, 1), 1e-6), np.full((n, 1), 1e3)
    for _ in range(40):
        sigma = (low + high) / 2
        wide = np.exp(-np.maximum(dist - rho, 0) / sigma).sum(1, keepdims=True) > np.log2(max(k, 2))
        low, high = np.where(wide, low, sigma), np.where(wide, sigma, high)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.maximum(dist - rho, 0) / sigma), 1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(np.triu(w, 1))
    chance = w[i, j] / w[i, j].max()
    span = np.linspace(0, 3, 300)
    curve = np.where(span < min_dist, 1, np.exp(-(span - min_dist)))
    a, b = min(((a, b) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.5, 1.5, 21)), key=lambda c: (((1 / (1 + c[0] * span ** (2 * c[1]))) - curve) ** 2).sum())
    y = rng.uniform(-10, 10, (n, 2))
    for epoch in range(epochs):
        alpha = 1 - epoch / epochs
        on = rng.random(len(i)) < chance
        for s, t in ((i[on], j[on]), (j[on], i[on])):
            gap = y[s] - y[t]
            r = np.maximum((gap**2).sum(1, keepdims=True), 1e-9)
            np.add.at(y, s, alpha * np.clip(-2 * a * b * r ** (b - 1) / (1 + a * r**b) * gap, -4, 4))
            far = rng.integers(0, n, len(s))
            gap = y[s] - y[far]
            r = (gap**2).sum(1, keepdims=True)
            np.add.at(y, s, alpha * np.clip(2 * b / ((0.001 + r) * (1 + a * r**b)) * gap, -4, 4))
    return y


_methods = {"tsne": tsne, "umap": umap}


def layout_2d(points: DataFrame, method: str = "umap", keys: tuple[str, ...] = (), most: int = 2000, near: int = 5, **options) -> DataFrame:
    """(keys, id, label, x, y, error): every point of every group by t-SNE, UMAP or, for any other method, PCA over all groups.

    Points that are no landmarks of a large group get the mean place of their ``near`` nearest landmarks,
    weighted by 1 / distance (cosine, as UMAP's). A group that fails has null places and ``error``.
    """
    if method not in _methods:
        return _pca_by_group(points, keys) if keys else pca_2d(points).withColumn("error", F.lit(None).cast("string"))
    f = _methods[method]
    rows = points.select(*keys, "id", "label", doubles("vec").alias("vec"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order("id"), "id"))
    placed = rows.withColumn("_p", place)
    fitted, rest = placed.where(F.col("_p") <= most).drop("_p"), placed.where(F.col("_p") > most).drop("_p")
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        try:
            at, error = f(np.stack(pdf["vec"]), **options), None
        except Exception as e:  # noqa: BLE001 - one group's fault leaves the others
            at, error = np.full((len(pdf), 2), np.nan), str(e)
        return pdf[[*keys, "id", "label"]].assign(x=at[:, 0], y=at[:, 1], error=error)

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, "id", "label")], "x double, y double, error string"])
    grouped = fitted.groupBy(*keys) if keys else fitted.groupBy(F.lit(0))
    layout = grouped.applyInPandas(one, schema)
    if not rest.take(1):
        return layout
    layout = layout.persist()
    close = nearest(rest, fitted, near, keys).withColumn("w", 1 / (F.col("dist") + 1e-9))
    marks = layout.select(*keys, F.col("id").alias("neighbour"), "x", "y", "error")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    beside = close.join(marks, [*keys, "neighbour"]).groupBy(*keys, "id", "label").agg(mean("x"), mean("y"), F.max("error").alias("error"))
    return layout.unionByName(beside.select(*layout.columns))


def _pca_by_group(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """PCA of each group; the groups, not the rows, are gone through."""
    out = None
    for group in points.select(*keys).distinct().collect():
        at = [F.col(k).eqNullSafe(F.lit(group[k])) for k in keys]
        cond = at[0]
        for c in at[1:]:
            cond = cond & c
        part = pca_2d(points.where(cond)).select(*[F.lit(group[k]).alias(k) for k in keys], "id", "label", "x", "y", F.lit(None).cast("string").alias("error"))
        out = part if out is None else out.unionByName(part)
    return out
