"""Standardising, projecting and fusing feature sets; fitted state is a few arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.vec import doubles, scale
from chorale.operators.layers import combine_layers, default_weights
from chorale.operators.projection import applied, moments, principal


#: Dimensions up to which means and deviations are literals of the plan; wider vectors go through an Arrow step.
LITERALS = 512


@dataclass
class Standardiser:
    """Mean 0 and population deviation 1 in every dimension; a constant dimension is only centred."""

    mean: list[float] | None = None
    std: list[float] | None = None

    def fit(self, df: DataFrame, vec: str = "vec") -> Standardiser:
        _, mean, std = moments(df, vec)
        flat = std <= 1e-12 * np.maximum(np.abs(mean), 1)
        self.mean, self.std = mean.tolist(), np.where(flat, 1.0, std).tolist()
        return self

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        if self.mean is None:
            raise ValueError("the standardiser is not fitted")
        if len(self.mean) > LITERALS:
            mean, std = np.array(self.mean), np.array(self.std)
            return df.withColumn(vec, applied(doubles(vec), lambda x: (x - mean) / std))
        m, s = (F.array(*[F.lit(x) for x in v]) for v in (self.mean, self.std))
        return df.withColumn(vec, F.zip_with(F.zip_with(doubles(vec), m, lambda x, a: x - a), s, lambda x, b: x / b))


@dataclass
class CentredPCA:
    """Principal components of centred vectors; the largest loading of each is positive."""

    k: int = 2
    components: list[list[float]] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, vec: str = "vec") -> CentredPCA:
        axes, shares, mean = principal(df, self.k, vec)
        self.components, self.explained, self.mean = axes.tolist(), shares.tolist(), mean.tolist()
        return self

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        if not self.components:
            raise ValueError("the projection is not fitted")
        axes, mean = np.array(self.components).T, np.array(self.mean)
        return df.withColumn(vec, applied(doubles(vec), lambda x: (x - mean) @ axes))


def fusion_weights(dims: list[int]) -> list[float]:
    """The sum of all dimensions / (own dimensions * number of sets)."""
    return [sum(dims) / (d * len(dims)) for d in dims]


class Fusion:
    """Concatenation, weighted or pca_fusion of feature sets that share a key column."""

    def __init__(self, method: str = "concatenation", key: str = "file_key", normalise: bool = True, pca_dims: dict[str, int] | None = None) -> None:
        if method not in ("concatenation", "weighted", "pca_fusion"):
            raise ValueError(f"unknown fusion: {method}")
        if method == "pca_fusion" and not pca_dims:
            raise ValueError("pca_fusion needs pca_dims")
        self.method, self.key, self.normalise, self.pca_dims = method, key, normalise, pca_dims or {}
        self.scalers: dict[str, Standardiser] = {}
        self.projections: dict[str, CentredPCA] = {}
        self.weights: dict[str, float] = {}

    def fit(self, sets: dict[str, DataFrame]) -> Fusion:
        dims = []
        for name, df in sets.items():
            if self.normalise or self.method == "pca_fusion":
                self.scalers[name] = Standardiser().fit(df)
                df = self.scalers[name].transform(df)
            if self.method == "pca_fusion":
                if name not in self.pca_dims:
                    raise ValueError(f"pca_dims lacks {name}")
                self.projections[name] = CentredPCA(self.pca_dims[name]).fit(df)
            dims.append(df.agg(F.max(F.size("vec"))).first()[0])
        if self.method == "weighted":
            self.weights = dict(zip(sets, fusion_weights(dims), strict=True))
        return self

    def transform(self, sets: dict[str, DataFrame]) -> DataFrame:
        """(key, vec) of the clips that every set has; sets in the given order."""
        out = None
        for i, (name, df) in enumerate(sets.items()):
            if name in self.scalers:
                df = self.scalers[name].transform(df)
            if self.method == "pca_fusion":
                if name not in self.projections:
                    raise ValueError("the fusion is not fitted")
                df = self.projections[name].transform(df)
            v = scale(doubles("vec"), self.weights[name]) if self.method == "weighted" else doubles("vec")
            part = df.select(self.key, v.alias(f"_v{i}"))
            out = part if out is None else out.join(part, self.key)
        return out.select(self.key, F.concat(*[f"_v{i}" for i in range(len(sets))]).alias("vec"))

    def fit_transform(self, sets: dict[str, DataFrame]) -> DataFrame:
        return self.fit(sets).transform(sets)

    def info(self) -> dict:
        return {"method": self.method, "weights": self.weights, "explained": {k: p.explained for k, p in self.projections.items()}}


class MultiLayerFusion:
    """Layers combined to one vector (concatenation, mean, weighted_mean or pca), then standardised."""

    def __init__(self, layers: list[int], method: str = "concatenation", key: str = "file_key", normalise: bool = True, pca_dims: int = 50) -> None:
        self.layers, self.method, self.key, self.pca = layers, method, key, CentredPCA(pca_dims)
        self.scaler = Standardiser() if normalise or method == "pca" else None

    def _combined(self, df: DataFrame) -> DataFrame:
        method = "concatenation" if self.method == "pca" else self.method
        return combine_layers(df, [self.key], method, self.layers, default_weights(self.layers) if method == "weighted_mean" else None)

    def fit(self, df: DataFrame) -> MultiLayerFusion:
        rows = self._combined(df)
        if self.scaler:
            rows = self.scaler.fit(rows).transform(rows)
        if self.method == "pca":
            self.pca.fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self._combined(df)
        if self.scaler:
            rows = self.scaler.transform(rows)
        return self.pca.transform(rows) if self.method == "pca" else rows

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def simple_fusion(**options) -> Fusion:
    """Sets side by side as they are."""
    return Fusion("concatenation", **{"normalise": False} | options)


def weighted_fusion(**options) -> Fusion:
    """Standardised sets, each weighted so that a wide one does not outweigh a narrow one."""
    return Fusion("weighted", **options)


def pca_fusion(pca_dims: dict[str, int], **options) -> Fusion:
    """Standardised sets, each projected to so many components."""
    return Fusion("pca_fusion", pca_dims=pca_dims, **options)


def layer_fusion(layers: list[int], method: str = "concatenation", **options) -> MultiLayerFusion:
    return MultiLayerFusion(layers, method, **options)
