"""Multichannel models: fitted by one aggregate (or a few), small matrix work on the driver, applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .channels import affine

#: Moments of this many channels at most are gathered on the driver: a matrix of their square.
MOST_CHANNELS = 512
#: Up to so many channels, moments are one aggregate in the JVM; beyond, matrix products over Arrow batches.
FEW_CHANNELS = 16


@dataclass(frozen=True)
class Model:
    """y = M^T (x - mean)."""

    columns: tuple[str, ...]
    mean: np.ndarray
    matrix: np.ndarray
    values: np.ndarray | None = None  # eigenvalues or the like, largest first
    settled: bool = True  # whether an iterative fit met its tolerance

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.values.sum()

    def transform(self, df: DataFrame, components: int | None = None, prefix: str = "y", zero_fill: bool = False) -> DataFrame:
        k = self.matrix.shape[1] if components is None else components
        made = affine(self.columns, self.mean.tolist(), self.matrix[:, :k].tolist())
        out = df.withColumns({f"{prefix}{i}": c for i, c in enumerate(made)})
        return out.withColumns({f"{prefix}{i}": F.lit(0.0) for i in range(k, len(self.columns))}) if zero_fill else out

    def save(self, spark) -> DataFrame:
        """A one-row DataFrame."""
        return spark.createDataFrame([(list(self.columns), self.mean.tolist(), self.matrix.tolist(), None if self.values is None else self.values.tolist())], "columns array<string>, mean array<double>, matrix array<array<double>>, `values` array<double>")

    @classmethod
    def load(cls, df: DataFrame) -> Model:
        r = df.first()
        return cls(tuple(r[0]), np.array(r[1]), np.array(r[2]), None if r[3] is None else np.array(r[3]))


def _total(parts: DataFrame, add, schema: str):
    """One row from the tasks' partial rows: added up in a few tasks as they stream in, then in one."""
    return parts.repartition(16).mapInPandas(add, schema).coalesce(1).mapInPandas(add, schema).first()


def _aggregates(columns: Sequence[str]) -> list:
    """Count, means and the upper triangle of covariances; partial results are combined by Spark."""
    each = [F.col(c).cast("double") for c in columns]
    return [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.covar_samp(each[i], each[j]).alias(f"c{i}_{j}") for i in range(len(each)) for j in range(i, len(each))]]


def _of_row(row, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    cov = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] for i in range(n)]), cov


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample covariances by one pass over the rows without a null in any column; partial sums in the tasks, one small row a task to add up."""
    n = len(columns)
    if n > MOST_CHANNELS:
        raise ValueError("too many channels")
    df = df.select(*columns).dropna()
    if n <= FEW_CHANNELS:
        row = df.agg(*_aggregates(columns)).first()
        if not row["n"]:
            raise ValueError("no rows")
        return _of_row(row, n)

    def part(frames):
        count, mean, scatter = 0, np.zeros(n), np.zeros((n, n))
        for f in frames:
            x = f.to_numpy(np.float64)
            if not len(x):
                continue
            m = x.mean(0)
            d = m - mean
            both = count + len(x)
            scatter = scatter + (x - m).T @ (x - m) + np.outer(d, d) * count * len(x) / both
            mean, count = mean + d * len(x) / both, both
        if count:
            yield pd.DataFrame({"n": [count], "mean": [mean], "s": [scatter.ravel()]})

    def add(frames):
        count, mean, scatter = 0, np.zeros(n), np.zeros((n, n))
        for f in frames:
            for c, m, s in zip(f["n"], f["mean"], f["s"], strict=True):
                d, both = m - mean, count + c
                scatter = scatter + s.reshape(n, n) + np.outer(d, d) * count * c / both
                mean, count = mean + d * c / both, both
        if count:
            yield pd.DataFrame({"n": [count], "mean": [mean], "s": [scatter.ravel()]})

    schema = "n bigint, mean array<double>, s array<double>"
    row = _total(df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(part, schema), add, schema)
    if row is None:
        raise ValueError("no rows")
    return row[0], np.array(row[1]), np.array(row[2]).reshape(n, n) / max(row[0] - 1, 1)


def _eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors whose largest component is positive."""
    w, v = np.linalg.eigh(c)
    w, v = w[::-1], v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def pca(df: DataFrame, columns: Sequence[str]) -> Model:
    n, mean, cov = moments(df, columns)
    if n < len(columns):
        raise ValueError("fewer rows than channels")
    w, v = _eigen(cov)
    return Model(tuple(columns), mean, v, np.maximum(w, 0))


def whitening(df: DataFrame, columns: Sequence[str], epsilon: float = 1e-5) -> Model:
    """ZCA: V (D + epsilon)^-1/2 V^T."""
    n, mean, cov = moments(df, columns)
    if n < len(columns):
        raise ValueError("fewer rows than channels")
    w, v = _eigen(cov)
    return Model(tuple(columns), mean, v @ np.diag(1 / np.sqrt(np.maximum(w, 0) + epsilon)) @ v.T, w)


def ica(df: DataFrame, columns: Sequence[str], iterations: int = 200, tolerance: float = 1e-4, seed: int = 7) -> Model:
    """FastICA with tanh: all components at once, kept orthogonal; each iteration is one pass of partial sums over the whitened channels, which are kept meanwhile.
    ``settled`` of the model says whether the tolerance was met within the iterations."""
    white = whitening(df, columns, 1e-12)
    n = len(columns)
    z = white.transform(df.select(*columns).dropna(), prefix="_z").select(*[f"_z{i}" for i in range(n)]).persist()
    settled = False
    schema = "n bigint, g array<double>, d array<double>"
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(iterations):
        now = w

        def part(frames):
            g, dg, count = np.zeros((n, n)), np.zeros(n), 0
            for f in frames:
                x = f.to_numpy(np.float64)
                t = np.tanh(x @ now.T)
                g, dg, count = g + t.T @ x, dg + (1 - t**2).sum(0), count + len(x)
            if count:
                yield pd.DataFrame({"n": [count], "g": [g.ravel()], "d": [dg]})

        def add(frames):
            count, g, d = 0, 0.0, 0.0
            for f in frames:
                count, g, d = count + f["n"].sum(), g + np.sum(f["g"].tolist(), axis=0), d + np.sum(f["d"].tolist(), axis=0)
            if count:
                yield pd.DataFrame({"n": [count], "g": [g], "d": [d]})

        c, g, d = _total(z.mapInPandas(part, schema), add, schema)
        new = np.array(g).reshape(n, n) / c - (np.array(d) / c)[:, None] * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        moved = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
        w = new
        if moved < tolerance:
            settled = True
            break
    z.unpersist()
    return Model(tuple(columns), white.mean, white.matrix @ w.T, settled=settled)


def csp(df: DataFrame, columns: Sequence[str], label: str, one, two, ridge: float = 1e-6) -> Model:
    """Common spatial patterns of two classes: filters by their share of the first class's variance, largest first."""
    if len(columns) <= FEW_CHANNELS:  # both classes in one pass
        both = df.where(F.col(label).isin(one, two)).select(label, *columns).dropna().groupBy(label).agg(*_aggregates(columns)).collect()
        of = {r[label]: _of_row(r, len(columns)) for r in both}
        if len(of) < 2:
            raise ValueError("a class without rows")
        (_, m1, c1), (_, m2, c2) = of[one], of[two]
    else:
        _, m1, c1 = moments(df.where(F.col(label) == one), columns)
        _, m2, c2 = moments(df.where(F.col(label) == two), columns)
    c1, c2 = c1 + ridge * np.eye(len(columns)), c2 + ridge * np.eye(len(columns))
    w, v = _eigen(c1 + c2)
    p = v / np.sqrt(w)
    d, u = _eigen(p.T @ c1 @ p)
    return Model(tuple(columns), (m1 + m2) / 2, p @ u, d)


def beamformer(channels: int, geometry: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """Delay-and-sum weights (equal, of length one) and a blocking matrix that spans what they reject."""
    if channels < 2 or geometry not in ("linear", "circular", "planar"):
        raise ValueError("two channels or more; linear, circular or planar")
    w = np.full(channels, 1 / np.sqrt(channels))
    q = np.linalg.qr(np.column_stack([w, np.eye(channels)[:, 1:]]))[0]
    return w, q[:, 1:]


def gsc(df: DataFrame, columns: Sequence[str], weights, blocking) -> DataFrame:
    """Two columns for an adaptive canceller: noise reference (sum of blocked channels) and beam."""
    block = np.asarray(blocking).sum(1)
    both = np.column_stack([block, np.asarray(weights)])
    noise, beam = affine(columns, [0.0] * len(columns), both.tolist())
    return df.withColumn("noise_reference", noise).withColumn("beam", beam)
