"""Distances between distributions of vectors: Gaussian statistics, Frechet distance, divergence frontiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_statistics(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """``group, n, i, mean, row``: per group the mean vector and the rows of the unbiased covariance.

    Tasks add up products of their vectors; one row per group and dimension is shuffled per task.
    """
    kind = dict(df.dtypes)[group]
    schema = f"`{group}` {kind}, i int, n long, total double, row array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for g, part in b.groupby(group, dropna=False):
                x = np.stack(part[vector].to_numpy()).astype(float)
                s = sums.setdefault(g, [0, np.zeros(size), np.zeros((size, size))])
                s[0] += len(x)
                s[1] += x.sum(axis=0)
                s[2] += x.T @ x
        for g, (n, total, prod) in sums.items():
            yield pd.DataFrame({group: [g] * size, "i": np.arange(size), "n": n, "total": total, "row": list(prod)})

    p = df.select(group, vector).mapInPandas(partial, schema)
    s = p.groupBy(group, "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.array(*[F.sum(F.col("row")[j]) for j in range(size)]).alias("row"))
    means = s.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("total") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("_mean"))  # ``size`` numbers a group
    cov = F.zip_with("row", "_mean", lambda x, m: (x - F.col("n") * m * F.element_at("_mean", F.col("i") + 1)) / (F.col("n") - 1))
    return s.join(means, group).select(group, "i", "n", F.element_at("_mean", F.col("i") + 1).alias("mean"), cov.alias("row"))


def _root_trace(a: np.ndarray, b: np.ndarray) -> float:
    """Trace of the square root of ``a b`` for covariances, by the symmetric form."""
    w, v = np.linalg.eigh(a)
    half = v @ np.diag(np.sqrt(np.maximum(w, 0))) @ v.T
    return float(np.sqrt(np.maximum(np.linalg.eigvalsh(half @ b @ half), 0)).sum())


def frechet_distance(df: DataFrame, group: str, vector: str, size: int, first, second, jitter: float = 1e-6) -> DataFrame:
    """``distance`` between the Gaussians of two groups, not below zero. Only statistics come to the driver."""
    rows = gaussian_statistics(df.where(F.col(group).isin(first, second)), group, vector, size).collect()
    stats = {}
    for g in (first, second):
        mine = sorted((r for r in rows if r[group] == g), key=lambda r: r["i"])
        stats[g] = (np.array([r["mean"] for r in mine]), np.array([r["row"] for r in mine]))
    (m1, c1), (m2, c2) = stats[first], stats[second]
    root = _root_trace(c1, c2)
    if not np.isfinite(root):
        root = _root_trace(c1 + jitter * np.eye(size), c2 + jitter * np.eye(size))
    value = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root)
    return df.sparkSession.createDataFrame([(first, second, max(0.0, value))], f"first {dict(df.dtypes)[group]}, second {dict(df.dtypes)[group]}, distance double")


def frontier_score(df: DataFrame, group: str, vector: str, first, second, clusters: int | None = None, scale: float = 5.0, seed: int = 7, components: int = 0, most: int = 500) -> DataFrame:
    """Area under the divergence frontier of two groups, quantised by k-means over both.

    Without ``clusters`` there is one for every ten vectors of the smaller group, from 2 to ``most``, which bounds the
    centres that a task holds. Groups of equal histograms score 1; a group without vectors is an error.

    With ``components``, vectors are first projected on so many principal components of both groups. That and the
    clustering are distributed; the histograms that come to the driver have one number per cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(group).isin(first, second)).select(group, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if components:
        from pyspark.ml.feature import PCA

        rows = PCA(k=components, inputCol="features", outputCol="projected").fit(rows).transform(rows).select(group, F.col("projected").alias("features"))
    sizes = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).collect()}
    if len(sizes) < 2:
        raise ValueError(f"no vectors of {first!r} or of {second!r}")
    clusters = clusters or max(2, min(most, min(sizes.values()) // 10))
    model = KMeans(k=clusters, seed=seed, maxIter=30).fit(rows)
    counts = model.transform(rows).groupBy(group, "prediction").agg(F.count("*").alias("n")).collect()
    hist = {g: np.zeros(clusters) for g in (first, second)}
    for r in counts:
        hist[r[group]][r["prediction"]] = r["n"]
    p, q = (h / h.sum() for h in (hist[first], hist[second]))

    def divergence(a: np.ndarray, b: np.ndarray) -> float:
        on = a > 0
        return float((a[on] * np.log(a[on] / b[on])).sum())

    points = [(0.0, 1.0)]
    for w in np.linspace(0.01, 0.99, 99):
        r = w * p + (1 - w) * q
        points.append((np.exp(-scale * divergence(q, r)), np.exp(-scale * divergence(p, r))))
    points.append((1.0, 0.0))
    # Where groups agree, points share an x; the frontier falls there, so the higher ones come first.
    x, y = np.array(sorted(points, key=lambda p: (p[0], -p[1]))).T
    area = float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
    return df.sparkSession.createDataFrame([(area,)], "score double")
