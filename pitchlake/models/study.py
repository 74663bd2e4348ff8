"""Studies of a feature matrix: dimensions, loadings, redundant groups, what latent numbers go with.

All of it follows from second moments that executors add up: d x d numbers, where d is the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.models.preprocessing import Preprocessor, second_moments

#: Shares of variance whose number of components is reported.
SHARES = (0.80, 0.90, 0.95, 0.99)


def dimensions(pre: Preprocessor) -> dict[str, float]:
    """Components for each of SHARES, participation ratio, components above the mean, features; of a fit with components."""
    share = pre.explained
    total = np.cumsum(share)
    out = {f"n_{round(100 * s)}": float(min(len(share), int(np.searchsorted(total, s)) + 1)) for s in SHARES}
    return out | {"participation_ratio": float(share.sum() ** 2 / (share**2).sum()), "n_above_mean": float((share > share.mean()).sum()), "n_features": float(len(share))}


def loadings(pre: Preprocessor, components: int = 6, top: int = 10) -> list[tuple[int, int, str, float]]:
    """(component, rank, feature, loading) of the features that weigh most in the first components; ties by name."""
    out = []
    for k, w in enumerate(pre.components[:components]):
        best = sorted(range(len(w)), key=lambda i: (-abs(w[i]), pre.columns[i]))[:top]
        out += [(k + 1, r + 1, pre.columns[i], float(w[i])) for r, i in enumerate(best)]
    return out


def importance(pre: Preprocessor, share: float = 0.95) -> list[tuple[str, float]]:
    """(feature, squared loadings weighted by explained shares) over the components that explain ``share``, the largest first."""
    n = min(len(pre.components), int(np.searchsorted(np.cumsum(pre.explained), share)) + 1)
    score = (pre.components[:n] ** 2 * pre.explained[:n, None]).sum(0)
    return sorted(zip(pre.columns, map(float, score), strict=True), key=lambda x: (-x[1], x[0]))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Pearson correlations of rows without nulls, 0 where a column doesn't vary, and the number of rows."""
    n, s, ss = second_moments(df.dropna(subset=list(columns)).select(*[F.col(c).cast("double") for c in columns]), list(columns))
    if not n:
        return np.eye(len(columns)), 0
    cov = ss / n - np.outer(s / n, s / n)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = std <= 1e-12 * np.maximum(1, np.abs(s / n))
    scale = np.where(flat, 1.0, std)
    r = np.clip(cov / np.outer(scale, scale), -1, 1)
    r[flat], r[:, flat] = 0.0, 0.0
    np.fill_diagonal(r, 1.0)
    return r, n


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r of each pair of columns in order, over rows without nulls."""
    r, _ = correlation_matrix(df, columns)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def average_linkage(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Groups left when the two nearest (by mean distance of members) are joined as long as they are at most ``cut`` apart."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if d[i, j] > cut:
            break
        a, b = len(groups[i]), len(groups[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def redundant_groups(df: DataFrame, columns: Sequence[str], cut: float = 0.15) -> DataFrame:
    """group, size, features: features whose absolute correlations put them together; a group's number follows its first feature's place."""
    r, _ = correlation_matrix(df, columns)
    groups = average_linkage(1 - np.abs(r), cut)
    rows = [(g + 1, len(m), [columns[i] for i in m]) for g, m in enumerate(groups)]
    return df.sparkSession.createDataFrame(rows, "`group` int, size int, features array<string>")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided probability of a correlation this large among n independent rows; null below three rows."""
    return None if n < 3 else incomplete_beta(n / 2 - 1, 0.5, 1 - r * r)


def correlates(df: DataFrame, latents: Sequence[str], features: Sequence[str], top: int = 5) -> DataFrame:
    """latent_dim, rank, feature, r, abs_r, p_value: for each latent number the features that go with it most; ties by name."""
    both = [*latents, *features]
    r, n = correlation_matrix(df, both)
    rows = []
    for i, z in enumerate(latents):
        row = r[i, len(latents) :]
        best = sorted(range(len(features)), key=lambda j: (-abs(row[j]), features[j]))[:top]
        rows += [(z, k + 1, features[j], float(row[j]), float(abs(row[j])), correlation_p(float(row[j]), n)) for k, j in enumerate(best)]
    return df.sparkSession.createDataFrame(rows, "latent_dim string, rank int, feature string, r double, abs_r double, p_value double")


def correlates_pivot(found: DataFrame, top: int = 5) -> DataFrame:
    """One row per latent number, its features by rank as text: name and signed correlation of three digits."""
    text = F.format_string("%s (%+.3f)", "feature", "r")
    return found.groupBy(F.col("latent_dim").alias("dim")).pivot("rank", list(range(1, top + 1))).agg(F.first(text)).select("dim", *[F.col(str(k)).alias(f"no_{k}") for k in range(1, top + 1)])


def dominant(df: DataFrame, latents: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys and the number of the latent number of largest absolute value, the first of ties."""
    size = F.array(*[F.abs(F.col(z)) for z in latents])
    return df.select(*keys, (F.array_position(size, F.array_max(size)) - 1).cast("int").alias("dominant_dim"))
