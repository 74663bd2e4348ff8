"""Feature matrix: null handling, z-scores, principal components. Statistics come from one aggregation each."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.config import PreprocessConfig
from pitchlake.errors import ModelError
from pitchlake.operators.quantiles import exact_quantiles

_FEATURE = re.compile(r"t(\d+)_")


def feature_columns(df: DataFrame, prefix: str = "t", max_tier: int | None = None) -> list[str]:
    """Sorted names of the form t<tier>_..., that begin with the prefix and are of a tier up to the highest."""
    out = sorted(c for c in df.columns if (m := _FEATURE.match(c)) and c.startswith(prefix) and (max_tier is None or int(m[1]) <= max_tier))
    if not out:
        raise ValueError(f"no feature column begins with {prefix!r}")
    return out


def drop_tiers_above(df: DataFrame, max_tier: int) -> DataFrame:
    return df.drop(*[c for c in df.columns if (m := _FEATURE.match(c)) and int(m[1]) > max_tier])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact interpolated medians of the values that are there; 0 for a column without any."""
    found = exact_quantiles(df, columns, (0.5,))
    return {c: 0.0 if found[c][0] is None else found[c][0] for c in columns}


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, population deviation (scale is 1 where that is 0)."""
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns])).alias("s")).select("s.*")


def second_moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum and sum of outer products of the columns: partial sums per partition, added up."""
    d = len(columns)

    def part(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        values = np.concatenate([[float(n)], s, ss.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(values)), "v": values})

    rows = df.select(*columns).mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    if not rows:
        return 0, np.zeros(d), np.zeros((d, d))
    v = np.array([r.v for r in rows])
    return int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)


@dataclass
class Preprocessor:
    """fit, then transform: features to ``columns_out`` of z-scores or components, keys carried along."""

    config: PreprocessConfig
    columns: list[str] | None = None
    fill: dict[str, float] | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    components: np.ndarray | None = None
    explained: np.ndarray | None = None

    def fit(self, df: DataFrame) -> Preprocessor:
        self.columns = feature_columns(df, self.config.prefix)
        if self.config.nulls == "impute_median":
            self.fill = medians(df, self.columns)
        x = self.complete(df)
        n, s, ss = second_moments(x, self.columns)
        if n == 0:
            raise ValueError("no row is left without nulls")
        self.mean = s / n
        cov = ss / n - np.outer(self.mean, self.mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        self.scale = np.where(std > 1e-12, std, 1.0)
        if self.config.variance is not None:
            values, vectors = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
            order = np.argsort(values)[::-1]
            values, vectors = np.maximum(values[order], 0), vectors[:, order]
            share = values / max(values.sum(), 1e-300)
            keep = min(int(np.searchsorted(np.cumsum(share), self.config.variance)) + 1, min(n, len(values)))
            vectors *= np.where(np.abs(vectors).max(0) == vectors.max(0), 1, -1)
            self.components, self.explained = vectors[:, :keep].T, share
        return self

    def complete(self, df: DataFrame) -> DataFrame:
        """Nulls filled with the medians of the fit, or rows with any null dropped."""
        return df.fillna(self.fill) if self.fill is not None else df.dropna(subset=self.columns)

    def retained(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and whether ``transform`` keeps the row: always with imputation, else if no feature is null."""
        if self.columns is None:
            raise RuntimeError("fit first")
        whole = F.lit(True) if self.fill is not None else ~functools.reduce(Column.__or__, [F.col(c).isNull() for c in self.columns])
        return df.select(*keys, whole.alias("retained"))

    @property
    def columns_out(self) -> list[str]:
        return [f"z{i}" for i in range(len(self.columns if self.components is None else self.components))]

    def transform(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and columns_out; weights are literals, so the projection is one generated expression."""
        if self.mean is None:
            raise RuntimeError("fit first")
        if missing := set(self.columns) - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        x = self.complete(df).select(*keys, *[v.alias(f"_{i}") for i, v in enumerate(z)])
        if self.components is None:
            return x.select(*keys, *[F.col(f"_{i}").alias(f"z{i}") for i in range(len(z))])
        every = F.array(*[F.col(f"_{i}") for i in range(len(z))])
        x = x.select(*keys, every.alias("_x"))
        dot = lambda w: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return x.select(*keys, *[dot(w).alias(f"z{k}") for k, w in enumerate(self.components)])

    def to_json(self) -> str:
        array = lambda a: None if a is None else np.asarray(a).tolist()
        c = self.config
        return json.dumps({"config": [c.prefix, c.nulls, c.variance], "columns": self.columns, "fill": self.fill, "mean": array(self.mean), "scale": array(self.scale), "components": array(self.components), "explained": array(self.explained)})

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        d = json.loads(text)
        array = lambda a: None if a is None else np.array(a)
        if "columns" not in d or "config" not in d:
            raise ModelError("not a preprocessor")
        return cls(PreprocessConfig(*d["config"]), d["columns"], d["fill"], array(d["mean"]), array(d["scale"]), array(d["components"]), array(d["explained"]))
