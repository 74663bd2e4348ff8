"""Latent codes: a variational autoencoder in numpy, KMeans on its codes.

Training takes at most ``fit_rows`` rows (those with the least hash, so reruns agree) to the driver: layers are small and a feature
table has a row per segment, so more rows change little. Encoding, clustering and everything after run over all rows on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.config import VaeConfig
from pitchlake.errors import ModelError
from pitchlake.models.labels import soft_assignment
from pitchlake.models.mixture import matrix

#: Slope of the activation below zero, momentum and floor of the normalisation, plateau rule of the learning rate.
SLOPE, MOMENTUM, FLOOR = 0.01, 0.1, 1e-5
PATIENCE, FACTOR = 10, 0.5

Weights = dict[str, np.ndarray]


def layer_names(config: VaeConfig) -> tuple[list[str], list[str]]:
    """Hidden layers of the encoder and of the decoder, which mirrors it."""
    return [f"e{i}" for i in range(len(config.hidden))], [f"d{i}" for i in range(len(config.hidden))]


def first_weights(n: int, config: VaeConfig, rng: np.random.Generator) -> Weights:
    """Uniform weights within one over the root of a layer's inputs."""
    sizes = [n, *config.hidden]
    back = [config.latent, *reversed(config.hidden)]
    shapes = {f"e{i}": (sizes[i], sizes[i + 1]) for i in range(len(config.hidden))}
    shapes |= {"mu": (sizes[-1], config.latent), "logvar": (sizes[-1], config.latent)}
    shapes |= {f"d{i}": (back[i], back[i + 1]) for i in range(len(config.hidden))} | {"out": (back[-1], n)}
    w: Weights = {}
    for name, (a, b) in shapes.items():
        edge = 1 / np.sqrt(a)
        w[f"{name}.w"], w[f"{name}.b"] = rng.uniform(-edge, edge, (a, b)), rng.uniform(-edge, edge, b)
        if name[0] in "ed":
            w |= {f"{name}.gain": np.ones(b), f"{name}.shift": np.zeros(b), f"{name}.mean": np.zeros(b), f"{name}.var": np.ones(b)}
    return w


def _hidden(x: np.ndarray, name: str, w: Weights, rng: np.random.Generator | None, dropout: float) -> tuple[np.ndarray, tuple]:
    """A hidden layer: linear, normalised over the batch, leaky, dropped out; without ``rng`` as after training. Second: what going back needs."""
    h = x @ w[f"{name}.w"] + w[f"{name}.b"]
    if rng is None:
        mean, var = w[f"{name}.mean"], w[f"{name}.var"]
    else:
        mean, var = h.mean(0), h.var(0)
        unbiased = var * len(h) / max(1, len(h) - 1)
        for k, now in (("mean", mean), ("var", unbiased)):
            w[f"{name}.{k}"] = (1 - MOMENTUM) * w[f"{name}.{k}"] + MOMENTUM * now
    spread = np.sqrt(var + FLOOR)
    u = (h - mean) / spread
    v = w[f"{name}.gain"] * u + w[f"{name}.shift"]
    keep = np.ones(v.shape) if rng is None or not dropout else (rng.random(v.shape) >= dropout) / (1 - dropout)
    return np.where(v > 0, v, SLOPE * v) * keep, (x, u, v, spread, keep)


def _hidden_back(g: np.ndarray, name: str, w: Weights, kept: tuple, grads: Weights) -> np.ndarray:
    x, u, v, spread, keep = kept
    g = g * keep * np.where(v > 0, 1, SLOPE)
    grads[f"{name}.gain"], grads[f"{name}.shift"] = (g * u).sum(0), g.sum(0)
    g = g * w[f"{name}.gain"]
    g = (g - g.mean(0) - u * (g * u).mean(0)) / spread
    grads[f"{name}.w"], grads[f"{name}.b"] = x.T @ g, g.sum(0)
    return g @ w[f"{name}.w"].T


def loss_and_gradients(x: np.ndarray, w: Weights, config: VaeConfig, rng: np.random.Generator) -> tuple[float, Weights]:
    """One batch: mean squared error plus beta times the mean divergence, and its gradients."""
    enc, dec = layer_names(config)
    grads: Weights = {}
    kept, h = {}, x
    for name in enc:
        h, kept[name] = _hidden(h, name, w, rng, config.dropout)
    top = h
    mu, logvar = (top @ w[f"{k}.w"] + w[f"{k}.b"] for k in ("mu", "logvar"))
    noise = rng.standard_normal(mu.shape)
    h = code = mu + noise * np.exp(0.5 * logvar)
    for name in dec:
        h, kept[name] = _hidden(h, name, w, rng, config.dropout)
    away = h @ w["out.w"] + w["out.b"] - x
    loss = (away**2).mean() - 0.5 * config.beta * (1 + logvar - mu**2 - np.exp(logvar)).mean()
    g = 2 * away / away.size
    grads["out.w"], grads["out.b"] = h.T @ g, g.sum(0)
    g = g @ w["out.w"].T
    for name in reversed(dec):
        g = _hidden_back(g, name, w, kept[name], grads)
    g_mu = g + config.beta * mu / mu.size
    g_logvar = g * (code - mu) * 0.5 - 0.5 * config.beta * (1 - np.exp(logvar)) / mu.size
    for k, gk in (("mu", g_mu), ("logvar", g_logvar)):
        grads[f"{k}.w"], grads[f"{k}.b"] = top.T @ gk, gk.sum(0)
    g = g_mu @ w["mu.w"].T + g_logvar @ w["logvar.w"].T
    for name in reversed(enc):
        g = _hidden_back(g, name, w, kept[name], grads)
    return float(loss), grads


@dataclass
class VariationalEncoder:
    """fit, then encode: columns to ``latent`` numbers, the means of the codes."""

    config: VaeConfig
    columns: list[str] = field(default_factory=list)
    weights: Weights | None = None
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str]) -> VariationalEncoder:
        """Adam over shuffled batches; the rate halves when the loss hasn't fallen for PATIENCE epochs."""
        c = self.config
        x = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(c.fit_rows).toPandas().to_numpy(float)
        if len(x) < 2:
            raise ModelError("fewer than two rows")
        rng = np.random.default_rng(c.seed)
        w, self.columns, self.losses = first_weights(x.shape[1], c, rng), list(columns), []
        moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        rate, best, waited, step = c.rate, np.inf, 0, 0
        for _ in range(c.epochs):
            order, total = rng.permutation(len(x)), []
            for i in range(0, len(x), c.batch):
                batch = x[order[i : i + c.batch]]
                if len(batch) < 2:  # a batch of one has no spread
                    continue
                loss, grads = loss_and_gradients(batch, w, c, rng)
                total.append(loss)
                step += 1
                for k, g in grads.items():
                    a, b = moments.get(k, (0.0, 0.0))
                    a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
                    moments[k] = a, b
                    w[k] = w[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            self.losses.append(float(np.mean(total)))
            if self.losses[-1] < best * (1 - 1e-4):
                best, waited = self.losses[-1], 0
            elif (waited := waited + 1) > PATIENCE:
                rate, waited = rate * FACTOR, 0
        if not all(np.isfinite(v).all() for v in w.values()):
            raise ModelError("training didn't converge")
        self.weights = w
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            raise RuntimeError("fit first")
        for name in layer_names(self.config)[0]:
            x, _ = _hidden(x, name, self.weights, None, 0.0)
        return x @ self.weights["mu.w"] + self.weights["mu.b"]

    @property
    def columns_out(self) -> list[str]:
        return [f"latent_{i}" for i in range(self.config.latent)]

    def encode(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and latent_0 ... of each row, batch by batch on executors."""
        if self.weights is None:
            raise RuntimeError("fit first")
        names, columns, codes = self.columns_out, self.columns, self.codes
        schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], *[f"{c} double" for c in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = codes(matrix(b, columns))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keys], *map(pa.array, z.T)], names=[*keys, *names])

        return df.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, schema)

    def to_json(self) -> str:
        c = self.config
        config = [c.latent, list(c.hidden), c.dropout, c.beta, c.epochs, c.batch, c.rate, c.fit_rows, c.seed]
        return json.dumps({"model": "vae", "config": config, "columns": self.columns, "losses": self.losses, "weights": {k: v.tolist() for k, v in (self.weights or {}).items()}})

    @classmethod
    def from_json(cls, text: str) -> VariationalEncoder:
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("model") != "vae":
            raise ModelError("not a variational encoder")
        latent, hidden, *rest = d["config"]
        return cls(VaeConfig(latent, tuple(hidden), *rest), d["columns"], {k: np.array(v) for k, v in d["weights"].items()} or None, d["losses"])


@dataclass
class Clusters:
    """Centres over named columns; the nearest one is a row's label."""

    columns: list[str]
    centres: list[list[float]]
    cost: float

    @property
    def n_states(self) -> int:
        return len(self.centres)

    def predict(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, cluster (the nearest centre, the first of ties) and prob_0 ...: softmax of the negative distances."""
        v = F.array(*[F.col(c).cast("double") for c in self.columns])
        every = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centres])
        far = F.transform(every, lambda c: F.aggregate(F.zip_with(F.col("_v"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        rows = df.select(*keys, v.alias("_v")).withColumn("_d", far)
        rows = rows.select(*keys, "_v", (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("cluster"))
        return soft_assignment(rows, "_v", self.centres, [*keys, "cluster"])


def fit_clusters(df: DataFrame, columns: list[str], k: int = 6, n_init: int = 10, seed: int = 42, max_iter: int = 100) -> Clusters:
    """The best of n_init runs of KMeans by the sum of squared distances."""
    rows = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))
    rows = rows.persist()
    try:
        if rows.count() < k:
            raise ValueError("fewer rows than clusters")
        best = None
        for i in range(n_init):
            model = KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(rows)
            if best is None or model.summary.trainingCost < best[0]:
                best = model.summary.trainingCost, [c.tolist() for c in model.clusterCenters()]
    finally:
        rows.unpersist()
    return Clusters(list(columns), best[1], float(best[0]))
