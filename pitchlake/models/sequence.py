"""Hidden Markov models with Gaussian emissions: forward-backward per sequence on executors, updates on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.config import HmmConfig
from pitchlake.errors import ModelError
from pitchlake.models.mixture import START_ROWS, GaussianMixture, log_densities, log_sum, spread_start


def _emissions(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    return log_densities(x, np.ones(len(means)), means, covs)


def forward_backward(b: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state posteriors and expected moves of one sequence of log emissions."""
    n, k = b.shape
    with np.errstate(divide="ignore"):
        ls, lm = np.log(start), np.log(move)
    f, g = np.empty((n, k)), np.zeros((n, k))
    f[0] = ls + b[0]
    for t in range(1, n):
        f[t] = b[t] + log_sum(f[t - 1][:, None] + lm, 0)
    for t in range(n - 2, -1, -1):
        g[t] = log_sum(lm + (b[t + 1] + g[t + 1])[None], 1)
    ll = float(log_sum(f[-1], 0))
    moves = np.zeros((k, k))
    for t in range(n - 1):
        moves += np.exp(f[t][:, None] + lm + (b[t + 1] + g[t + 1])[None] - ll)
    return ll, np.exp(f + g - ll), moves


def viterbi(b: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The most likely states of one sequence."""
    n, k = b.shape
    with np.errstate(divide="ignore"):
        s, lm = np.log(start) + b[0], np.log(move)
    back = np.empty((n, k), int)
    for t in range(1, n):
        step = s[:, None] + lm
        back[t] = step.argmax(0)
        s = step.max(0) + b[t]
    path = np.empty(n, np.int32)
    path[-1] = s.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


@dataclass
class HiddenMarkovModel:
    columns: list[str]
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float

    @property
    def n_states(self) -> int:
        return len(self.start)

    def state_means(self, spark) -> DataFrame:  # noqa: ANN001
        """state, feature, mean."""
        rows = [(k, c, float(v)) for k, m in enumerate(self.means) for c, v in zip(self.columns, m, strict=True)]
        return spark.createDataFrame(rows, "state int, feature string, mean double")

    def decode(self, df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
        """group and order columns, hmm_state_label (Viterbi) and hmm_state_prob_k (posteriors)."""
        m, k = self, len(self.start)
        probs = [f"hmm_state_prob_{i}" for i in range(k)]
        keys = [*group, *order]
        schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], "hmm_state_label int", *[f"{p} double" for p in probs]])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            b = _emissions(pdf[m.columns].to_numpy(float), m.means, m.covs)
            _, post, _ = forward_backward(b, m.start, m.move)
            out = pdf[keys].reset_index(drop=True)
            out["hmm_state_label"] = viterbi(b, m.start, m.move)
            for i, p in enumerate(probs):
                out[p] = post[:, i]
            return out

        return df.select(*dict.fromkeys([*keys, *self.columns])).groupBy(*group).applyInPandas(run, schema)

    def transitions(self, spark) -> DataFrame:  # noqa: ANN001
        """from_state, to_state, prob and their labels."""
        rows = [(i, j, float(p), f"S{i}", f"S{j}") for i, r in enumerate(self.move) for j, p in enumerate(r)]
        return spark.createDataFrame(rows, "from_state int, to_state int, prob double, from_label string, to_label string")

    def to_json(self) -> str:
        return json.dumps({"model": "hmm", "columns": self.columns, "start": self.start.tolist(), "move": self.move.tolist(), "means": self.means.tolist(), "covs": self.covs.tolist(), "log_likelihood": self.log_likelihood})

    @classmethod
    def from_json(cls, text: str) -> HiddenMarkovModel:
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("model") != "hmm":
            raise ModelError("not a hidden Markov model")
        return cls(d["columns"], *[np.array(d[x]) for x in ("start", "move", "means", "covs")], d["log_likelihood"])


def fit_hmm(df: DataFrame, columns: list[str], group: list[str], order: list[str], seed: GaussianMixture | None = None, config: HmmConfig | None = None) -> HiddenMarkovModel:
    """Baum-Welch from a mixture's first n_states components, uniform start and moves; one pass over sequences per iteration.

    Without a mixture the states start at spread means of a bounded sample of rows (START_ROWS), each with its own covariance.
    """
    c = config or HmmConfig()
    if seed is None:
        sample = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(START_ROWS).toPandas().to_numpy()
        if len(sample) < c.n_states:
            raise ModelError("fewer rows than states")
        seed = GaussianMixture(columns, *spread_start(sample, c.n_states, np.random.default_rng(c.seed), "full", c.ridge), 0.0, len(sample))
    k, d = min(c.n_states, seed.k), len(columns)
    if k < 1:
        raise ModelError("no state")
    start, move, means, covs = np.full(k, 1 / k), np.full((k, k), 1 / k), seed.means[:k].copy(), seed.covs[:k].copy()
    data, last = df.select(*dict.fromkeys([*group, *order, *columns])), -np.inf
    for _ in range(c.max_iter):
        p = start, move, means, covs

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values(order, kind="stable")[columns].to_numpy(float)
            ll, post, moves = forward_backward(_emissions(x, p[2], p[3]), p[0], p[1])
            v = np.concatenate([[ll, len(x)], post[0], moves.ravel(), post.sum(0), (post.T @ x).ravel(), np.einsum("nk,ni,nj->kij", post, x, x).ravel()])
            return pd.DataFrame({"i": np.arange(len(v)), "v": v})

        # the action below runs before p is bound anew
        rows = data.groupBy(*group).applyInPandas(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not rows:
            raise ModelError("no sequence")
        v = np.array([r.v for r in rows])
        ll, n = v[0], v[1]
        cut = np.cumsum([2, k, k * k, k, k * d, k * d * d])
        s, t, nk, sx, sxx = (v[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
        start = s / s.sum()
        t = t.reshape(k, k) + 1e-12
        move = t / t.sum(1, keepdims=True)
        nk = nk + 1e-10
        means = sx.reshape(k, d) / nk[:, None]
        covs = sxx.reshape(k, d, d) / nk[:, None, None] - np.einsum("ki,kj->kij", means, means) + c.ridge * np.eye(d)
        if ll - last < c.tol * n:
            break
        last = ll
    return HiddenMarkovModel(columns, *p, float(ll))
